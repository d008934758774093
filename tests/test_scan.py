import json
import os

import pytest

from routeloom.scan import runner
from routeloom.sources import tree


def routes(name, path, text):
    e = runner.REGISTRY[name]
    assert runner.applies(e, path)
    return [(r.method, r.path) for r in e.routes(path, text)]


CASES = [
    ("express", "src/a.js", "app.get('/users/:id', f)\nrouter.all(`/x`, g)", [("GET", "/users/{id}"), ("ALL", "/x")]),
    ("fastify", "a.js", "app.register(r, { prefix: '/v1' })\nfastify.post('/u', {}, f)\nfastify.route({ method: 'PUT', url: '/z' })", [("POST", "/v1/u"), ("PUT", "/v1/z")]),
    ("koa", "a.js", "const r = new Router({ prefix: '/api' })\nr.get('/u/:id', f)", [("GET", "/api/u/{id}")]),
    ("nestjs", "a.ts", "@ApiTags('cats')\n@Controller('cats')\nexport class C {\n  @Get(':id')\n  async one(@Param('id') id: string): Promise<Cat> {\n", [("GET", "/cats/{id}")]),
    ("nextjs", "pages/api/users/[id].ts", "if (req.method === 'DELETE') {}", [("DELETE", "/api/users/{id}")]),
    ("nextjs", "src/app/api/posts/route.ts", "export async function GET() {}\nexport async function POST() {}", [("GET", "/api/posts"), ("POST", "/api/posts")]),
    ("nuxt", "server/api/users/[id].get.ts", "", [("GET", "/api/users/{id}")]),
    ("nuxt", "pages/about/index.vue", "", [("GET", "/about")]),
    ("hapi", "a.js", "server.route({\n method: ['GET', 'POST'],\n path: '/u/{id}'\n})", [("GET", "/u/{id}"), ("POST", "/u/{id}")]),
    ("fastapi", "main.py", 'router = APIRouter(prefix="/v1")\n@router.post("/items", response_model=Item)\ndef f(item: Item):\n    """Make it."""\n', [("POST", "/v1/items")]),
    ("flask", "app.py", "@app.route('/u/<int:id>', methods=['GET', 'PUT'])\ndef f(id): pass\n@app.route('/h')\ndef h(): pass", [("GET", "/u/{id}"), ("PUT", "/u/{id}"), ("GET", "/h")]),
    ("django", "urls.py", "path('users/<int:pk>/', V.as_view())", [("GET", "/users/{pk}/"), ("POST", "/users/{pk}/")]),
    ("go-chi", "m.go", 'r.Route("/api", func(r chi.Router) {\nr.Get("/u/{id}", h)\n})', [("GET", "/api/u/{id}")]),
    ("go-gin", "m.go", 'g := r.Group("/v1")\ng.POST("/u/:id", h)', [("POST", "/v1/u/{id}")]),
    ("go-echo", "m.go", 'e.GET("/u/:id", h)', [("GET", "/u/{id}")]),
    ("go-fiber", "m.go", 'app.Delete("/u/:id", h)', [("DELETE", "/u/{id}")]),
    ("go-stdlib", "m.go", 'mux.HandleFunc("/u", h)', [("GET", "/u"), ("POST", "/u")]),
    ("aspnet-mvc", "UsersController.cs", '[Route("api/[controller]")]\npublic class UsersController : Controller\n{\n  [HttpGet("{id:int}")]\n  public ActionResult<User> Get(int id) {}\n}', [("GET", "api/users/{id}")]),
    ("aspnet-minimal", "Program.cs", 'var g = app.MapGroup("/v1");\ng.MapPost("/u/{id:int}", (User u) => 1).RequireAuthorization();', [("POST", "/v1/u/{id}")]),
    ("spring", "UserController.java", '@RequestMapping("/api")\nclass UserController {\n@GetMapping("/u/{id}")\npublic ResponseEntity<User> get(@PathVariable Long id) {', [("GET", "/api/u/{id}")]),
    ("rails", "config/routes.rb", "Rails.application.routes.draw do\n  resources :users\n  resources :posts, only: [:index, :show]\n  namespace :admin do\n    get 'stats'\n  end\nend", None),
    ("sinatra", "app.rb", "# Lists all\nget '/u/:id' do\nend", [("GET", "/u/{id}")]),
    ("laravel", "routes/api.php", "Route::get('/u/{id?}', 'C');\nRoute::apiResource('photos', 'P');", None),
    ("symfony", "C.php", "#[Route('/api')]\nclass C {\n  #[Route('/u/{id<\\d+>}', methods: ['GET', 'PUT'])]\n", [("GET", "/api/u/{id}"), ("PUT", "/api/u/{id}")]),
    ("codeigniter", "app/Config/Routes.php", "$routes->group('api', function($routes) {\n$routes->get('u/(:num)', 'U::s');\n});\n$routes->post('x', 'X');", [("GET", "/api/u/{id}"), ("POST", "/x")]),
    ("zend", "config/module.config.php", "'route' => '/users[/:id]',", [("GET", "/users/{id}")]),
    ("actix", "m.rs", '#[get("/u/{id:\\\\d+}")]\nasync fn f() {}', [("GET", "/u/{id}")]),
    ("axum", "m.rs", '.route("/u/:id", get(show))', [("GET", "/u/{id}")]),
    ("ktor", "R.kt", 'routing {\n route("/api") {\n  route("/u") {\n   get("/{id?}") {\n   }\n  }\n  post {\n  }\n }\n}', [("GET", "/api/u/{id}"), ("POST", "/api")]),
]


@pytest.mark.parametrize("name,path,text,want", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_extractor(name, path, text, want):
    got = routes(name, path, text)
    if name == "rails":
        assert len(got) == 6 + 2 + 1 and ("GET", "/admin/stats") in got and ("GET", "/users/{id}") in got
    elif name == "laravel":
        assert len(got) == 1 + 6 and ("GET", "/u/{id}") in got and ("DELETE", "/photos/{photo}") in got
    else:
        assert got == want


def test_all_registered():
    assert len(runner.REGISTRY) == 27


def test_scan_project(spark):
    files = spark.createDataFrame([
        ("requirements.txt", "FastAPI==0.1\n"),
        ("models.py", "class Item(BaseModel):\n    name: str\n    age: Optional[int] = None\n    mail: EmailStr\n"),
        ("main.py", '@app.post("/items", response_model=Item)\ndef make(item: Item):\n    """Make an item."""\n    pass\n@app.get("/items/{item_id}")\ndef one(item_id: int):\n    pass\n'),
        ("node_modules/x.js", "app.get('/no', f)"), ("bad.py", None),
    ], "path string, content string")
    assert [r.framework for r in runner.detect(files).collect()] == ["fastapi"]
    got = {(r.method, r.path_pattern): r for r in runner.scan(files).collect()}
    assert set(got) == {("POST", "/items"), ("GET", "/items/{item_id}")}
    body = json.loads(got["POST", "/items"].req_schema)
    assert body["required"] == ["name", "mail"] and body["properties"]["mail"] == {"type": "string", "format": "email"} and got["POST", "/items"].description == "Make an item."


def test_source_tree(spark, tmp_path):
    (tmp_path / "proj" / "src").mkdir(parents=True)
    (tmp_path / "proj" / "src" / "a.js").write_text("app.get('/a', f)\n")
    (tmp_path / "proj" / "package.json").write_text('{"dependencies":{"express":"1"}}')
    files = runner.source_files(spark, str(tmp_path / "proj"))
    assert [(r.path_pattern, r.source_file) for r in runner.scan(files).collect()] == [("/a", "src/a.js")]


def test_conventional_routes(spark):
    """Without route attributes a controller follows the project's template, or its own name."""
    code = "public class {0}Controller : ApiController\n{{\n  [HttpGet]\n  public User ListAll() {{}}\n  [HttpPost]\n  [ActionName(\"log-in\")]\n  public User In([FromBody] Login x) {{}}\n}}"
    files = [("A/UserController.cs", code.format("User"))]
    config = [("App_Start/WebApiConfig.cs", 'config.Routes.MapHttpRoute(name: "D", routeTemplate: "api/{controller}/{action}/{id}");')]
    scanned = lambda rows: sorted((r.method, r.path_pattern) for r in runner.scan(spark.createDataFrame(rows, "path string, content string"), ["aspnet-mvc"]).collect())
    assert scanned(files + config) == [("GET", "api/user/listall"), ("POST", "api/user/log-in")]
    assert scanned(files) == [("GET", "user"), ("POST", "user")]


def test_nest_signature_over_lines():
    text = """@Controller('cats')
export class C {
  @Post(':id/toys')
  async add(
    @Param('id') id: string,
    @Query('dry') dry: boolean,
    @Body() body: ToyDto,
  ): Promise<ToyDto[]> {
  }
}
export class ToyDto {
  @IsString()
  name: string;
}
"""
    for path in ("a.ts", "src/.x/cat.controller.js"):
        assert runner.applies(runner.REGISTRY["nestjs"], path)
        (r,) = runner.REGISTRY["nestjs"].routes(path, text)
        assert (r.method, r.path, r.line) == ("POST", "/cats/{id}/toys", 4) and r.req["required"] == ["name"]
        assert r.resp == {"type": "array", "items": r.req} and [(p["name"], p["in"]) for p in r.params] == [("id", "path"), ("dry", "query")]
    assert list(runner.REGISTRY["nestjs"].routes("a.js", text)) == []


def test_named_request_type():
    (r,) = runner.REGISTRY["express"].routes("a.ts", "app.post('/u', (req: Request<{}, any, NewUser>, res) => 1)")
    assert r.req == {"type": "object", "description": "TS type: NewUser"}
    (r,) = runner.REGISTRY["express"].routes("a.ts", "app.post('/u', (req: Request<{}, any, { id: number }>, res) => 1)")
    assert r.req["properties"] == {"id": {"type": "number"}}


def test_detection(spark):
    found = lambda rows: {r.framework for r in runner.detect(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert found([("go.mod", "module x\n")]) == {"go-stdlib"} and found([("a/go.mod", "module x\nrequire github.com/go-chi/chi v5")]) == {"go-chi"}
    assert found([("mypom.xml", "spring-boot"), ("a/b/c/pom.xml", "spring-boot")]) == set() and found([("a/b/pom.xml", "Spring-Boot")]) == {"spring"}
    assert found([("package.json", '"hapi": 1, "nuxi": 2'), ("X.csproj", "Microsoft.NET.Sdk.Web")]) == {"hapi", "nuxt", "aspnet-minimal"}


def test_skipped_folders_are_not_opened(spark, tmp_path):
    """Named pipes stand where nothing may be opened: opening one would wait for ever."""
    top = tmp_path / "proj"
    for d in ("src/deep/er", "node_modules/x", "dist", ".git", "api"):
        (top / d).mkdir(parents=True)
    for p in ("node_modules/x/a.js", "dist/b.js", ".git/c.js", "src/picture.png", "api/m.py"):
        os.mkfifo(top / p)
    (top / "package.json").write_text('{"dependencies":{"express":"1"}}')
    for k, d in enumerate(("", "src/", "src/deep/", "src/deep/er/")):
        (top / f"{d}s{k}.js").write_text(f"app.get('/r{k}', f)\n")
    for listed in (1, 200_000):
        index = tree.tree(spark, str(top), listed=listed, partition_bytes=1)
        assert sorted(r.path for r in index.collect() if r.path.endswith(".js")) == ["s0.js", "src/deep/er/s3.js", "src/deep/s2.js", "src/s1.js"]
    found = runner.scan_tree(spark, str(top)).collect()  # of the detected frameworks none reads .py
    assert {r.path_pattern for r in found} == {f"/r{k}" for k in range(4)}


def test_wide_trees_are_dealt_into_bounded_tasks(spark, tmp_path):
    """Many directories side by side: more than the driver lists, and far more than there are tasks."""
    for k in range(600):
        (tmp_path / f"p{k}" / "src").mkdir(parents=True)
        (tmp_path / f"p{k}" / "src" / "s.js").write_text("app.get('/r', f)\n")
    want = sorted(f"p{k}/src/s.js" for k in range(600))
    for listed in (100, 700, 2000):  # stops at the top, between directories, not at all
        index = tree.tree(spark, str(tmp_path), listed=listed, tasks=8, partition_bytes=1)
        assert index.rdd.getNumPartitions() <= 2 * 8 and sorted(r.path for r in index.collect()) == want
    work = tree.TreeReader({"path": str(tmp_path), "listed": "700"}).partitions()
    assert len(work) <= 2 * tree.TASKS and sum(len(w.files) + len(w.folders) for w in work) <= 700 + tree.AT_ONCE


def test_a_scan_lists_its_tree_once(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"dependencies":{"express":"1"}}')
    (tmp_path / "a.js").write_text("app.get('/a', f)\n")
    found = runner.tree_facts(spark, str(tmp_path))
    (tmp_path / "package.json").unlink()  # named its framework already
    (tmp_path / "b.js").write_text("app.get('/b', f)\n")  # came after the listing
    assert "source_tree" not in found._jdf.queryExecution().toString() and [(r.framework, r.path_pattern) for r in found.where("kind = 'route'").collect()] == [("express", "/a")]


def test_unreadable_files_give_errors(spark, tmp_path):
    rows = [("a.js", "x" * 70_000 + "\napp.get('/a', f)"), ("b.js", "app.get('/b', f)"), ("c.txt", "x" * 70_000)]
    files = spark.createDataFrame(rows, "path string, content string")
    assert [(r.framework, r.source_file, "longer than" in r.error) for r in runner.scan(files, ["express"], errors=True).collect()] == [("express", "a.js", True)]
    assert [r.path_pattern for r in runner.scan(files, ["express"]).collect()] == ["/b"]
    (tmp_path / "a.js").symlink_to(tmp_path / "a.js")
    (tmp_path / "b.js").write_text("app.get('/b', f)")
    assert [r.path_pattern for r in runner.scan_tree(spark, str(tmp_path), ["express"]).collect()] == ["/b"]


def test_thousand_projects(spark):
    """Projects side by side: one type name and one template name in each, none reaches another; a thousand in one table."""
    rows = []
    for k in range(1000):
        rows += [(f"org/p{k}/requirements.txt", "fastapi" if k % 2 else "flask"), (f"org/p{k}/m.py", f"class Item(BaseModel):\n    f{k}: int\n"), (f"org/p{k}/main.py", f'@app.post("/x{k}")\ndef f(item: Item):\n    pass\n@app.route("/y{k}")\ndef g():\n    pass\n')]
    rows.append(("loose.py", '@app.route("/loose")\ndef g():\n    pass\n'))
    got = runner.scan_projects(spark.createDataFrame(rows, "path string, content string")).collect()
    mine = {(r.project, r.path_pattern, r.framework) for r in got}
    assert {x for x in mine if x[2] == "fastapi" and x[0]} == {(f"org/p{k}", f"/x{k}", "fastapi") for k in range(1, 1000, 2)}
    assert {x for x in mine if x[2] == "flask" and x[0]} >= {(f"org/p{k}", f"/y{k}", "flask") for k in range(0, 1000, 2)} and ("", "/loose", "flask") in mine
    assert all(json.loads(r.req_schema)["required"] == [f"f{r.project[5:]}"] for r in got if r.framework == "fastapi" and r.req_schema)


def test_table_function_and_views(spark, tmp_path):
    from routeloom.operators.catalog import CatalogStore
    from routeloom.scan import sql

    spark.createDataFrame([("a.js", "app.get('/a', f)"), ("node_modules/b.js", "app.get('/b', f)"), ("c.js", None)], "path string, content string").createOrReplaceTempView("some_files")
    sql.register(spark)
    got = spark.sql("SELECT method, path_pattern, source_line FROM routes(TABLE(some_files), 'express')").collect()
    assert [tuple(r) for r in got] == [("GET", "/a", 1)]
    store = CatalogStore(spark, str(tmp_path))
    store.touch("GET", "/t")
    sql.views(store, "shop")
    assert spark.sql("SELECT path_pattern, call_count FROM shop_endpoints").first() == ("/t", 1) and spark.table("shop_fields").count() == 0
