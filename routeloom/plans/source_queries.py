"""One query for each extractor (X1-X27) over generated source trees, and their oracle SQL.

Every supplier stands for a small project: the files below with ``@k`` replaced by its key. The
expected routes are written down by hand, from what each framework's routing rules say.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.plans import adapters as A
from routeloom.scan import runner, sql

COLUMNS = ["method", "path_pattern", "source_file", "source_line", "description", "deprecated", "requires_auth", "req_schema", "resp_schema", "tags", "params"]
USER = '{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}}, "required": ["name"]}'
BOTH = '{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}}, "required": ["name", "age"]}'


def row(method: str, path: str, file: str, line: int, description: str = "", deprecated: bool = False, auth: bool = False, req: str | None = None, resp: str | None = None, tags: str = "", params: str = "") -> tuple:
    return method, path, file, line, description, deprecated, auth, req, resp, tags, params


def crud(base: str, one: str, file: str, line: int, **rest: Any) -> list[tuple]:
    """The six rows of a resource."""
    return [row("GET", base, file, line, **rest), row("POST", base, file, line, **rest), *[row(m, one, file, line, **rest) for m in ("GET", "PUT", "PATCH", "DELETE")]]


# framework -> (files, expected routes)
CASES: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "express": (
        {"src/s@k.js": "const app = express()\n/**\n * Lists items.\n * @deprecated\n */\napp.get('/s@k/items/:itemId', list)\nrouter.post(`/s@k/items`, (req, res) => {\n  const body = z.object({ name: z.string(), age: z.number() })\n})\n",
         "node_modules/s@k.js": "app.get('/s@k/never', f)", "src/t@k.ts": "app.put('/s@k/t', (req: Request<{}, any, NewItem>, res) => 1)\n\n\n"},
        [row("GET", "/s@k/items/{itemId}", "src/s@k.js", 6, "Lists items.", True, req='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "number"}}}'),
         row("POST", "/s@k/items", "src/s@k.js", 7, req='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "number"}}}'),
         row("PUT", "/s@k/t", "src/t@k.ts", 1, req='{"type": "object", "description": "TS type: NewItem"}')],
    ),
    "fastify": (
        {"s@k.js": "app.register(routes, { prefix: '/v@k' })\nfastify.post('/u/:id', { schema: { body: {\n  name: { type: 'string' },\n  age: { type: 'integer' }\n} } }, f)\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\nfastify.route({ method: 'DELETE', url: '/z' })\n"},
        [row("POST", "/v@k/u/{id}", "s@k.js", 2, req='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}}}'), row("DELETE", "/v@k/z", "s@k.js", 25)],
    ),
    "koa": (
        {"s@k.ts": "const r = new Router({ prefix: '/api@k' })\nr.get('/u/:id', f)\nr.patch('/u/:id/name', g)\n"},
        [row("GET", "/api@k/u/{id}", "s@k.ts", 2), row("PATCH", "/api@k/u/{id}/name", "s@k.ts", 3)],
    ),
    "nestjs": (
        {"s@k.controller.ts": "@ApiTags('cats')\n@Controller('cats@k')\n@UseGuards(AuthGuard)\nexport class CatsController {\n  @Get(':id')\n  one(@Param('id') id: string): Promise<CatDto> {\n  }\n  @Post()\n  async add(\n    @Query('dry') dry: boolean,\n    @Body() body: CatDto,\n  ): Promise<CatDto[]> {\n  }\n}\nexport class CatDto {\n  @IsString()\n  name: string;\n  @IsOptional()\n  @IsEmail()\n  mail?: string;\n}\n"},
        [row("GET", "/cats@k/{id}", "s@k.controller.ts", 6, auth=True, tags="cats", params="path:id", resp='{"type": "object", "properties": {"name": {"type": "string"}, "mail": {"type": "string", "format": "email"}}, "required": ["name"]}'),
         row("POST", "/cats@k", "s@k.controller.ts", 9, tags="cats", params="query:dry", req='{"type": "object", "properties": {"name": {"type": "string"}, "mail": {"type": "string", "format": "email"}}, "required": ["name"]}',
             resp='{"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}, "mail": {"type": "string", "format": "email"}}, "required": ["name"]}}')],
    ),
    "nextjs": (
        {"pages/api/s@k/[id].ts": "if (req.method === 'DELETE') {}\nif (req.method === 'PUT') {}", "src/app/api/(in)/s@k/[...slug]/route.ts": "\nexport async function GET() {}\nexport const POST = f\n", "pages/s@k.tsx": "export default 1"},
        [row("DELETE", "/api/s@k/{id}", "pages/api/s@k/[id].ts", 1), row("PUT", "/api/s@k/{id}", "pages/api/s@k/[id].ts", 1),
         row("GET", "/api/s@k/{slug}", "src/app/api/(in)/s@k/[...slug]/route.ts", 2), row("POST", "/api/s@k/{slug}", "src/app/api/(in)/s@k/[...slug]/route.ts", 3)],
    ),
    "nuxt": (
        {"server/api/s@k/[id].get.ts": "", "server/routes/s@k.post.js": "", "pages/s@k/index.vue": ""},
        [row("GET", "/api/s@k/{id}", "server/api/s@k/[id].get.ts", 1), row("POST", "/s@k", "server/routes/s@k.post.js", 1), row("GET", "/s@k", "pages/s@k/index.vue", 1)],
    ),
    "hapi": (
        {"s@k.js": "server.route({\n  method: ['GET', 'POST'],\n  path: '/s@k/{id?}',\n})\n"},
        [row("GET", "/s@k/{id}", "s@k.js", 1), row("POST", "/s@k/{id}", "s@k.js", 1)],
    ),
    "fastapi": (
        {"s@k/main.py": 'router = APIRouter(prefix="/v@k")\n@router.post("/items", response_model=User, tags=["items"])\ndef make(item: User, who=Depends(current_user)):\n    """Makes an item."""\n\n\n\n\n\n\n\n\n\n@router.get("/items/{item_id}", deprecated=True)\nasync def one(item_id: int):\n    pass\n',
         "models.py": "class User(BaseModel):\n    name: str\n    age: Optional[int] = None\n"},
        [row("POST", "/v@k/items", "s@k/main.py", 2, "Makes an item.", auth=True, req=USER, resp=USER, tags="items"), row("GET", "/v@k/items/{item_id}", "s@k/main.py", 14, deprecated=True)],
    ),
    "flask": (
        {"s@k.py": "bp = Blueprint('b', url_prefix='/b@k')\n@bp.route('/u/<int:id>', methods=['GET', 'PUT'])\n@login_required\ndef f(id): pass\n\n\n\n\n\n\n\n\n@bp.route('/h')\ndef h(): pass\n"},
        [row("GET", "/b@k/u/{id}", "s@k.py", 2, auth=True), row("PUT", "/b@k/u/{id}", "s@k.py", 2, auth=True), row("GET", "/b@k/h", "s@k.py", 13)],
    ),
    "django": (
        {"s@k/urls.py": "path('s@k/<int:pk>/', V.as_view())\nrouter.register(r'r@k', S)\n"},
        [row("GET", "/s@k/{pk}/", "s@k/urls.py", 1), row("POST", "/s@k/{pk}/", "s@k/urls.py", 1), *crud("/r@k/", "/r@k/{pk}", "s@k/urls.py", 2)],
    ),
    "go-chi": (
        {"s@k.go": 'package a\ntype User struct {\n\tName string `json:"name"`\n\tAge int `json:"age,omitempty"`\n}\nfunc routes() {\n\tr.Route("/api@k", func(r chi.Router) {\n\t\tr.Post("/u/{id}", add)\n\t})\n}\nfunc add(w http.ResponseWriter, r *http.Request) {\n\tvar u User\n\tjson.NewDecoder(r.Body).Decode(&u)\n}\n', "s@k_vendor/vendor/x.go": 'r.Get("/s@k/no", h)'},
        [row("POST", "/api@k/u/{id}", "s@k.go", 8, req=USER)],
    ),
    "go-gin": (
        {"s@k.go": 'type User struct {\n\tName string `json:"name"`\n\tAge *int `json:"age"`\n}\ng := r.Group("/v@k")\ng.POST("/u/:id", add)\ng.GET("/f/*path", h)\nfunc add(c *gin.Context) {\n\tvar u User\n\tc.ShouldBindJSON(&u)\n}\n'},
        [row("POST", "/v@k/u/{id}", "s@k.go", 6, req='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer", "nullable": true}}, "required": ["name"]}'), row("GET", "/v@k/f/{path}", "s@k.go", 7)],
    ),
    "go-echo": (
        {"s@k.go": 'e.GET("/e@k/:id", h)\ne.DELETE("/e@k/:id", h)\n'},
        [row("GET", "/e@k/{id}", "s@k.go", 1), row("DELETE", "/e@k/{id}", "s@k.go", 2)],
    ),
    "go-fiber": (
        {"s@k.go": 'app.Delete("/f@k/:id", h)\napp.All("/f@k", h)\n'},
        [row("DELETE", "/f@k/{id}", "s@k.go", 1), row("ALL", "/f@k", "s@k.go", 2)],
    ),
    "go-stdlib": (
        {"s@k.go": 'mux.HandleFunc("/m@k", h)\nhttp.Handle("PUT /n@k/{id}", h)\n'},
        [row("GET", "/m@k", "s@k.go", 1), row("POST", "/m@k", "s@k.go", 1), row("PUT", "/n@k/{id}", "s@k.go", 2)],
    ),
    "aspnet-mvc": (
        {"C@k/User@kController.cs": '[Authorize]\n[RoutePrefix("api/[controller]")]\npublic class User@kController : ApiController\n{\n  /// <summary>Gets one</summary>\n  [HttpGet("{id:int}")]\n  public ActionResult<User> Get(int id) {}\n\n  [AllowAnonymous]\n  [Route("reset")]\n  [HttpPut]\n  public IHttpActionResult Reset([FromBody] User x) {}\n}\n',
         "C@k/Plain@kController.cs": "public class Plain@kController : ApiController\n{\n  [HttpPost]\n  public IHttpActionResult Run() {}\n}\n", "App_Start/WebApiConfig.cs": 'MapHttpRoute(name: "D", routeTemplate: "api/{controller}/{action}/{id}")',
         "Models.cs": "public class User {\n  public string name { get; set; }\n  public int? age { get; set; }\n}\n"},
        [row("GET", "api/user@k/{id}", "C@k/User@kController.cs", 7, "Gets one", auth=True, tags="User@k", resp='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer", "nullable": true}}, "required": ["name"]}'),
         row("PUT", "api/user@k/reset", "C@k/User@kController.cs", 12, tags="User@k", req='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer", "nullable": true}}, "required": ["name"]}'),
         row("POST", "api/plain@k/run", "C@k/Plain@kController.cs", 4, tags="Plain@k")],
    ),
    "aspnet-minimal": (
        {"P@k/Program.cs": 'var g = app.MapGroup("/v@k");\ng.MapPost("/u/{id:int}", (User u) => 1).RequireAuthorization();\napp.MapGet("/w@k", () => 1);\n', "Models.cs": "public record User {\n  public string name { get; set; }\n  public int age { get; set; }\n}\n"},
        [row("POST", "/v@k/u/{id}", "P@k/Program.cs", 2, auth=True, req=BOTH), row("GET", "/w@k", "P@k/Program.cs", 3)],
    ),
    "spring": (
        {"p@k/UserController.java": '@RequestMapping("/api@k")\nclass UserController {\n@GetMapping("/u/{id:[0-9]+}")\npublic ResponseEntity<User> get(@PathVariable Long id) {\n}\n@PostMapping("/u")\n@PreAuthorize("x")\npublic ResponseEntity<User> add(@RequestBody User u) {\n}\n', "User.java": "public class User {\n  @NotNull\n  private String name;\n  private Integer age;\n}\n"},
        [row("GET", "/api@k/u/{id}", "p@k/UserController.java", 3, auth=True, resp=USER), row("POST", "/api@k/u", "p@k/UserController.java", 6, auth=True, req=USER, resp=USER)],
    ),
    "rails": (
        {"a@k/config/routes.rb": "Rails.application.routes.draw do\n  namespace :admin@k do\n    resources :posts, only: [:index, :show]\n    get 'stats'\n  end\nend\n"},
        [row("GET", "/admin@k/posts", "a@k/config/routes.rb", 0), row("GET", "/admin@k/posts/{id}", "a@k/config/routes.rb", 0), row("GET", "/admin@k/stats", "a@k/config/routes.rb", 0)],
    ),
    "sinatra": (
        {"s@k.rb": "# Shows one\n# deprecated\nget '/s@k/:id' do\nend\npost '/s@k' do\nend\n"},
        [row("GET", "/s@k/{id}", "s@k.rb", 3, "Shows one", True), row("POST", "/s@k", "s@k.rb", 5)],
    ),
    "laravel": (
        {"l@k/routes/api.php": "Route::get('/s@k/{id?}', 'C')->middleware('auth');\nRoute::apiResource('photos@k', 'P');\n"},
        [row("GET", "/s@k/{id}", "l@k/routes/api.php", 1, auth=True), *[r for r in crud("/photos@k", "/photos@k/{photos@k}", "l@k/routes/api.php", 2, auth=True)]],
    ),
    "symfony": (
        {"C@k.php": "#[Route('/api@k')]\nclass C {\n  #[Route('/u/{id<\\d+>}', methods: ['GET', 'PUT'])]\n  public function f() {}\n\n\n\n\n\n  #[IsGranted('X')]\n  #[Route('/v')]\n"},
        [row("GET", "/api@k/u/{id}", "C@k.php", 3), row("PUT", "/api@k/u/{id}", "C@k.php", 3), row("GET", "/api@k/v", "C@k.php", 11, auth=True)],
    ),
    "codeigniter": (
        {"a@k/Config/Routes.php": "$routes->group('api@k', function($routes) {\n$routes->get('u/(:num)', 'U::s');\n});\n$routes->post('x@k/(:any)', 'X');\n"},
        [row("GET", "/api@k/u/{id}", "a@k/Config/Routes.php", 2), row("POST", "/x@k/{param}", "a@k/Config/Routes.php", 4)],
    ),
    "zend": (
        {"m@k/config/module.config.php": "'route' => '/users@k[/:id]',\n'route' => '/posts@k/:slug/comments',\n"},
        [row("GET", "/users@k/{id}", "m@k/config/module.config.php", 1), row("GET", "/posts@k/{slug}/comments", "m@k/config/module.config.php", 2)],
    ),
    "actix": (
        {"s@k.rs": '#[derive(Deserialize)]\npub struct User {\n    name: String,\n    age: Option<u8>,\n}\n#[post("/a@k/{id:[0-9]+}")]\nasync fn add(u: web::Json<User>) {}\n\n\n\n\n\n\nweb::resource("/r@k").route(web::get().to(f))\n'},
        [row("POST", "/a@k/{id}", "s@k.rs", 6, req='{"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer", "nullable": true}}, "required": ["name"]}'), row("GET", "/r@k", "s@k.rs", 14)],
    ),
    "axum": (
        {"s@k.rs": '#[derive(Serialize, Deserialize)]\nstruct User {\n    name: String,\n    age: i32,\n}\nlet app = Router::new().route("/x@k/:id", post(add));\nasync fn add(Json(u): Json<User>) {}\n'},
        [row("POST", "/x@k/{id}", "s@k.rs", 6, req=BOTH)],
    ),
    "ktor": (
        {"R@k.kt": 'routing {\n route("/api@k") {\n  route("/u") {\n   get("/{id?}") {\n   }\n  }\n  post {\n   call.receive<User>()\n  }\n }\n}\n', "M.kt": "data class User(\n  val name: String,\n  val age: Int = 1\n)\n"},
        [row("GET", "/api@k/u/{id}", "R@k.kt", 4, req=USER), row("POST", "/api@k", "R@k.kt", 7, req=USER)],
    ),
}


def project(spark: SparkSession, sf_dir: str, files: dict[str, str]) -> DataFrame:
    """(path, content): the files of every supplier's project; those without a key in their path once."""
    key = F.col("s_suppkey").cast("string")
    fill = lambda s: F.replace(F.lit(s), F.lit("@k"), key)
    parts = F.array(*[F.struct(fill(p).alias("path"), fill(t).alias("content")) for p, t in files.items()])
    return A.table(spark, sf_dir, "supplier").select(F.explode(parts).alias("f")).select("f.*").dropDuplicates(["path"])


def quoted(v: Any) -> str:
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def expected_sql(rows: list[tuple]) -> str:
    texts = {"source_line", "deprecated", "requires_auth"}
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    columns = ", ".join(c if c in texts else f"replace({c}, '@k', s_suppkey::VARCHAR) AS {c}" for c in COLUMNS)
    return f"SELECT {columns} FROM supplier, (VALUES {values}) v({', '.join(COLUMNS)})"


def scanned(spark: SparkSession, sf_dir: str, framework: str) -> DataFrame:
    found = runner.scan(project(spark, sf_dir, CASES[framework][0]), [framework])
    params = F.array_join(F.transform("params", lambda p: F.concat(p["in"], F.lit(":"), p["name"])), ",")
    return found.select(*[F.array_join("tags", ",").alias(c) if c == "tags" else params.alias(c) if c == "params" else F.col(c) for c in COLUMNS])


QUERIES = {f"x{n:02d}_{name.replace('-', '_')}": (lambda spark, sf_dir, name=name: scanned(spark, sf_dir, name)) for n, name in enumerate(CASES, 1)}
ORACLE_SQL = {f"x{n:02d}_{name.replace('-', '_')}": expected_sql(rows) for n, (name, (_, rows)) in enumerate(CASES.items(), 1)}


def by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 27 extractors through SQL's routes(TABLE(files), framework)."""
    sql.register(spark)
    parts = []
    for k, (framework, (files, _)) in enumerate(CASES.items()):
        project(spark, sf_dir, files).createOrReplaceTempView(f"files_of_{k}")
        parts.append(f"SELECT method, path_pattern, framework, source_file, source_line FROM routes(TABLE(files_of_{k}), '{framework}') WHERE error IS NULL")
    return spark.sql(" UNION ".join(parts))


def table_function_sql() -> str:
    """Conventional routes of controllers need their project's template, which one file does not tell: there the controller's own name stands."""
    return " UNION ".join(f"SELECT method, regexp_replace(path_pattern, '^api/(plain[0-9]+)/run$', '\\1') AS path_pattern, '{framework}' AS framework, source_file, source_line FROM ({expected_sql(rows)})" for framework, (_, rows) in CASES.items())


QUERIES["x_table_function"], ORACLE_SQL["x_table_function"] = by_table_function, table_function_sql()
