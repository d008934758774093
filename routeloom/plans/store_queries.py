"""Queries that run the catalogue's own functions over generated shops (traffic and scans), and their oracle SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom import types
from routeloom.export import documents, merge
from routeloom.operators import catalog, fold, infer, report
from routeloom.operators.ranks import with_rank
from routeloom.plans import adapters as A
from routeloom.plans.source_queries import quoted
from routeloom.scan import runner
from routeloom.sources import capture, scratch, tree
from routeloom.streaming import fold as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
JSON = "application/json"


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    return scratch.folder(spark, "catalogue")


def store(spark: SparkSession, name: str = "default", root: str = "") -> catalog.CatalogStore:
    return catalog.CatalogStore(spark, root or folder(spark), name)


def filled(s: str) -> Column:
    return F.replace(F.lit(s), F.lit("@k"), F.col("s_suppkey").cast("string"))


# seq within the shop, method, path, status, request body, response body, headers
CALLS = [
    (1, "POST", "/shop@k/items/41", 201, '{"name":"a","age":3}', '{"id":1}', ["Authorization", "Cookie", "x-tenant"]), (2, "POST", "/shop@k/items/42", 201, '{"name":"b"}', '{"id":2}', []),
    (3, "GET", "/shop@k/items?page=2", 200, None, "[1]", ["Accept"]), (4, "GET", "/health", 200, None, "{}", []),
]
ITEMS, LIST, SECRET, LOGIN = "/shop@k/items/{id}", "/shop@k/items?page=2", "/shop@k/secret", "/shop@k/auth/login"


def shop_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pairs of all shops, without the health checks."""
    one = [
        F.struct(
            (F.col("s_suppkey") * 10 + n).cast("bigint").alias("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("s_suppkey") * 10 + n).alias("observed_at"), F.lit(m).alias("method"), filled(p).alias("raw_path"),
            F.lit(JSON).alias("req_content_type"), F.lit(JSON).alias("resp_content_type"), F.lit(c).alias("status_code"), F.lit(n).cast("bigint").alias("latency_ms"),
            F.lit(a).cast("string").cast("binary").alias("req_body"), F.lit(b).cast("binary").alias("resp_body"), F.array(*[F.lit(h) for h in hs]).cast("array<string>").alias("req_headers"),
        )
        for n, m, p, c, a, b, hs in CALLS
    ]
    pairs = A.table(spark, sf_dir, "supplier").select(F.explode(F.array(*one)).alias("x")).select("x.*")
    return capture.capture(pairs, ignore="/health")


def shop_scan(spark: SparkSession, sf_dir: str, said: str = "Secret @k") -> DataFrame:
    """Two routes of each shop that only a scan knows."""
    params = spark.createDataFrame([], types.SCANNED).schema["params"].dataType
    one = [
        F.struct(
            F.lit(m).alias("method"), filled(p).alias("path_pattern"), F.lit("rest").alias("protocol"), F.lit("express").alias("framework"), filled("src/s@k.js").alias("source_file"), F.lit(line).alias("source_line"),
            F.lit(None).cast("string").alias("req_schema"), F.lit(None).cast("string").alias("resp_schema"), F.array().cast("array<int>").alias("status_codes"), filled(d).alias("description"),
            F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"), F.array().cast(params).alias("params"), F.lit(False).alias("deprecated"), F.lit(True).alias("requires_auth"),
        )
        for m, p, line, d, tags in (("GET", SECRET, 3, said, ["x"] if said else []), ("POST", LOGIN, 9, "", []))
    ]
    return A.table(spark, sf_dir, "supplier").select(F.explode(F.array(*one)).alias("x")).select("x.*")


def shop_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = scratch.settled(fold.states(infer.observe(shop_calls(spark, sf_dir))))
    return catalog.state_rows(catalog.reconcile(fold.endpoints_of(state), shop_scan(spark, sf_dir)), state)


def filled_sql(columns: str, rows: list[tuple]) -> str:
    """Literal rows for each supplier; texts with the key filled in."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    texts = {n for n, *vs in zip(names, *rows, strict=True) if any(isinstance(v, str) for v in vs)}
    return f"SELECT {', '.join(f'replace({n}, $$@k$$, s_suppkey::VARCHAR) AS {n}' if n in texts else n for n in names)} FROM supplier, (VALUES {values}) v({', '.join(names)})"


OBJ = '{"properties": {%s}, "required": [%s], "type": "object"}'
AGE, NAME = '"age": {"type": "integer"}', '"name": {"type": "string"}'
REQ, FULL, SHORT = '{"properties": {' + AGE + ", " + NAME + '}, "required": ["name"], "type": "object"}', OBJ % (f"{AGE}, {NAME}", '"age", "name"'), OBJ % (NAME, '"name"')
RESP = OBJ % ('"id": {"type": "integer"}', '"id"')
CONTENT = '"content": {"application/json": {"schema": %s}}'
BODY = '{' + CONTENT + ', "required": true}'


@F.pandas_udf(T.StringType())
def sorted_keys(text: pd.Series) -> pd.Series:
    """JSON with its keys in order, for comparison."""
    return text.map(lambda x: json.dumps(json.loads(x), sort_keys=True))


def operations(found: DataFrame) -> DataFrame:
    return found.where(F.col("method").isin(documents.VERBS)).select("path", F.lower("method").alias("method"), sorted_keys("text").alias("operation"))


@query("e1_openapi_shops", filled_sql("path method operation", [
    (ITEMS, "post", '{"parameters": [{"in": "path", "name": "id", "required": true, "schema": {"type": "string"}}], "requestBody": ' + BODY % REQ + ', "responses": {"201": {' + CONTENT % RESP + ', "description": "Created"}}, "x-variants": [{"call_count": 1, "fingerprint": "auth:bearer|body:age,name", "label": "authenticated", "requestBody": '
     + BODY % FULL + '}, {"call_count": 1, "fingerprint": "auth:none|body:name", "requestBody": ' + BODY % SHORT + "}]}"),
    (LIST, "get", '{"parameters": [{"in": "query", "name": "page", "required": false, "schema": {"type": "string"}}], "responses": {"200": {"description": "OK"}}}'),
    (SECRET, "get", '{"description": "Secret @k", "responses": {"200": {"description": "OK"}}, "security": [{"bearerAuth": []}], "tags": ["x"]}'), (LOGIN, "post", '{"responses": {"200": {"description": "OK"}}}'),
]))
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(documents.fragments(shop_export(spark, sf_dir), "openapi"))


@query("e2_swagger", filled_sql("path method operation", [
    (ITEMS, "post", '{"consumes": ["application/json"], "parameters": [{"in": "path", "name": "id", "required": true, "type": "string"}, {"in": "body", "name": "body", "required": true, "schema": ' + REQ + '}], "produces": ["application/json"], "responses": {"201": {"description": "Created", "schema": ' + RESP + "}}}"),
    (LIST, "get", '{"responses": {"200": {"description": "OK"}}}'), (SECRET, "get", '{"description": "Secret @k", "responses": {"200": {"description": "OK"}}, "security": [{"bearerAuth": []}], "tags": ["x"]}'), (LOGIN, "post", '{"responses": {"200": {"description": "OK"}}}'),
]))
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(documents.fragments(shop_export(spark, sf_dir), "swagger"))


@query("e3_postman", filled_sql("name url headers body", [
    ("POST " + ITEMS + " (authenticated)", "{{baseUrl}}/shop@k/items/{{id}}", "Authorization=Bearer {{token}}, X-Tenant={{x_tenant}}, Content-Type=application/json", '{"age": 0, "name": ""}'),
    ("POST " + ITEMS + " (variant 2)", "{{baseUrl}}/shop@k/items/{{id}}", "Authorization=Bearer {{token}}, X-Tenant={{x_tenant}}, Content-Type=application/json", '{"name": ""}'),
    ("GET " + LIST, "{{baseUrl}}/shop@k/items?page=2", "Accept=application/json", "null"), ("GET " + SECRET, "{{baseUrl}}/shop@k/secret", "Authorization=Bearer {{token}}", "null"), ("POST " + LOGIN, "{{baseUrl}}/shop@k/auth/login", "", "null"),
]))
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.from_json("text", "request struct<header: array<struct<key: string, value: string>>, url: struct<raw: string>, body: struct<raw: string>>")["request"]
    heads = F.array_join(F.transform(request["header"], lambda h: F.concat(h["key"], F.lit("="), h["value"])), ", ")
    found = documents.fragments(shop_export(spark, sf_dir), "postman")
    return found.select("name", request["url"]["raw"].alias("url"), heads.alias("headers"), sorted_keys(F.coalesce(request["body"]["raw"], F.lit("null"))).alias("body"))


@query("e4_curl", filled_sql("title command", [
    ("POST " + ITEMS, '# set id before running\ncurl -s -X POST "$BASE_URL/shop@k/items/$id" \\\n  -H "Content-Type: application/json" \\\n  -H "Accept: application/json" \\\n  -d \'{\n    "age": 0,\n    "name": ""\n  }\''),
    ("GET " + LIST, 'curl -s -X GET "$BASE_URL/shop@k/items?page=2" \\\n  -H "Accept: application/json"'), ("GET " + SECRET, 'curl -s -X GET "$BASE_URL/shop@k/secret" \\\n  -H "Authorization: Bearer $TOKEN" \\\n  -H "Accept: application/json"'),
    ("POST " + LOGIN, 'curl -s -X POST "$BASE_URL/shop@k/auth/login" \\\n  -H "Accept: application/json"'),
]))
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.fragments(shop_export(spark, sf_dir), "curl").select(F.col("name").alias("title"), F.col("text").alias("command"))


@query("e5_httpie", filled_sql("title command", [
    ("POST " + ITEMS, '# set id=<value>\nhttp POST "$BASE_URL/shop@k/items/$id" Accept:application/json Content-Type:application/json <<\'EOF\'\n{\n  "age": 0,\n  "name": ""\n}\nEOF'), ("GET " + LIST, 'http GET "$BASE_URL/shop@k/items?page=2" Accept:application/json'),
    ("GET " + SECRET, 'http GET "$BASE_URL/shop@k/secret" "Authorization: Bearer $TOKEN" Accept:application/json'), ("POST " + LOGIN, 'http POST "$BASE_URL/shop@k/auth/login" Accept:application/json'),
]))
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.fragments(shop_export(spark, sf_dir), "httpie").select(F.col("name").alias("title"), F.col("text").alias("command"))


BRUNO_SQL = "WITH b AS (" + filled_sql("path method file head rest", [
    (ITEMS, "POST", "post-shop@k-items-id.bru", "meta {\n  name: POST " + ITEMS + "\n  type: http\n", 'post {\n  url: {{baseUrl}}/shop@k/items/:id\n  body: json\n  auth: none\n}\n\nbody:json {\n  {\n    "age": 0,\n    "name": ""\n  }\n}\n'),
    (LIST, "GET", "get-shop@k-items-page-2.bru", "meta {\n  name: GET " + LIST + "\n  type: http\n", "get {\n  url: {{baseUrl}}/shop@k/items?page=2\n  body: none\n  auth: none\n}\n"),
    (SECRET, "GET", "get-shop@k-secret.bru", "meta {\n  name: GET " + SECRET + "\n  type: http\n", "auth:bearer {\n  token: {{token}}\n}\n\nget {\n  url: {{baseUrl}}/shop@k/secret\n  body: none\n  auth: bearer\n}\n"),
    (LOGIN, "POST", "post-shop@k-auth-login.bru", "meta {\n  name: POST " + LOGIN + "\n  type: http\n", "post {\n  url: {{baseUrl}}/shop@k/auth/login\n  body: none\n  auth: none\n}\n"),
]) + ") SELECT file, head || '  seq: ' || row_number() OVER (ORDER BY path, method) || chr(10) || '}' || chr(10) || chr(10) || rest AS content FROM b"


@query("e6_bruno", BRUNO_SQL)
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.with_seq(documents.fragments(shop_export(spark, sf_dir), "bruno")).select(F.col("name").alias("file"), F.col("text").alias("content"))


def shop_store(spark: SparkSession, sf_dir: str) -> catalog.CatalogStore:
    s = store(spark)
    s.record(infer.observe(shop_calls(spark, sf_dir)), "first")
    return s


SHOW = ["method", "path_pattern", "source", "call_count", "description"]
SHOP = [("POST", ITEMS, "observed", 2, ""), ("GET", LIST, "observed", 1, "")]
SCAN = [("GET", SECRET, "scan", 0, "Secret @k"), ("POST", LOGIN, "scan", 0, "")]
shown = lambda rows: filled_sql("method path_pattern source call_count description", rows)


@query("m1_delete_replayed", "SELECT * FROM (" + shown(SHOP) + ") WHERE NOT (method = 'POST' AND path_pattern = '/shop1/items/{id}') UNION ALL " + shown(SCAN) + " WHERE NOT (method = 'GET' AND s_suppkey = 2)")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shop_store(spark, sf_dir)
    s.add_scan(shop_scan(spark, sf_dir))
    s.delete("post", "/shop1/items/{id}")
    s.delete("GET", "/shop2/secret")
    s.record(infer.observe(shop_calls(spark, sf_dir)), "first")  # a replay of the first batch
    return s.endpoints().select(SHOW)


@query("m2_clear", shown(SCAN))
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shop_store(spark, sf_dir)
    s.override_path("GET", "/a", "/b")
    s.clear()
    s.add_scan(shop_scan(spark, sf_dir))
    return s.endpoints().join(s.overrides().selectExpr("method", "raw_prefix AS path_pattern"), ["method"], "left_anti").select(SHOW)


@query("m3_annotate", "SELECT method, path_pattern, CASE WHEN path_pattern = '/shop1/items/{id}' THEN 'first' ELSE '' END AS description, CASE WHEN path_pattern = '/shop1/items/{id}' THEN 'y,z' ELSE '' END AS tags FROM (" + shown(SHOP) + ")")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shop_store(spark, sf_dir)
    s.annotate("post", "/shop1/items/{id}", "first", ["x"])
    s.annotate("POST", "/shop1/items/{id}", "", ["y", "z"])
    s.annotate("POST", "/shop1/items/{id}", "", None)
    return s.endpoints().select("method", "path_pattern", "description", F.array_join("tags", ",").alias("tags"))


@query("m4_override", "SELECT 'GET' AS method, '/s' || s_suppkey || '/' AS raw_prefix, '/s' || s_suppkey || '/{two}' AS override_pattern FROM supplier UNION ALL SELECT 'PUT', '/s' || s_suppkey || '/', '/s' || s_suppkey || '/{one}' FROM supplier WHERE s_suppkey % 2 = 0")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides for each supplier's prefix, recorded as tables; the latest of a (method, prefix) holds."""
    s, suppliers = store(spark), A.table(spark, sf_dir, "supplier")
    prefix = F.concat(F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit("/"))
    for method, name, rows in (("get", "{one}", suppliers), ("put", "{one}", suppliers.where("s_suppkey % 2 = 0")), ("GET", "{two}", suppliers)):
        s.override_paths(rows.select(F.lit(method).alias("method"), prefix.alias("raw_prefix"), F.concat(prefix, F.lit(name)).alias("override_pattern")))
    return s.overrides()


@query("m5_label", "SELECT method, path_pattern, fingerprint, CASE WHEN path_pattern = '/shop1/items/{id}' AND fingerprint = 'auth:none|body:name' THEN 'mine' ELSE label END AS label FROM (" + filled_sql("method path_pattern fingerprint label", [
    ("POST", ITEMS, "auth:bearer|body:age,name", "authenticated"), ("POST", ITEMS, "auth:none|body:name", ""), ("GET", LIST, "auth:none|body:", "")]) + ")")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shop_store(spark, sf_dir)
    s.label_variant("post", "/shop1/items/{id}", "auth:none|body:name", "mine")
    s.record(infer.observe(shop_calls(spark, sf_dir)), "first")
    return s.variants().select("method", "path_pattern", "fingerprint", "label")


@query("m6_rescan", shown(SHOP + [("GET", SECRET, "scan", 0, ""), ("POST", LOGIN, "scan", 0, "")]))
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan replaces texts, also with blanks and over annotations; counters stay."""
    s = shop_store(spark, sf_dir)
    s.add_scan(shop_scan(spark, sf_dir))
    s.annotate("GET", "/shop1/secret", "by hand")
    s.add_scan(shop_scan(spark, sf_dir, ""))
    return s.endpoints().select(SHOW)


@query("m7_touch", "SELECT method, path_pattern, CASE WHEN path_pattern = '/shop1/items/{id}' THEN 'scan+obs' ELSE source END AS source, call_count + CASE WHEN path_pattern = '/shop1/items/{id}' THEN 2 ELSE 0 END AS call_count, description FROM (" + shown(SHOP) + ") UNION ALL SELECT 'PUT', '/new', 'scan', 1, ''")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shop_store(spark, sf_dir)
    s.touch("post", "/shop1/items/{id}", source="scan")
    s.touch("POST", "/shop1/items/{id}")
    s.touch("put", "/new", source="scan")
    return s.endpoints().select(SHOW)


@query("s6_catalogues", shown(SHOP) + " UNION ALL SELECT * FROM (" + shown(SCAN) + ") x")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues under one root do not see each other."""
    root = folder(spark)
    a, b = store(spark, catalog.host_name("https://A.example:1"), root), store(spark, catalog.dir_name("/src/My App"), root)
    a.record(infer.observe(shop_calls(spark, sf_dir)))
    b.add_scan(shop_scan(spark, sf_dir))
    return a.endpoints().select(SHOW).unionByName(b.endpoints().select(SHOW))


@query("s1_s3_stream", filled_sql("method path_pattern call_count headers", [("POST", ITEMS, 2, "Authorization,X-Tenant"), ("GET", LIST, 1, "Accept")]))
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from files in bounded micro-batches, through the capture filter, run twice over one checkpoint."""
    top = folder(spark)
    one = [F.array(*[F.lit(h) for h in hs]).cast("array<string>") for *_, hs in CALLS]
    raw = shop_calls(spark, sf_dir).withColumn("req_headers", F.element_at(F.array(*one), (F.col("seq") % 10).cast("int")))
    raw.repartition(3).write.parquet(f"{top}/in")
    s = store(spark, root=top)
    for _ in range(2):
        streams.ingest_stream(streams.pair_stream(spark, f"{top}/in", max_files=1), s, f"{top}/state").awaitTermination()
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("header_names")))), ",")
    return s.observations().groupBy("method", "path_pattern").agg(F.count("*").alias("call_count"), names.alias("headers"))


@query("f8_filters", shown([SHOP[0]]))
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.listed(catalog.reconcile(fold.endpoints(infer.observe(shop_calls(spark, sf_dir))), shop_scan(spark, sf_dir)), 2, "observed", "rest").select(SHOW)


@query("f9_field_order", "SELECT location, field_path, row_number() OVER (ORDER BY location, field_path)::INTEGER AS rank FROM (VALUES ('request', 'age'), ('request', 'name'), ('response', 'id')) v(location, field_path)")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = fold.fields(infer.observe(shop_calls(spark, sf_dir))).where("path_pattern = '/shop1/items/{id}'")
    return with_rank(fields, "location", "field_path").select("location", "field_path", "rank")


@query("f11_scan_order", "SELECT method, path_pattern, row_number() OVER (ORDER BY path_pattern, method)::INTEGER AS rank FROM (" + shown(SCAN) + ")")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rank(shop_scan(spark, sf_dir), "path_pattern", "method").select("method", "path_pattern", "rank")


@query("n6_schema_score", f"WITH {A.SCANNED_SQL} SELECT source_file, score FROM scn")
def n6(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = catalog.schema_score(F.col("req_schema"), F.col("resp_schema"), F.size("params"), F.col("description"), F.col("tags"))
    return A.scanned_nations(spark, sf_dir).select("source_file", score.alias("score"))


MANIFESTS = {
    "a@k/package.json": '{"dependencies": {"Express": "1", "nuxi": "2"}}', "a@k/go.mod": "module x\n", "b@k/go.mod": "module y\nrequire github.com/labstack/echo/v4", "a@k/mypom.xml": "spring-boot", "a@k/x/pom.xml": "Spring-Boot",
    "a@k/x/y/Cargo.toml": "axum", "a@k/App.csproj": "<Project Sdk=\"Microsoft.NET.Sdk.Web\">", "node_modules/a@k/requirements.txt": "flask", "a@k/build.gradle.kts": "ktor",
}


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*[F.struct(filled(p).alias("path"), filled(t).alias("content")) for p, t in MANIFESTS.items()])
    return A.table(spark, sf_dir, "supplier").select(F.explode(parts).alias("f")).select("f.*")


@query("s10_manifests", filled_sql("path", [(p,) for p in MANIFESTS if "mypom" not in p and "Cargo" not in p and "node_modules" not in p]))
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.manifests(manifest_files(spark, sf_dir)).select("path")


@query("d1_detect", "SELECT unnest(['express', 'nuxt', 'go-stdlib', 'go-echo', 'spring', 'aspnet-minimal', 'ktor']) AS framework")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.detect(manifest_files(spark, sf_dir))


@query("j3_type_lookup", filled_sql("framework type_name schema", [
    ("spring", "User@k", '{"type": "object", "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 9}, "age": {"type": "integer"}}, "required": ["name"]}'), ("fastapi", "Item@k", '{"type": "object", "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["id", "tags"]}')]))
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"A@k.java": "public class User@k {\n  @NotBlank\n  @Size(min = 2, max = 9)\n  private String name;\n  private Integer age;\n}\n", "b@k.py": "class Item@k(BaseModel):\n    id: int\n    tags: List[str]\n"}
    parts = F.array(*[F.struct(filled(p).alias("path"), filled(t).alias("content")) for p, t in texts.items()])
    files = A.table(spark, sf_dir, "supplier").select(F.explode(parts).alias("f")).select("f.*")
    return runner.type_table(files, ["spring", "fastapi"])


@query("s8_tree", "SELECT 'p' || s_suppkey || '/src/s.js' AS path, 'app.get(''/t' || s_suppkey || ''', f)' AS content FROM supplier")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of files, one for each supplier, written by the executors and read back by them; what lies in skipped folders is not."""
    top = f"{folder(spark)}/projects"
    tree.write_tree(filled_files(spark, sf_dir, {"p@k/src/s.js": "app.get('/t@k', f)", "p@k/node_modules/x/s.js": "no", "p@k/src/dist/t.js": "no"}), top)
    return runner.source_files(spark, top)


def filled_files(spark: SparkSession, sf_dir: str, files: dict[str, str]) -> DataFrame:
    parts = F.array(*[F.struct(filled(p).alias("path"), filled(t).alias("content")) for p, t in files.items()])
    return A.table(spark, sf_dir, "supplier").select(F.explode(parts).alias("f")).select("f.*")


# one project for each supplier, of one of three kinds, side by side: names and templates that differ only by project
PROJECTS = {
    0: {"p@k/package.json": '{"dependencies": {"express": "1"}}', "p@k/a.js": "app.get('/x@k', f)", "p@k/main.py": '@app.get("/no@k")\ndef f():\n    pass\n'},
    1: {"p@k/requirements.txt": "fastapi", "p@k/app/models.py": "class Item(BaseModel):\n    only@k: int\n", "p@k/app/main.py": '@app.post("/items")\ndef f(item: Item):\n    pass\n', "p@k/b.js": "app.get('/no@k', f)"},
    2: {"p@k/Web.csproj": "microsoft.aspnetcore.mvc", "p@k/Web/UserController.cs": "public class UserController : ApiController\n{\n  [HttpGet]\n  public User ListAll() {}\n}", "p@k/Web/WebApiConfig.cs": 'MapHttpRoute(name: "D", routeTemplate: "v@k/{controller}/{action}")'},
}
PROJECTS_SQL = """SELECT 'p' || s_suppkey AS project, CASE s_suppkey % 3 WHEN 1 THEN 'POST' ELSE 'GET' END AS method, CASE s_suppkey % 3 WHEN 0 THEN '/x' || s_suppkey WHEN 1 THEN '/items' ELSE 'v' || s_suppkey || '/user/listall' END AS path_pattern,
 CASE s_suppkey % 3 WHEN 0 THEN 'express' WHEN 1 THEN 'fastapi' ELSE 'aspnet-mvc' END AS framework,
 CASE WHEN s_suppkey % 3 = 1 THEN '{"type": "object", "properties": {"only' || s_suppkey || '": {"type": "integer"}}, "required": ["only' || s_suppkey || '"]}' END AS req_schema FROM supplier"""


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = lambda files: F.array(*[F.struct(filled(p).alias("path"), filled(t).alias("content")) for p, t in files.items()])
    kind = F.when(F.col("s_suppkey") % 3 == 0, parts(PROJECTS[0])).when(F.col("s_suppkey") % 3 == 1, parts(PROJECTS[1])).otherwise(parts(PROJECTS[2]))
    return A.table(spark, sf_dir, "supplier").select(F.explode(kind).alias("f")).select("f.*")


@query("d1_projects", PROJECTS_SQL)
def d1_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, templates and types by project: none crosses into another."""
    return runner.scan_projects(project_files(spark, sf_dir)).select("project", "method", "path_pattern", "framework", "req_schema")


@query("s9_scan_tree", f"SELECT method, path_pattern, framework, source_file FROM (SELECT *, CASE framework WHEN 'express' THEN project || '/a.js' WHEN 'fastapi' THEN project || '/app/main.py' ELSE project || '/Web/UserController.cs' END AS source_file FROM ({PROJECTS_SQL})) QUALIFY row_number() OVER (PARTITION BY method, path_pattern ORDER BY source_file) = 1")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same projects as a tree of files: listed, pruned, opened once each; one catalogue takes one row of each (method, path)."""
    top = f"{folder(spark)}/projects"
    tree.write_tree(project_files(spark, sf_dir).repartition("path"), top)  # a small table is one task, its tree is not small
    return runner.scan_tree(spark, top).select("method", "path_pattern", "framework", "source_file")


A15_SQL = """WITH e AS ({a4}), s AS (SELECT DISTINCT method, path_pattern FROM e WHERE location = 'request'), x AS (SELECT s.*, 'request' AS location, f AS field_path FROM s, (VALUES ('order'), ('extra')) v(f)),
 n AS (SELECT method, path_pattern, count(*) AS since FROM ord WHERE seq >= 500 GROUP BY 1, 2)
 SELECT coalesce(e.method, x.method) AS method, coalesce(e.path_pattern, x.path_pattern) AS path_pattern, coalesce(e.location, x.location) AS location, coalesce(e.field_path, x.field_path) AS field_path, coalesce(seen_count, 0) AS seen_count,
 greatest(coalesce(total_calls, 0), CASE WHEN x.method IS NULL THEN 0 ELSE coalesce(since, 0) END) AS total_calls, coalesce(type_json, '{{"type":"string"}}') AS type_json
 FROM e FULL JOIN x ON e.method = x.method AND e.path_pattern = x.path_pattern AND e.location = x.location AND e.field_path = x.field_path LEFT JOIN n ON n.method = coalesce(e.method, x.method) AND n.path_pattern = coalesce(e.path_pattern, x.path_pattern)"""


def a15_midlog(orders: Callable[[SparkSession, str], DataFrame], a4_sql: str) -> None:
    """A15 with scans in the middle of the log: fields that traffic has since, before, or never."""
    @query("a15_midlog", f"WITH {A.ORDERS_SQL}, " + A15_SQL.format(a4=a4_sql).removeprefix("WITH "))
    def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
        obs = orders(spark, sf_dir)
        known = fold.fields(obs)
        some = known.where("location = 'request'").select("method", "path_pattern").distinct()
        scan = some.select("*", F.lit("request").alias("location"), F.explode(F.array(F.lit("order"), F.lit("extra"))).alias("field_path"), F.lit('{"type":"string"}').alias("type_json"), F.lit(500).cast("bigint").alias("born"))
        return catalog.skeleton_fields(scan, known, obs)
