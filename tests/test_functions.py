import pytest
from pyspark.sql import functions as F

from routeloom.functions import content, paths
from routeloom.operators import catalog, report


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_segments(spark):
    ids = ["42", "0", "550e8400-e29b-41d4-a716-446655440000", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "abc-42", "ORD-9821", "ABC123", "aVeryLongStringThatIsDefinitelyMoreThan32Characters"]
    same = ["me", "self", "current", "search", "users", "orders", "a", "v1", "", "٤٢", "42\n"]
    assert apply(spark, paths.normalize_segment, ids) == ["{id}"] * len(ids)
    assert apply(spark, paths.normalize_segment, same) == same
    assert apply(spark, paths.is_likely_id, ["42", "me"]) == [True, False]


def test_paths(spark):
    cases = {"": "/", "/": "/", "/users/42": "/users/{id}", "/users/42/orders": "/users/{id}/orders", "/users/me/settings": "/users/me/settings", "/orders/ORD-9821/items": "/orders/{id}/items",
             "/api/users?page=1&limit=10": "/api/users?page=1&limit=10", "/api/users?page=1&limit=10&sort=created_at": "/api/{id}"}
    assert apply(spark, paths.normalize_path, list(cases)) == list(cases.values())
    assert apply(spark, lambda c: paths.normalize_path(c, strip_query=True), ["/a/1?x=2"]) == ["/a/{id}"]


@pytest.mark.parametrize("name,given,want", [
    ("zend", "/users[/:id]", "/users/{id}"), ("zend", "/posts/:slug/comments", "/posts/{slug}/comments"), ("codeigniter", "/a/(:num)", "/a/{id}"), ("codeigniter", "/a/(:any)", "/a/{param}"),
    ("ktor", "/users/{id?}", "/users/{id}"), ("ktor", "users", "/users"), ("django", "<int:pk>/", "/{pk}/"), ("actix", "/x/{id:\\d+}", "/x/{id}"), ("laravel", "/u/{id?}", "/u/{id}"),
])
def test_dialects(spark, name, given, want):
    assert apply(spark, lambda c: paths.dialect_path(c, name), [given]) == [want]


def test_path_helpers(spark):
    assert apply(spark, paths.framework_path, ["/users/:userId/posts/:postId", "<param>", "//v1//items"]) == ["/users/{userId}/posts/{postId}", "{param}", "/v1/items"]
    assert apply(spark, paths.query_params, ["/a?x=1&y&x=2&=3", "/a", "/a?"]) == [["x", "y"], [], []]
    assert apply(spark, paths.path_params, ["/a/{x}/{y}/{x}"]) == [["x", "y"]]
    assert apply(spark, paths.is_token_path, ["/api/auth/login", "/login/{id}", "/users", "/", "/{x}"]) == [True, True, False, False, False]
    assert apply(spark, paths.postman_pattern, ["{{baseUrl}}/api/users/{{id}}/posts/{{postId}}"]) == ["/api/users/{id}/posts/{postId}"]
    assert apply(spark, lambda c: paths.url_template(c, "shell"), ["/a/{x}"]) == ["/a/$x"]
    assert apply(spark, lambda c: paths.file_route(c, "pages/api"), ["src/pages/api/users/[id].ts", "pages/api/index.js", "pages/api/[...all].ts"]) == ["/users/{id}", "/", "/{all}"]


def test_content(spark):
    assert apply(spark, content.string_format, ["a@b.com", "550E8400-e29b-41d4-a716-446655440000", "2024-01-15T10:00:00.123Z", "2024-01-15", "https://x", "192.168.1.1", "::1", "12:30", "hello", ""]) == ["email", "uuid", "date-time", "date", "uri", "ipv4", "ipv6", "ipv6", "", ""]
    assert apply(spark, content.form_type, ["TRUE", "30", "98.6", "1e5", "inf", "x", "", "99999999999999999999"]) == ["boolean", "integer", "number", "number", "number", "string", "string", "number"]
    assert apply(spark, lambda c: content.captured(c, "/api", "/api/x, ,/api/y"), ["/api/a?q=/api/x", "/api/x1", "/b"]) == [True, False, False]
    assert apply(spark, content.body_kind, ["application/json; charset=utf-8", "TEXT/XML", None, "multipart/form-data; b=1"]) == ["json", "xml", "json", "multipart"]


def test_report_columns(spark):
    assert apply(spark, report.header_placeholder, ["Authorization", "X-Tenant-ID", "X-Api-Key"]) == ["Bearer {{token}}", "{{x_tenant_id}}", "{{api_key}}"]
    df = spark.createDataFrame([(0.125,), (1.0,), (0.0,)], "c double")
    assert [r[0] for r in df.select(report.bar(F.col("c"))).collect()] == ["█░░░░░░░  12%", "████████ 100%", "░░░░░░░░   0%"]
    assert catalog.host_name("https://user@Api.Example.com:8080/x?y") == "api.example.com"
    assert catalog.dir_name("/srv/My App_1/") == "srv-my-app-1"
