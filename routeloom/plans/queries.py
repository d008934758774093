"""Registered queries over the driver's tables and their oracle SQL. Keys follow the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.functions import content, paths
from routeloom.operators import catalog, fold, infer, report
from routeloom.plans import adapters as A
from routeloom.plans import source_queries, state_queries, store_queries, vector_queries
from routeloom.sources.scratch import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation columns of events that need no body (pruned: bodies are never read)."""
    return A.pairs_events(spark, sf_dir).select("seq", "observed_at", "method", "raw_path", paths.normalize_path(F.col("raw_path")).alias("path_pattern"), F.lit("rest").alias("protocol"), "status_code", "latency_ms", F.col("req_headers").alias("header_names"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation log of orders, materialised once as a store would; equal plans share it."""
    return infer.observe(A.pairs_orders(spark, sf_dir)).cache()


@query("p1_segment_rules", f"WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS s FROM documents) SELECT s AS segment, {A.SEGMENT_SQL} AS pattern, count(*) AS n FROM s GROUP BY 1, 2")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("segment"))
    return words.groupBy("segment").agg(F.count("*").alias("n")).select("segment", paths.normalize_segment(F.col("segment")).alias("pattern"), "n")


@query("p2_normalize_path", f"SELECT page_id, raw_path, {A.path_sql('raw_path')} AS path_pattern FROM (SELECT page_id, {A.PAGE_RAW_SQL} AS raw_path FROM pages)")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_paths(spark, sf_dir).select("page_id", "raw_path", paths.normalize_path(F.col("raw_path")).alias("path_pattern"))


@query("p3_likely_id", f"SELECT s AS segment, ({A.SEGMENT_SQL}) = '{{id}}' AS is_id, count(*) AS n FROM (SELECT unnest(string_split({A.PAGE_RAW_SQL}, '/')) AS s FROM pages) GROUP BY 1, 2")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = A.page_paths(spark, sf_dir).select(F.explode(F.split("raw_path", "/", -1)).alias("segment"))
    return one.groupBy("segment").agg(F.count("*").alias("n")).select("segment", paths.is_likely_id(F.col("segment")).alias("is_id"), "n")


@query("p4_framework_path", r"SELECT n_nationkey, regexp_replace(regexp_replace(regexp_replace(p, ':([A-Za-z_][A-Za-z0-9_]*)', '{\1}', 'g'), '<([A-Za-z_][A-Za-z0-9_]*)>', '{\1}', 'g'), '/{2,}', '/', 'g') AS path FROM (SELECT n_nationkey, '//n' || n_regionkey || '/:id_' || n_nationkey || '//<' || lower(n_name) || '>/x' AS p FROM nation)")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("//n"), F.col("n_regionkey").cast("string"), F.lit("/:id_"), F.col("n_nationkey").cast("string"), F.lit("//<"), F.lower("n_name"), F.lit(">/x"))
    return A.table(spark, sf_dir, "nation").select("n_nationkey", paths.framework_path(p).alias("path"))


@query("p5_dialect_path", r"SELECT n_nationkey, regexp_replace(regexp_replace('/n' || n_nationkey || '/<int:pk>/<slug>', '<(?:[A-Za-z_]+:)?([A-Za-z_][A-Za-z0-9_]*)>', '{\1}', 'g'), '/{2,}', '/', 'g') AS django, '/n' || n_nationkey || '/{id}/{param}' AS codeigniter, '/n' || n_nationkey || '/{id}/x' AS zend FROM nation")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("/n"), F.col("n_nationkey").cast("string"))
    return A.table(spark, sf_dir, "nation").select(
        "n_nationkey", paths.dialect_path(F.concat(base, F.lit("/<int:pk>/<slug>")), "django").alias("django"),
        paths.dialect_path(F.concat(base, F.lit("/(:num)/(:any)")), "codeigniter").alias("codeigniter"), paths.dialect_path(F.concat(base, F.lit("[/:id]/x")), "zend").alias("zend"),
    )


@query("p6_file_route", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '/n' || n_nationkey || '/{id}' WHEN 1 THEN '/n' || n_nationkey ELSE '/n' || n_nationkey || '/{rest}' END AS route, CASE WHEN n_nationkey % 3 = 0 THEN 'POST' END AS method FROM nation")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    file = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("server/api/n"), n, F.lit("/[id].post.ts"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("server/api/n"), n, F.lit("/index.ts"))).otherwise(F.concat(F.lit("server/api/n"), n, F.lit("/[...rest].ts")))
    return A.table(spark, sf_dir, "nation").select("n_nationkey", paths.file_route(file, "server/api").alias("route"), paths.file_method(file).alias("method"))


@query("p7_path_params", f"SELECT page_id, array_to_string(list_transform(range(1, 1 + len(regexp_extract_all(path_pattern, '\\{{([^}}]+)\\}}', 1))::BIGINT), lambda i: 'id'), ',') AS all_params, CASE WHEN contains(path_pattern, '{{id}}') THEN 'id' ELSE '' END AS params FROM (SELECT page_id, {A.path_sql('raw_path')} AS path_pattern FROM (SELECT page_id, {A.PAGE_RAW_SQL} AS raw_path FROM pages))")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.normalize_path(F.col("raw_path"))
    every = F.regexp_extract_all(p, F.lit(r"\{([^}]+)\}"), 1)
    return A.page_paths(spark, sf_dir).select("page_id", F.array_join(every, ",").alias("all_params"), F.array_join(paths.path_params(p), ",").alias("params"))


@query("p8_query_params", f"SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(q, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''))), ','), '') AS params FROM (SELECT page_id, CASE WHEN contains(r, '?') THEN substr(r, strpos(r, '?') + 1) ELSE '' END AS q FROM (SELECT page_id, {A.PAGE_RAW_SQL} AS r FROM pages))")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_paths(spark, sf_dir).select("page_id", F.array_join(F.array_sort(paths.query_params(F.col("raw_path"))), ",").alias("params"))


@query("p9_url_template", r"SELECT n_nationkey, '/n' || n_nationkey || '/{{id}}/x' AS postman, '/n' || n_nationkey || '/:id/x' AS bruno, '/n' || n_nationkey || '/$id/x' AS shell, '/n' || n_nationkey || '/{id}/x' AS back FROM nation")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/{id}/x"))
    to = {s: paths.url_template(p, s) for s in ("postman", "bruno", "shell")}
    return A.table(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(s) for s, c in to.items()], paths.postman_pattern(F.concat(F.lit("{{baseUrl}}"), to["postman"])).alias("back"))


@query("p11_slug", "SELECT n_nationkey, 'GET-' || replace(n_name, '_', '-') || '-id' AS slug FROM nation")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "nation").select("n_nationkey", paths.slug(F.concat(F.lit("GET /"), "n_name", F.lit("/{id}"))).alias("slug"))


@query("p12_token_path", "SELECT event_id, event_type = 'signup' AS is_token FROM events")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pairs_events(spark, sf_dir).select(F.col("seq").alias("event_id"), paths.is_token_path(paths.normalize_path(F.col("raw_path"))).alias("is_token"))


@query("s2_body_cap", "SELECT event_id, least(strlen(props), 5) AS n FROM events")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pairs_events(spark, sf_dir).select(F.col("seq").alias("event_id"), F.octet_length(content.capped(F.col("resp_body"), 5)).cast("bigint").alias("n"))


@query("s4_capture_filter", f"SELECT page_id, raw_path FROM (SELECT page_id, {A.PAGE_RAW_SQL} AS raw_path FROM pages) WHERE starts_with(raw_path, '/') AND NOT starts_with(split_part(raw_path, '?', 1), '/en/2') AND NOT starts_with(split_part(raw_path, '?', 1), '/fr')")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_paths(spark, sf_dir).where(content.captured(F.col("raw_path"), "/", " /en/2, ,/fr"))


@query("s5_header_names", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'Accept,X-Tenant-Id' ELSE 'X-Tenant-Id' END AS names FROM events")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.size("req_headers") > 1, F.array(F.lit("accept"), F.lit("COOKIE"), F.lit("x-TENANT-id"), F.lit("Host"))).otherwise(F.array(F.lit("sec-fetch-mode"), F.lit("X-tenant-ID"), F.lit("user-agent")))
    return A.pairs_events(spark, sf_dir).select(F.col("seq").alias("event_id"), F.array_join(content.header_names(given), ",").alias("names"))


CT_SQL = "CASE event_id % 8 WHEN 0 THEN 'application/json' WHEN 1 THEN ' Application/JSON; charset=utf-8' WHEN 2 THEN 'application/graphql+x' WHEN 3 THEN 'application/x-www-form-urlencoded' WHEN 4 THEN 'multipart/form-data; boundary=x' WHEN 5 THEN 'text/xml' WHEN 6 THEN 'application/grpc+proto' ELSE '' END"


@query("i1_content_dispatch", f"SELECT event_id, CASE event_id % 8 WHEN 2 THEN 'graphql' WHEN 3 THEN 'form' WHEN 4 THEN 'multipart' WHEN 5 THEN 'xml' WHEN 6 THEN 'grpc' ELSE 'json' END AS kind, {CT_SQL} AS content_type FROM events")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", F.expr(CT_SQL).alias("content_type")).withColumn("kind", content.body_kind(F.col("content_type")))


@query("i3_protocol", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN CASE WHEN event_type = 'view' THEN 'graphql' ELSE 'rest' END WHEN 1 THEN CASE WHEN event_type = 'view' THEN 'graphql' ELSE 'rest' END WHEN 2 THEN 'graphql' WHEN 3 THEN 'form' WHEN 5 THEN 'xml' WHEN 6 THEN 'grpc' ELSE 'rest' END AS protocol FROM events")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_type") == "view", F.lit(b'{"query":"{a}"}')).otherwise(F.col("props").cast("binary"))
    return A.table(spark, sf_dir, "events").select("event_id", content.protocol(F.expr(CT_SQL), body).alias("protocol"))


FORMAT_SQL = r"""CASE WHEN regexp_full_match(s, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'uuid'
 WHEN regexp_full_match(s, '[^@ \t\n\f\r]+@[^@ \t\n\f\r]+\.[^@ \t\n\f\r]+') THEN 'email' WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})') THEN 'date-time'
 WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN starts_with(s, 'http://') OR starts_with(s, 'https://') THEN 'uri'
 WHEN regexp_full_match(s, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') THEN 'ipv4' WHEN strlen(s) >= 2 AND contains(s, ':') AND NOT contains(s, '://') THEN 'ipv6' ELSE '' END"""


@query("i4_string_format", f"SELECT s, {FORMAT_SQL} AS format, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS s FROM documents UNION ALL SELECT url FROM pages) GROUP BY 1, 2")
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = A.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("s")).unionAll(A.table(spark, sf_dir, "pages").select("url"))
    return words.groupBy("s").agg(F.count("*").alias("n")).select("s", content.string_format(F.col("s")).alias("format"), "n")


@query("i5_json_types", f"WITH {A.ORDERS_SQL}, {A.ORDER_FIELDS_SQL} SELECT location, field_path, type_json, count(*) AS n FROM fld GROUP BY 1, 2, 3")
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.field_rows(orders(spark, sf_dir), fold.ENDPOINT).groupBy("location", "field_path", "type_json").agg(F.count("*").alias("n"))


@query("i10_form", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'boolean' WHEN event_id % 5 = 1 THEN 'integer' WHEN event_id % 5 = 2 THEN 'number' WHEN event_id % 5 = 3 THEN 'number' ELSE 'string' END AS type FROM events")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 == 0, "True").when(F.col("event_id") % 5 == 1, F.col("user_id").cast("string")).when(F.col("event_id") % 5 == 2, F.concat(F.col("user_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 5 == 3, "1e3").otherwise(F.col("event_type"))
    return A.table(spark, sf_dir, "events").select("event_id", content.form_type(v).alias("type"))


@query("i11_graphql_op", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'mutation' WHEN 1 THEN 'subscription' WHEN 2 THEN 'query' WHEN 3 THEN 'query' ELSE 'graphql' END AS op FROM events")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(*[F.lit(x) for x in (" Mutation M { a }", "subscription S { a }", "query Q { a }", " { a }", "fragment F on T { a }")]), (F.col("event_id") % 5 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", content.graphql_operation(q).alias("op"))


@query("n1_flatten", f"WITH {A.ORDERS_SQL}, {A.ORDER_FIELDS_SQL} SELECT seq, location, field_path, type_json FROM fld")
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.field_rows(orders(spark, sf_dir), fold.ENDPOINT).select("seq", "location", "field_path", "type_json")


@query("a1_endpoint_rollup", f"WITH {A.EVENTS_SQL} SELECT method, path_pattern, count(*) AS call_count, min(observed_at) AS first_seen, max(observed_at) AS last_seen, 'rest' AS protocol FROM ev GROUP BY 1, 2")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.endpoints(events(spark, sf_dir)).orderBy("path_pattern", "method")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reconcile(fold.endpoints(events(spark, sf_dir)), catalog.dedupe_scanned(A.scanned_nations(spark, sf_dir)))


MERGED_SQL = f"""WITH {A.EVENTS_SQL}, {A.SCANNED_SQL}, obs AS (SELECT method, path_pattern, count(*) AS call_count, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM ev GROUP BY 1, 2),
 cat AS (SELECT coalesce(o.method, s.method) AS method, coalesce(o.path_pattern, s.path_pattern) AS path_pattern, 'rest' AS protocol,
 CASE WHEN s.method IS NOT NULL AND o.method IS NOT NULL THEN 'scan+obs' WHEN s.method IS NOT NULL THEN 'scan' ELSE 'observed' END AS source, coalesce(framework, '') AS framework, coalesce(source_file, '') AS source_file,
 coalesce(source_line, 0) AS source_line, first_seen, last_seen, coalesce(call_count, 0) AS call_count, coalesce(description, '') AS description, coalesce(requires_auth, false) AS requires_auth FROM obs o FULL JOIN ded s ON o.method = s.method AND o.path_pattern = s.path_pattern)"""


@query("a2_source_lattice", f"{MERGED_SQL} SELECT method, path_pattern, source FROM cat")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("method", "path_pattern", "source")


@query("a3_raw_paths", f"WITH {A.EVENTS_SQL} SELECT method, path_pattern, raw_path, count(*) AS seen_count FROM ev GROUP BY 1, 2, 3")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.raw_paths(events(spark, sf_dir))


def presence_sql(ctes: str, log: str, seen: str, key: str, name: str, latest: str = "") -> str:
    """Oracle of A4-A7: ordinal of the first sighting in the key's log, total = n - ordinal + 1."""
    last = f", arg_max({latest}, s.seq) AS {latest}" if latest else ""
    on = " AND ".join(f"s.{k} = o.{k}" for k in key.split(", "))
    cols = ", ".join(f"s.{k}" for k in f"{key}, {name}".split(", "))
    return f"{ctes}, o AS (SELECT {key}, seq, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {log}) SELECT {cols}, count(*) AS seen_count, max(n) - min(r) + 1 AS total_calls{last} FROM {seen} s JOIN o ON {on} AND s.seq = o.seq GROUP BY ALL"


ORDER_CTES = f"WITH {A.ORDERS_SQL}, {A.ORDER_FIELDS_SQL}"
ORDER_LOG = f"(SELECT *, {A.ORDER_FP_SQL} AS fingerprint FROM ord)"


@query("a4_field_confidence", presence_sql(ORDER_CTES, "ord", "fld", "method, path_pattern", "location, field_path", "type_json"))
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fields(orders(spark, sf_dir))


@query("a5_variant_fields", presence_sql(ORDER_CTES, ORDER_LOG, "fld", "method, path_pattern, fingerprint", "location, field_path", "type_json"))
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.variant_fields(orders(spark, sf_dir))


@query("a6_headers", presence_sql(f"WITH {A.EVENTS_SQL}, h AS (SELECT method, path_pattern, seq, 'Accept' AS name FROM ev UNION ALL SELECT method, path_pattern, seq, 'Authorization' FROM ev WHERE user_id % 3 = 0)", "ev", "h", "method, path_pattern", "name"))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.headers(events(spark, sf_dir))


@query("a7_params", presence_sql(f"WITH {A.ORDERS_SQL}, q AS (SELECT method, path_pattern, seq, unnest(['dry', 'v']) AS name FROM ord WHERE contains(raw_path, '?'))", "ord", "q", "method, path_pattern", "name"))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.pairs_orders(spark, sf_dir).select("seq", "method", paths.normalize_path(F.col("raw_path")).alias("path_pattern"), paths.query_params(F.col("raw_path")).alias("param_names"))
    return fold.query_params(obs)


@query("a8_fingerprint", f"WITH {A.ORDERS_SQL} SELECT seq, {A.ORDER_FP_SQL} AS fingerprint FROM ord")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("seq", "fingerprint")


LABEL_SQL = "CASE WHEN starts_with(fingerprint, 'auth:bearer') THEN 'authenticated' WHEN starts_with(fingerprint, 'auth:basic') THEN 'basic-auth' ELSE '' END"


@query("a9_variants", f"WITH {A.ORDERS_SQL} SELECT method, path_pattern, fingerprint, count(*) AS call_count, min(observed_at) AS first_seen, max(observed_at) AS last_seen, {LABEL_SQL} AS label FROM {ORDER_LOG} GROUP BY 1, 2, 3")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.variants(orders(spark, sf_dir))


@query("a10_label", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'authenticated' WHEN 1 THEN 'basic-auth' WHEN 2 THEN 'api-key' WHEN 3 THEN 'token-login' WHEN 4 THEN 'password-login' ELSE '' END AS label FROM events")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = ["auth:bearer|body:a", "auth:basic|body:", "auth:apikey|body:x", "auth:none|body:token", "auth:other|body:email,password", "auth:none|body:password"]
    fp = F.element_at(F.array(*[F.lit(x) for x in fps]), (F.col("event_id") % 6 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", fold.variant_label(fp).alias("label"))


@query("a11_stats", f"{MERGED_SQL} SELECT v.source, count(cat.method) AS n FROM (VALUES ('observed'), ('scan'), ('scan+obs'), ('total')) v(source) LEFT JOIN cat ON cat.source = v.source OR v.source = 'total' GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.source_counts(merged(spark, sf_dir))


@query("a12_overall_confidence", f"SELECT method, path_pattern, location, round(avg(seen_count::DOUBLE / total_calls), 9) AS confidence FROM ({ORACLE_SQL['a4_field_confidence']}) GROUP BY 1, 2, 3")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.overall_confidence(fold.fields(orders(spark, sf_dir))).withColumn("confidence", F.round("confidence", 9))


COVER_SQL = "round(CASE WHEN call_count <= 0 THEN 0.0 ELSE least(call_count / 30.0, 1.0) * CASE source WHEN 'observed' THEN 1.0 WHEN 'scan+obs' THEN 0.6 ELSE 0.35 END END, 9)::DOUBLE"


@query("a13_coverage", f"{MERGED_SQL} SELECT method, path_pattern, {COVER_SQL} AS coverage FROM cat")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("method", "path_pattern", F.round(fold.coverage(F.col("call_count"), F.col("source")), 9).alias("coverage"))


@query("a14_status_codes", f"WITH {A.EVENTS_SQL} SELECT method, path_pattern, array_to_string(list_sort(list(DISTINCT status_code)), ',') AS status_codes FROM (SELECT *, row_number() OVER (PARTITION BY method, path_pattern ORDER BY observed_at DESC, seq DESC) AS r FROM ev) WHERE r <= 100 GROUP BY 1, 2")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.status_codes(events(spark, sf_dir)).withColumn("status_codes", F.array_join(F.col("status_codes").cast("array<string>"), ","))


@query("a15_skeleton_fields", f"WITH e AS ({ORACLE_SQL['a4_field_confidence']}), s AS (SELECT DISTINCT method, path_pattern FROM e WHERE path_pattern LIKE '/groups/ga/%'), x AS (SELECT s.*, 'request' AS location, f AS field_path FROM s, (VALUES ('order'), ('extra')) v(f)) SELECT coalesce(e.method, x.method) AS method, coalesce(e.path_pattern, x.path_pattern) AS path_pattern, coalesce(e.location, x.location) AS location, coalesce(e.field_path, x.field_path) AS field_path, coalesce(seen_count, 0) AS seen_count, coalesce(total_calls, 0) AS total_calls, coalesce(type_json, '{{\"type\":\"string\"}}') AS type_json FROM e FULL JOIN x ON e.method = x.method AND e.path_pattern = x.path_pattern AND e.location = x.location AND e.field_path = x.field_path")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = orders(spark, sf_dir)
    known = fold.fields(obs)
    some = known.select("method", "path_pattern").distinct().where("path_pattern like '/groups/ga/%'")
    late = some.select("*", F.lit("request").alias("location"), F.explode(F.array(F.lit("order"), F.lit("extra"))).alias("field_path"), F.lit('{"type":"string"}').alias("type_json"), F.lit(2**60).alias("born"))
    return catalog.skeleton_fields(late, known, obs)


@query("a16_dedupe", f"WITH {A.SCANNED_SQL} SELECT method, path_pattern, framework, source_file, source_line FROM ded")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dedupe_scanned(A.scanned_nations(spark, sf_dir)).select("method", "path_pattern", "framework", "source_file", "source_line")


@query("f1_list", f"{MERGED_SQL} SELECT method, path_pattern, source, call_count FROM cat WHERE call_count >= 10 AND source = 'observed' AND protocol = 'rest'")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.listed(merged(spark, sf_dir), 10, "observed", "rest").select("method", "path_pattern", "source", "call_count")


@query("f2_export_filter", f"{MERGED_SQL} SELECT method, path_pattern FROM cat WHERE protocol <> 'grpc' AND call_count >= 1")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.exported(merged(spark, sf_dir), 1).select("method", "path_pattern")


@query("f3_lookup", f"{MERGED_SQL} SELECT method, path_pattern, source, call_count FROM cat WHERE method = 'GET' AND path_pattern = '/view/{{id}}'")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lookup(merged(spark, sf_dir), "get", "/view/{id}").select("method", "path_pattern", "source", "call_count")


@query("f4_fields_by_location", f"SELECT * FROM ({ORACLE_SQL['a4_field_confidence']}) WHERE location = 'request'")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.fields_at(fold.fields(orders(spark, sf_dir)), "request")


@query("f6_columns", f"{MERGED_SQL}, c AS (SELECT *, {COVER_SQL} AS cover FROM cat) SELECT method, path_pattern AS path, CASE WHEN source_file = '' THEN '' WHEN source_line > 0 THEN regexp_replace(source_file, '^.*/', '') || ':' || source_line ELSE regexp_replace(source_file, '^.*/', '') END AS file, CASE WHEN requires_auth THEN 'yes' ELSE '-' END AS auth, CASE WHEN call_count <= 0 THEN 'not yet seen' WHEN cover < 0.3 THEN 'low coverage' ELSE '' END AS note, '' AS \"OWNER\" FROM c")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.columns(merged(spark, sf_dir), ["method", "path", "file", "auth", "note", "owner"])


@query("f7_coverage_bar", f"{MERGED_SQL}, c AS (SELECT *, {COVER_SQL} AS cover FROM cat) SELECT method, path_pattern AS path, repeat('█', floor(cover * 8 + 0.5)::INT) || repeat('░', 8 - floor(cover * 8 + 0.5)::INT) || ' ' || lpad(round_even(cover * 100, 0)::INT::VARCHAR, 3, ' ') || '%' AS bar FROM c")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.columns(merged(spark, sf_dir), ["method", "path", "bar"])


@query("f10_recent", f"WITH {A.EVENTS_SQL} SELECT method, path_pattern, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY method, path_pattern ORDER BY observed_at DESC, seq DESC) AS rank FROM ev) WHERE rank <= 20")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.newest(events(spark, sf_dir), 20).select("method", "path_pattern", "seq", "rank")


@query("f12_status_text", f"WITH {A.EVENTS_SQL} SELECT DISTINCT status_code, CASE status_code WHEN 200 THEN 'OK' WHEN 500 THEN 'Internal Server Error' END AS text FROM ev")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("status_code").distinct().withColumn("text", report.status_text(F.col("status_code")))


@query("f13_header_placeholder", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Bearer {{token}}' WHEN 1 THEN '{{api_key}}' WHEN 2 THEN 'application/json' ELSE '{{x_tenant_id}}' END AS value FROM nation")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("Authorization", "X-Api-Key", "Accept", "X-Tenant-ID")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return A.table(spark, sf_dir, "nation").select("n_nationkey", report.header_placeholder(name).alias("value"))


@query("j1_reconcile", f"{MERGED_SQL} SELECT * FROM cat")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).drop("tags", "deprecated")


@query("j2_new_updated", f"WITH {A.EVENTS_SQL}, {A.SCANNED_SQL}, o AS (SELECT DISTINCT method, path_pattern FROM ev) SELECT count(*) FILTER (o.method IS NULL) AS new, count(*) FILTER (o.method IS NOT NULL) AS updated FROM ded LEFT JOIN o USING (method, path_pattern)")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.new_and_updated(A.scanned_nations(spark, sf_dir), events(spark, sf_dir))


@query("j4_export_rows", f"WITH a AS ({ORACLE_SQL['a4_field_confidence']}), v AS ({ORACLE_SQL['a9_variants']}), f AS (SELECT method, path_pattern, count(*) AS n_fields, sum(seen_count)::BIGINT AS fields_seen FROM a GROUP BY 1, 2), w AS (SELECT method, path_pattern, count(*) AS n_variants, sum(call_count)::BIGINT AS call_count FROM v GROUP BY 1, 2) SELECT * FROM f JOIN w USING (method, path_pattern)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = orders(spark, sf_dir)
    rows = catalog.export_rows(fold.endpoints(obs), obs)
    return rows.select("method", "path_pattern", F.size("fields").cast("bigint").alias("n_fields"), F.aggregate("fields", F.lit(0).cast("bigint"), lambda a, x: a + x["seen_count"]).alias("fields_seen"), F.size("variants").cast("bigint").alias("n_variants"), "call_count")


@query("j5_requires_auth", f"SELECT method, path_pattern, count(*) > 1 AS many, bool_or(starts_with(fingerprint, 'auth:b')) AS auth FROM ({ORACLE_SQL['a9_variants']}) GROUP BY 1, 2")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.variants(orders(spark, sf_dir)).groupBy("method", "path_pattern").agg((F.count("*") > 1).alias("many"), F.bool_or(~F.col("fingerprint").startswith("auth:none")).alias("auth"))


@query("m1_delete_cascade", f"WITH {A.EVENTS_SQL} SELECT method, path_pattern, count(*) AS seen FROM ev WHERE NOT (method = 'GET' AND path_pattern = '/view/{{id}}') GROUP BY 1, 2")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's own delete: every view follows."""
    s = store_queries.store(spark)
    s.record(infer.observe(A.pairs_events(spark, sf_dir)))
    s.delete("get", "/view/{id}")
    return s.endpoints().select("method", "path_pattern", F.col("call_count").alias("seen"))


SCHEMA_SQL = f"""WITH e AS (SELECT method, path_pattern, field_path, (seen_count::DOUBLE / total_calls >= 0.9)::INT AS need FROM ({ORACLE_SQL['a4_field_confidence']}) WHERE location = 'request'),
 w AS (SELECT method, path_pattern, max(need) FILTER (field_path = 'note') AS note, max(need) FILTER (field_path = 'rush') AS rush, max(need) FILTER (field_path = 'ship.done') AS ship FROM e GROUP BY 1, 2)
 SELECT method, path_pattern, '{{"properties": {{' || concat_ws(', ', CASE WHEN note IS NOT NULL THEN '"note": {{"type": "string"}}' END, '"order": {{"type": "integer"}}', CASE WHEN rush IS NOT NULL THEN '"rush": {{"type": "boolean"}}' END,
 CASE WHEN ship IS NOT NULL THEN '"ship": {{"properties": {{"done": {{"type": "boolean"}}, "on": {{"format": "date", "type": "string"}}}}, ' || CASE WHEN ship = 1 THEN '"required": ["done", "on"], ' ELSE '' END || '"type": "object"}}' END)
 || '}}, "required": [' || concat_ws(', ', CASE WHEN note = 1 THEN '"note"' END, '"order"', CASE WHEN rush = 1 THEN '"rush"' END) || '], "type": "object"}}' AS schema FROM w"""


@query("n2_schema_doc", SCHEMA_SQL)
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested request schema of every endpoint as JSON, built in Arrow batches on the executors."""
    import json

    from routeloom.export.schema import nest

    @F.pandas_udf("string")
    def build(packed: pd.Series) -> pd.Series:
        return packed.map(lambda rows: json.dumps(nest(json.loads(rows), "request"), sort_keys=True))

    rows = F.to_json(F.collect_list(F.struct("location", "field_path", "seen_count", "total_calls", "type_json")))
    packed = fold.fields(orders(spark, sf_dir)).groupBy("method", "path_pattern").agg(rows.alias("rows"))
    return packed.select("method", "path_pattern", build("rows").alias("schema"))


@query("g1_spec_diff", f"WITH {A.EVENTS_SQL}, {A.SCANNED_SQL} SELECT DISTINCT d.method, d.path_pattern FROM ded d WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.method = d.method AND e.path_pattern = d.path_pattern)")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that an add-only merge would add: an anti join on (path, method)."""
    have = events(spark, sf_dir).select("method", "path_pattern").distinct()
    return A.scanned_nations(spark, sf_dir).select("method", "path_pattern").distinct().join(have, ["method", "path_pattern"], "left_anti")


@query("g2_collection_diff", f"WITH {A.SCANNED_SQL}, old AS (SELECT method, path_pattern, description AS body FROM ded WHERE method = 'GET'), new AS (SELECT method, path_pattern, '' AS body FROM ded) SELECT n.method, n.path_pattern, CASE WHEN o.method IS NULL THEN 'added' WHEN o.body = n.body THEN 'unchanged' ELSE 'conflict' END AS state FROM new n LEFT JOIN old o USING (method, path_pattern)")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way diff of items by key and body text: one outer join."""
    rows = catalog.dedupe_scanned(A.scanned_nations(spark, sf_dir))
    old = rows.where("method = 'GET'").select("method", "path_pattern", F.col("description").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("old") == "", "unchanged").otherwise("conflict")
    return rows.select("method", "path_pattern").join(old, ["method", "path_pattern"], "left").select("method", "path_pattern", state.alias("state"))


K_SQL = '"content": {"application/json": {"schema": {"properties": {"k": {"type": "integer"}}, "required": ["k"], "type": "object"}}}'
OPENAPI_SQL = f"""WITH {A.EVENTS_SQL}, {A.SCANNED_SQL},
 v AS (SELECT method, path_pattern, CASE WHEN user_id % 3 = 0 THEN 'bearer' ELSE 'none' END AS auth, method <> 'GET' AS sends, count(*) AS n, min(observed_at) AS f, max(status_code) AS code FROM ev GROUP BY 1, 2, 3, 4),
 x AS (SELECT method, path_pattern, sends, max(code) AS code, count(*) AS c, string_agg('{{"call_count": ' || n || ', "fingerprint": "auth:' || auth || '|body:' || CASE WHEN sends THEN 'k' ELSE '' END || '"' || CASE WHEN auth = 'bearer' THEN ', "label": "authenticated"' ELSE '' END
  || CASE WHEN sends THEN ', "requestBody": {{{K_SQL}, "required": true}}' ELSE '' END || '}}', ', ' ORDER BY f, auth) AS vs FROM v GROUP BY 1, 2, 3)
 SELECT path_pattern AS path, lower(method) AS method, '{{' || CASE WHEN coalesce(description, '') <> '' THEN '"description": "' || description || '", ' ELSE '' END || '"parameters": [{{"in": "path", "name": "id", "required": true, "schema": {{"type": "string"}}}}], '
 || CASE WHEN sends THEN '"requestBody": {{{K_SQL}, "required": true}}, ' ELSE '' END || CASE WHEN code = 500 THEN '"responses": {{"500": {{"description": "Internal Server Error"}}}}' ELSE '"responses": {{"200": {{{K_SQL}, "description": "OK"}}}}' END
 || CASE WHEN coalesce(requires_auth, false) THEN ', "security": [{{"bearerAuth": []}}]' ELSE '' END || CASE WHEN c > 1 THEN ', "x-variants": [' || vs || ']' ELSE '' END || '}}' AS operation
 FROM x LEFT JOIN ded USING (method, path_pattern)"""


@query("e1_openapi", OPENAPI_SQL)
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the OpenAPI document of the event traffic, one row each."""
    from routeloom.export import documents

    state = settled(fold.states(infer.observe(A.pairs_events(spark, sf_dir))))
    rows = catalog.state_rows(catalog.reconcile(fold.endpoints_of(state), catalog.dedupe_scanned(A.scanned_nations(spark, sf_dir))), state)
    return store_queries.operations(documents.fragments(rows, "openapi", documents.Options(min_calls=1)))


SCAN_SQL = """SELECT 'GET' AS method, '/nations/' || n_nationkey || '/{id}' AS path_pattern, 'express' AS framework, 'src/f' || n_nationkey || '.js' AS source_file, 1 AS source_line FROM nation WHERE n_nationkey % 2 = 0
 UNION ALL SELECT 'POST', '/nations', 'express', min('src/f' || n_nationkey || '.js'), 2 FROM nation WHERE n_nationkey % 2 = 0
 UNION ALL SELECT 'GET', '/n/' || n_nationkey || '/{id}', 'fastapi', 'src/f' || n_nationkey || '.py', 1 FROM nation WHERE n_nationkey % 2 = 1"""


@query("x_scan", SCAN_SQL)
def x_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes extracted from generated source files, one for each nation and framework family."""
    from routeloom.scan import runner

    n = F.col("n_nationkey").cast("string")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("app.get('/nations/"), n, F.lit("/:id', f)\napp.post('/nations', g)\n"))).otherwise(F.concat(F.lit("@app.get(\"/n/"), n, F.lit("/{id}\")\ndef f(id: int):\n    pass\n")))
    files = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("src/f"), n, F.when(F.col("n_nationkey") % 2 == 0, ".js").otherwise(".py")).alias("path"), text.alias("content"))
    return runner.scan(files, ["express", "fastapi"]).select("method", "path_pattern", "framework", "source_file", "source_line")


store_queries.a15_midlog(orders, ORACLE_SQL["a4_field_confidence"])
for _part in (source_queries, vector_queries, store_queries, state_queries):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
