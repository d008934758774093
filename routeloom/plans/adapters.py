"""The driver's tables as captured pairs and scanned routes, in Spark and as SQL views for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom import types



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair for each event; the event type is the first path word, the user the second."""
    method = F.when(F.col("event_type").isin("click", "purchase"), "POST").when(F.col("event_type") == "signup", "PUT").otherwise("GET")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("seq"), F.col("ts").alias("observed_at"), method.alias("method"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("raw_path"),
        F.lit("application/json").alias("req_content_type"), F.lit("application/json; charset=utf-8").alias("resp_content_type"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.floor("value").cast("bigint").alias("latency_ms"),
        F.when(method != "GET", F.col("props").cast("binary")).alias("req_body"), F.col("props").cast("binary").alias("resp_body"),
        F.when(F.col("user_id") % 3 == 0, F.array(F.lit("Accept"), F.lit("Authorization"))).otherwise(F.array(F.lit("Accept"))).alias("req_headers"),
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, raw_path): a page's URL without scheme, host and fragment."""
    raw = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^[a-z]+://[^/?]*", "")
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw_path"))


def pairs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    return page_paths(spark, sf_dir).select(
        F.col("page_id").cast("bigint").alias("seq"), ts.alias("observed_at"), F.lit("GET").alias("method"), "raw_path", F.lit("").alias("req_content_type"),
        F.lit("text/html").alias("resp_content_type"), F.lit(200).alias("status_code"), F.lit(1).cast("bigint").alias("latency_ms"),
        F.lit(None).cast("binary").alias("req_body"), F.lit(None).cast("binary").alias("resp_body"), F.array(F.lit("Accept")).alias("req_headers"),
    )


def order_body() -> Column:
    """JSON whose fields depend on status and priority."""
    parts = [
        F.lit('{"order":'), F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(',"rush":true')).otherwise(F.lit("")),
        F.when(F.col("o_orderstatus") == "F", F.lit(',"ship":{"done":true,"on":"1998-01-02"}')).otherwise(F.lit("")),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), F.lit(',"note":"low"')).otherwise(F.lit("")), F.lit("}"),
    ]
    return F.concat(*parts)


def pairs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 20 customer groups; bodies with really optional fields."""
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("seq"), ts.alias("observed_at"), F.lit("POST").alias("method"),
        F.concat(F.lit("/groups/g"), F.translate((F.col("o_custkey") % 20).cast("string"), "0123456789", "abcdefghij"), F.lit("/orders/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("?dry=1&dry=2&v=")).otherwise(F.lit(""))).alias("raw_path"),
        F.lit("application/json").alias("req_content_type"), F.lit("application/json").alias("resp_content_type"),
        F.when(F.col("o_orderstatus") == "P", 202).otherwise(201).alias("status_code"), (F.col("o_orderkey") % 100).cast("bigint").alias("latency_ms"),
        order_body().cast("binary").alias("req_body"), F.lit(b'{"ok":true}').alias("resp_body"),
        F.when(F.col("o_custkey") % 4 == 0, F.array(F.lit("Authorization:basic"))).when(F.col("o_custkey") % 4 == 1, F.array(F.lit("Authorization"), F.lit("X-Tenant"))).otherwise(F.array().cast("array<string>")).alias("req_headers"),
    )


def scanned_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes a scan might have found: some match the traffic of events and orders, some do not."""
    empty = spark.createDataFrame([], types.SCANNED).schema
    rows = table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.when(F.col("n_nationkey") == 0, "/view/{id}").when(F.col("n_nationkey") == 1, "/click/{id}").when(F.col("n_nationkey") == 3, "/purchase/{id}")
        .otherwise(F.concat(F.lit("/nations/n"), F.col("n_regionkey").cast("string"))).alias("path_pattern"),
        F.lit("rest").alias("protocol"), F.when(F.col("n_nationkey") % 3 == 0, "fastapi").otherwise("express").alias("framework"),
        F.concat(F.lit("src/f"), F.col("n_nationkey").cast("string"), F.lit(".x")).alias("source_file"), F.col("n_nationkey").cast("int").alias("source_line"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit('{"type":"object","properties":{"a":{"type":"string"},"b":{"type":"integer"}}}')).alias("req_schema"), F.lit(None).cast("string").alias("resp_schema"),
        F.array().cast("array<int>").alias("status_codes"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise("").alias("description"),
        F.array().cast("array<string>").alias("tags"), F.array().cast(empty["params"].dataType).alias("params"), F.lit(False).alias("deprecated"), (F.col("n_nationkey") % 2 == 1).alias("requires_auth"),
    )
    return rows


SEGMENT_SQL = """CASE WHEN regexp_full_match(s, '[0-9]+') OR regexp_full_match(s, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')
 OR (strlen(s) = 26 AND regexp_full_match(s, '[0-9A-HJKMNP-TV-Z]{26}'))
 OR (strlen(s) >= 21 AND regexp_full_match(s, '[\\p{L}\\p{Nd}]+') AND NOT regexp_full_match(s, '\\p{L}+'))
 OR regexp_full_match(s, '[a-z][a-z0-9-]*-[0-9]+') OR (strlen(s) >= 3 AND regexp_full_match(s, '[A-Z][A-Z0-9-]+'))
 OR (s NOT IN ('me','self','current','latest','new','first','last','all','count','search') AND strlen(s) > 32) THEN '{id}' ELSE s END"""


def path_sql(raw: str) -> str:
    return f"CASE WHEN {raw} = '' THEN '/' ELSE array_to_string(list_transform(string_split({raw}, '/'), lambda s: {SEGMENT_SQL}), '/') END"


PAGE_RAW_SQL = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]*', '')"
EVENT_METHOD_SQL = "CASE WHEN event_type IN ('click','purchase') THEN 'POST' WHEN event_type = 'signup' THEN 'PUT' ELSE 'GET' END"
EVENTS_SQL = f"""ev AS (SELECT *, {path_sql('raw_path')} AS path_pattern FROM (SELECT event_id AS seq, ts AS observed_at, {EVENT_METHOD_SQL} AS method,
 '/' || event_type || '/' || user_id AS raw_path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, props, user_id FROM events))"""
ORDERS_SQL = f"""ord AS (SELECT *, {path_sql('raw_path')} AS path_pattern FROM (SELECT o_orderkey AS seq, to_timestamp(1704067200 + o_orderkey) AT TIME ZONE 'UTC' AS observed_at,
 'POST' AS method, '/groups/g' || translate((o_custkey % 20)::VARCHAR, '0123456789', 'abcdefghij') || '/orders/' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '?dry=1&dry=2&v=' ELSE '' END AS raw_path,
 CASE WHEN o_orderstatus = 'P' THEN 202 ELSE 201 END AS status_code,
 o_orderpriority = '1-URGENT' AS rush, o_orderstatus = 'F' AS ship, o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS note,
 CASE o_custkey % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'bearer' ELSE 'none' END AS auth, o_custkey FROM orders))"""
ORDER_FP_SQL = "'auth:' || auth || '|body:' || CASE WHEN note THEN 'note,' ELSE '' END || 'order' || CASE WHEN rush THEN ',rush' ELSE '' END || CASE WHEN ship THEN ',ship' ELSE '' END"
ORDER_FIELDS_SQL = f"""fld AS (SELECT method, path_pattern, {ORDER_FP_SQL} AS fingerprint, seq, location, field_path, type_json FROM ord, (VALUES
 ('request', 'order', '{{"type":"integer"}}', 0), ('request', 'rush', '{{"type":"boolean"}}', 1), ('request', 'ship.done', '{{"type":"boolean"}}', 2),
 ('request', 'ship.on', '{{"type":"string","format":"date"}}', 2), ('request', 'note', '{{"type":"string"}}', 3), ('response', 'ok', '{{"type":"boolean"}}', 0)) v(location, field_path, type_json, k)
 WHERE k = 0 OR (k = 1 AND rush) OR (k = 2 AND ship) OR (k = 3 AND note))"""
SCANNED_SQL = """scn AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE n_nationkey WHEN 0 THEN '/view/{id}' WHEN 1 THEN '/click/{id}' WHEN 3 THEN '/purchase/{id}'
 ELSE '/nations/n' || n_regionkey END AS path_pattern, CASE WHEN n_nationkey % 3 = 0 THEN 'fastapi' ELSE 'express' END AS framework, 'src/f' || n_nationkey || '.x' AS source_file, n_nationkey AS source_line,
 CASE WHEN n_nationkey % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS score,
 CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE '' END AS description, n_nationkey % 2 = 1 AS requires_auth FROM nation),
ded AS (SELECT * FROM scn QUALIFY row_number() OVER (PARTITION BY method, path_pattern ORDER BY score DESC, framework, source_file, source_line) = 1)"""
