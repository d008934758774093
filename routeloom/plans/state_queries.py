"""Queries over mergeable states, streams' state and deletions by batch, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.operators import catalog, fold, infer
from routeloom.plans import adapters as A
from routeloom.plans.store_queries import folder, store
from routeloom.sources import capture
from routeloom.streaming import fold as streams
from routeloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COLUMNS = ["kind", "method", "path_pattern", "fingerprint", "location", "name", "seen_count", "total_calls", "text"]


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def totals(state: DataFrame) -> DataFrame:
    """A4-A7 and A9 of states in one frame."""
    none = F.lit(None).cast("string")
    field = lambda kind, fp: fold.presence_of(state, kind).select(F.lit(kind).alias("kind"), *fold.ENDPOINT, fp.alias("fingerprint"), "location", F.col("field_path").alias("name"), "seen_count", "total_calls", F.col("type_json").alias("text"))
    named = lambda kind: fold.presence_of(state, kind).select(F.lit(kind).alias("kind"), *fold.ENDPOINT, none.alias("fingerprint"), none.alias("location"), "name", "seen_count", "total_calls", none.alias("text"))
    variant = fold.variants_of(state).select(F.lit("variant").alias("kind"), *fold.VARIANT, none.alias("location"), none.alias("name"), F.col("call_count").alias("seen_count"), F.col("call_count").alias("total_calls"), F.col("label").alias("text"))
    return field("field", none).unionByName(field("variant_field", F.col("fingerprint"))).unionByName(named("header")).unionByName(named("param")).unionByName(variant)


def totals_sql(ctes: str, log: str, fields: str, headers: str, params: str, label: str) -> str:
    """Oracle of ``totals``: total = n - ordinal of the first sighting + 1, in the endpoint's (or variant's) log."""
    one = lambda kind, key, seen, fp, location, text: (
        f"SELECT '{kind}' AS kind, s.method, s.path_pattern, {fp} AS fingerprint, {location} AS location, s.name, count(*) AS seen_count, max(o.n_{key}) - min(o.r_{key}) + 1 AS total_calls, {text} AS text "
        f"FROM {seen} s JOIN o ON s.seq = o.seq GROUP BY ALL")
    return f"""{ctes}, lg AS ({log}), flds AS ({fields}), hds AS ({headers}), pms AS ({params}),
 o AS (SELECT seq, row_number() OVER e AS r_e, count(*) OVER (PARTITION BY method, path_pattern) AS n_e, row_number() OVER v AS r_v, count(*) OVER (PARTITION BY method, path_pattern, fingerprint) AS n_v FROM lg
 WINDOW e AS (PARTITION BY method, path_pattern ORDER BY seq), v AS (PARTITION BY method, path_pattern, fingerprint ORDER BY seq))
 {one('field', 'e', 'flds', 'CAST(NULL AS VARCHAR)', 's.location', 'arg_max(s.type_json, s.seq)')} UNION ALL {one('variant_field', 'v', 'flds', 's.fingerprint', 's.location', 'arg_max(s.type_json, s.seq)')}
 UNION ALL {one('header', 'e', 'hds', 'NULL', 'NULL', 'CAST(NULL AS VARCHAR)')} UNION ALL {one('param', 'e', 'pms', 'NULL', 'NULL', 'CAST(NULL AS VARCHAR)')}
 UNION ALL SELECT 'variant', method, path_pattern, fingerprint, NULL, NULL, count(*), count(*), {label} FROM lg GROUP BY method, path_pattern, fingerprint"""


LABEL_SQL = "CASE WHEN starts_with(fingerprint, 'auth:bearer') THEN 'authenticated' WHEN starts_with(fingerprint, 'auth:basic') THEN 'basic-auth' ELSE '' END"
ORDER_TOTALS = totals_sql(
    f"WITH {A.ORDERS_SQL}, {A.ORDER_FIELDS_SQL}", f"SELECT method, path_pattern, {A.ORDER_FP_SQL} AS fingerprint, seq FROM ord", "SELECT method, path_pattern, fingerprint, seq, location, field_path AS name, type_json FROM fld",
    "SELECT method, path_pattern, seq, CASE WHEN auth = 'basic' THEN 'Authorization:basic' ELSE 'Authorization' END AS name FROM ord WHERE auth <> 'none' UNION ALL SELECT method, path_pattern, seq, 'X-Tenant' FROM ord WHERE auth = 'bearer'",
    "SELECT method, path_pattern, seq, unnest(['dry', 'v']) AS name FROM ord WHERE contains(raw_path, '?')", LABEL_SQL,
)
EVENT_FP_SQL = "'auth:' || CASE WHEN user_id % 3 = 0 THEN 'bearer' ELSE 'none' END || '|body:' || CASE WHEN method <> 'GET' THEN 'k' ELSE '' END"
EVENT_TOTALS = totals_sql(
    f"WITH {A.EVENTS_SQL}", f"SELECT method, path_pattern, {EVENT_FP_SQL} AS fingerprint, seq FROM ev",
    f"SELECT method, path_pattern, {EVENT_FP_SQL} AS fingerprint, seq, unnest(CASE WHEN method <> 'GET' THEN ['request', 'response'] ELSE ['response'] END) AS location, 'k' AS name, '{{\"type\":\"integer\"}}' AS type_json FROM ev",
    "SELECT method, path_pattern, seq, 'Accept' AS name FROM ev UNION ALL SELECT method, path_pattern, seq, 'Authorization' FROM ev WHERE user_id % 3 = 0", "SELECT method, path_pattern, seq, '' AS name FROM ev WHERE false", LABEL_SQL,
)


def recorded(spark: SparkSession, pairs: DataFrame, parts: int) -> catalog.CatalogStore:
    """A catalogue that got a table's pairs in interleaved batches."""
    s, obs = store(spark), infer.observe(capture.capture(pairs))
    for k in range(parts):
        s.record(obs.where(F.pmod(F.xxhash64("seq"), F.lit(parts)) == k), f"part-{k}")
    return s


@query("a_states_merged", ORDER_TOTALS)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved batches, merged, then one of them replayed."""
    pairs = A.pairs_orders(spark, sf_dir)
    s = recorded(spark, pairs, 3)
    s.compact()
    s.record(infer.observe(capture.capture(pairs)).where(F.pmod(F.xxhash64("seq"), F.lit(3)) == 1), "part-1")
    return totals(s.states())


@query("a_states_deleted", f"SELECT * FROM ({ORDER_TOTALS}) WHERE path_pattern NOT IN ('/groups/gb/orders/{{id}}')")
def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a deletion and a replay of a batch that it covers."""
    pairs = A.pairs_orders(spark, sf_dir)
    s = recorded(spark, pairs, 2)
    s.delete("POST", "/groups/gb/orders/{id}")
    s.record(infer.observe(capture.capture(pairs)).where(F.pmod(F.xxhash64("seq"), F.lit(2)) == 0), "part-0")
    return totals(s.states())


@query("m1_late_rows", f"WITH {A.EVENTS_SQL} SELECT method, path_pattern, count(*) AS call_count, min(observed_at) AS first_seen FROM ev WHERE path_pattern <> '/click/{{id}}' OR seq % 3 = 0 GROUP BY 1, 2")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An endpoint is deleted; a later batch brings calls of it, with numbers between those deleted: they count, the deleted do not."""
    s, obs = store(spark), infer.observe(A.pairs_events(spark, sf_dir))
    s.record(obs.where("seq % 3 <> 0"), "first")
    s.delete("post", "/click/{id}")
    s.record(obs.where("seq % 3 = 0"), "late")
    return s.endpoints().select("method", "path_pattern", "call_count", "first_seen")


def arrivals(spark: SparkSession, pairs: DataFrame, top: str, files: int) -> None:
    """Pairs as files of a source that reorders them and delivers a third of them twice, in another file."""
    again = pairs.where("seq % 3 = 1").withColumn("seq_", F.col("seq") + 1)
    both = pairs.withColumn("seq_", F.col("seq")).unionByName(again).withColumn("file", F.pmod(F.xxhash64("seq_"), F.lit(files)))
    for k in range(files):
        both.where(F.col("file") == k).drop("seq_", "file").coalesce(1).write.mode("append").parquet(f"{top}/in")


@query("s3_live_totals", EVENT_TOTALS)
def live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in the stream's state: the source repeats and reorders, the stream is stopped and started again."""
    top = folder(spark)
    s = store(spark, root=top)
    pairs = A.pairs_events(spark, sf_dir)
    for half in range(2):
        arrivals(spark, pairs.where(F.pmod(F.xxhash64("seq", F.lit(1)), F.lit(2)) == half), top, 2)
        live.live_totals(streams.pair_stream(spark, f"{top}/in", max_files=2), s, f"{top}/state").awaitTermination()
    return totals(live.live_states(s))


@query("s3_late_and_repeated", EVENT_TOTALS)
def late_and_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log mode over the same kind of source: repeated pairs are known by their number while the watermark waits."""
    top = folder(spark)
    s = store(spark, root=top)
    pairs = A.pairs_events(spark, sf_dir)
    arrivals(spark, pairs, top, 2)
    streams.ingest_stream(streams.pair_stream(spark, f"{top}/in", max_files=1), s, f"{top}/state", delay="3650 days").awaitTermination()
    return totals(s.states())
