"""Statistics over the observation log (A1-A14), as closed-form aggregates.

A counter row (field, header, parameter) is born at its first sighting and counts every later
observation of its endpoint, so its total is the number of the endpoint's observations from that
one on. That number is read off a tree of ranges of the sequence number: leaves of 2 ** LEAF_BITS
numbers, then LEVELS levels of sums, each over 2 ** FAN_BITS nodes of the level below. In a level a
leaf adds up what stands right of its own node under the same parent (one row, summed beforehand);
levels at which the whole log lies in one node are left out. A birth meets its own leaf only, with
that sum, and looks at it number by number. So no task sees more of a hot endpoint than one parent's
nodes, and a leaf meets LEVELS rows at most, however many observations there are.

The same counts are kept as mergeable states (``states``): a batch is aggregated once, states of
batches add up (``merge_states``), and every statistic can be read from them without the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDPOINT = ["method", "path_pattern"]
VARIANT = [*ENDPOINT, "fingerprint"]
LEAF_BITS, FAN_BITS, LEVELS = 10, 11, 5  # 65 bits: any sequence number
COVERAGE_CALLS = 30
NEWEST = 100
SOURCES = ["observed", "scan", "scan+obs"]


def endpoints(obs: DataFrame) -> DataFrame:
    """A1: calls, first and last sighting, protocol of the first."""
    return obs.groupBy(*ENDPOINT).agg(
        F.count("*").alias("call_count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.min_by("protocol", "seq").alias("protocol")
    )


def raw_paths(obs: DataFrame) -> DataFrame:
    """A3."""
    return obs.groupBy(*ENDPOINT, "raw_path").agg(F.count("*").alias("seen_count"))


def leaves(obs: DataFrame, key: list[str]) -> DataFrame:
    """key, r, n, seqs: the observations of each range of 2 ** LEAF_BITS sequence numbers, which are unique."""
    return obs.groupBy(*key, F.shiftright("seq", LEAF_BITS).alias("r")).agg(F.count("*").alias("n"), F.collect_list("seq").alias("seqs"))


def span(leaf: DataFrame) -> DataFrame:
    """One row: first and last range, and the levels at which they have different nodes; in all others no node has one beside it."""
    ends = leaf.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    levels = F.expr(f"filter(sequence(0, {LEVELS - 1}), x -> x = 0 OR shiftright(lo, {FAN_BITS} * x) != shiftright(hi, {FAN_BITS} * x))")
    return ends.select("lo", "hi", levels.alias("levels"))


def after(leaf: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """leaf (key..., r, n) -> key..., r, after: the key's observations in all ranges right of r."""
    node = F.expr(f"shiftright(r, {FAN_BITS} * level)")
    parent = F.when(F.col("level") == LEVELS - 1, 0).otherwise(F.expr(f"shiftright(node, {FAN_BITS})"))
    nodes = leaf.select(*key, "r", "n").crossJoin(F.broadcast(ends)).select(*key, "r", "n", F.explode("levels").alias("level")).withColumn("node", node)
    sums = nodes.groupBy(*key, "level", "node").agg(F.sum("n").alias("n"))
    right = Window.partitionBy(*key, "level", parent).orderBy(F.col("node").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "level", "node", F.coalesce(F.sum("n").over(right), F.lit(0)).alias("beside"))
    return nodes.select(*key, "r", "level", "node").join(sums, [*key, "level", "node"]).groupBy(*key, "r").agg(F.sum("beside").alias("after"))


def since(leaf: DataFrame, ends: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """points (key..., born, r, ...) -> with since: observations of the key from born on. r is a range of leaf, born's own or the one nearest to it."""
    found = points.join(leaf.select(*key, "r", "seqs"), [*key, "r"], "left").join(after(leaf, ends, key), [*key, "r"], "left")
    within = F.size(F.filter("seqs", lambda x: x >= F.col("born")))
    return found.select(*points.columns, (F.col("after") + within).alias("since")).drop("r")


def calls_since(obs: DataFrame, points: DataFrame) -> DataFrame:
    """points (method, path_pattern, born, ...) -> with since; born need not be an observation, since is null where it is null."""
    seen = obs.select(*ENDPOINT, "seq", F.shiftright("seq", LEAF_BITS).alias("r"))
    ends = span(seen)
    # what was born before all observations or after them is looked up in their first or last range
    at = points.crossJoin(F.broadcast(ends)).withColumn("r", F.when(F.col("born").isNotNull(), F.greatest(F.least(F.shiftright("born", LEAF_BITS), "hi"), "lo"))).drop("lo", "hi", "levels")
    # a point's range is there in any case, with nothing in it
    both = seen.unionByName(at.select(*ENDPOINT, F.lit(None).cast("long").alias("seq"), "r"))
    leaf = both.groupBy(*ENDPOINT, "r").agg(F.count("seq").alias("n"), F.collect_list("seq").alias("seqs"))
    return since(leaf, ends, at, ENDPOINT)


def with_totals(births: DataFrame, leaf: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """births (key..., born, ...) -> with total_calls; the range that born lies in is in leaf."""
    found = since(leaf, ends, births.withColumn("r", F.shiftright("born", LEAF_BITS)), key)
    return found.where(F.col("since").isNotNull()).withColumnRenamed("since", "total_calls")


def _presence(obs: DataFrame, seen: DataFrame, key: list[str], name: list[str], latest: str | None = None) -> DataFrame:
    """seen (key..., name..., seq[, latest]) -> seen_count, total_calls[, latest value]."""
    if latest:
        # each text is counted first: counts need no sort, max_by of a text sorts its rows
        texts = seen.groupBy(*key, *name, latest).agg(F.count("*").alias("n"), F.min("seq").alias("born"), F.max("seq").alias("last"))
        births = texts.groupBy(*key, *name).agg(F.sum("n").alias("seen_count"), F.min("born").alias("born"), F.max_by(latest, "last").alias(latest))
    else:
        births = seen.groupBy(*key, *name).agg(F.count("*").alias("seen_count"), F.min("seq").alias("born"))
    ends = span(obs.select(F.shiftright("seq", LEAF_BITS).alias("r")))
    return with_totals(births, leaves(obs, key), ends, key).select(*key, *name, "seen_count", "total_calls", *([latest] if latest else []))


def field_rows(obs: DataFrame, key: list[str]) -> DataFrame:
    sides = F.array(F.struct(F.lit("request").alias("location"), F.col("req_fields").alias("f")), F.struct(F.lit("response").alias("location"), F.col("resp_fields").alias("f")))
    one = obs.select(*key, "seq", F.explode(sides).alias("s")).select(*key, "seq", "s.location", F.explode("s.f").alias("f"))
    return one.select(*key, "seq", "location", "f.field_path", "f.type_json")


def fields(obs: DataFrame) -> DataFrame:
    """A4: presence of each field of an endpoint, with the type last seen."""
    return _presence(obs, field_rows(obs, ENDPOINT), ENDPOINT, ["location", "field_path"], "type_json")


def variant_fields(obs: DataFrame) -> DataFrame:
    """A5."""
    return _presence(obs, field_rows(obs, VARIANT), VARIANT, ["location", "field_path"], "type_json")


def headers(obs: DataFrame) -> DataFrame:
    """A name given twice in one pair is seen twice, and its row counted twice from the start."""
    seen = obs.select(*ENDPOINT, "seq", F.explode("header_names").alias("name"))
    rows = _presence(obs, seen, ENDPOINT, ["name"])
    # every sighting beyond the first in one observation adds one to the total as well
    extra = seen.groupBy(*ENDPOINT, "name", "seq").agg((F.count("*") - 1).alias("more")).groupBy(*ENDPOINT, "name").agg(F.sum("more").alias("more"))
    return rows.join(extra, [*ENDPOINT, "name"]).withColumn("total_calls", F.col("total_calls") + F.col("more")).drop("more")


def query_params(obs: DataFrame) -> DataFrame:
    """A7."""
    return _presence(obs, obs.select(*ENDPOINT, "seq", F.explode("param_names").alias("name")), ENDPOINT, ["name"])


def variants(obs: DataFrame) -> DataFrame:
    """A9, with the automatic label (A10)."""
    out = obs.groupBy(*VARIANT).agg(F.count("*").alias("call_count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    return out.withColumn("label", variant_label(F.col("fingerprint")))


def variant_label(fp: Column) -> Column:
    """A10."""
    auth = F.regexp_extract(fp, r"^auth:([^|]*)\|", 1)
    body = F.regexp_replace(fp, r"^[^|]*\|body:", "")
    names = F.split(body, ",")
    login = F.array_contains(names, "password") & (F.array_contains(names, "username") | F.array_contains(names, "email"))
    return (
        F.when(~fp.contains("|"), "").when(auth == "bearer", "authenticated").when(auth == "basic", "basic-auth").when(auth == "apikey", "api-key")
        .when(body == "token", "token-login").when(login, "password-login").otherwise("")
    )


def confidence(seen: Column, total: Column) -> Column:
    """Share of calls, 0 where there were none."""
    return F.coalesce(F.try_divide(seen.cast("double"), total.cast("double")), F.lit(0.0))


def is_required(seen: Column, total: Column, threshold: float = 0.9) -> Column:
    return confidence(seen, total) >= threshold


def overall_confidence(field_stats: DataFrame) -> DataFrame:
    """Mean confidence by endpoint and location."""
    return field_stats.groupBy(*ENDPOINT, "location").agg(F.avg(confidence(F.col("seen_count"), F.col("total_calls"))).alias("confidence"))


def coverage(calls: Column, source: Column) -> Column:
    """A13."""
    weight = F.when(source == "observed", 1.0).when(source == "scan+obs", 0.6).otherwise(0.35)
    return F.when(calls <= 0, 0.0).otherwise(F.least(calls / F.lit(float(COVERAGE_CALLS)), F.lit(1.0)) * weight)


def newest(obs: DataFrame, k: int, key: list[str] | None = None) -> DataFrame:
    """the k newest observations of each endpoint; ties by seq. The window is a group limit."""
    order = Window.partitionBy(*(key or ENDPOINT)).orderBy(F.col("observed_at").desc(), F.col("seq").desc())
    return obs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def status_codes(obs: DataFrame, k: int = NEWEST) -> DataFrame:
    """Distinct codes among the newest observations."""
    return newest(obs.select(*ENDPOINT, "observed_at", "seq", "status_code"), k).groupBy(*ENDPOINT).agg(F.array_sort(F.collect_set("status_code")).alias("status_codes"))


def source_counts(catalogue: DataFrame) -> DataFrame:
    """Endpoints by source with a total; absent sources count 0."""
    spark = catalogue.sparkSession
    names = spark.createDataFrame([(s,) for s in [*SOURCES, "total"]], "source string")
    got = catalogue.rollup("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("total")).alias("source"), "n")
    return names.join(got, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


RECENT = "struct<observed_at: timestamp, seq: bigint, status_code: int, latency_ms: bigint, fingerprint: string>"
STATE = (
    "kind STRING, method STRING, path_pattern STRING, fingerprint STRING, location STRING, name STRING, n BIGINT, more BIGINT, born BIGINT, first_seen TIMESTAMP, last_seen TIMESTAMP, "
    f"text STRING, text_at BIGINT, r BIGINT, seqs ARRAY<BIGINT>, recent ARRAY<{RECENT}>"
)
STATE_KEY = ["kind", *VARIANT, "location", "name"]
WITH_TEXT = ["endpoint", "field", "variant_field"]
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ") if ":" not in c] + ["recent"]


def _filled(df: DataFrame) -> DataFrame:
    """With all columns of STATE, in order."""
    kinds = {f.split()[0]: f.split()[1] for f in STATE.split(", ") if ":" not in f} | {"recent": f"array<{RECENT}>"}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in STATE_COLUMNS])


def _top(calls: DataFrame, k: int) -> DataFrame:
    return newest(calls, k).groupBy(*ENDPOINT).agg(F.collect_list(F.struct("observed_at", "seq", "status_code", "latency_ms", "fingerprint")).alias("recent")).withColumn("kind", F.lit("recent"))


def _added(counters: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """Counters of the same key added up."""
    return counters.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("more").alias("more"), F.min("born").alias("born"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *more, F.max("text_at").alias("text_at"),
    )


def _last_text() -> Column:
    return F.max_by("text", "text_at").alias("text")


def states(obs: DataFrame, k: int = NEWEST) -> DataFrame:
    """A batch's mergeable state (STATE): counters with their births, ranges of sequence numbers, the k newest calls of each endpoint.

    Counters without a text (path, variant, header, param) are one aggregation, those with one
    (WITH_TEXT) another, ranges (leaf, by variant) a third. A text is the first protocol of an
    endpoint, or the last type of a field: that of the largest text_at. Each text is counted first:
    counts need no sort, max_by of a text sorts its rows.
    """
    none, one, last = F.lit(None).cast("string"), F.lit(1).cast("long"), F.col("seq")
    row = lambda kind, fp=none, location=none, name=none, n=one, more=F.lit(0).cast("long"), text=none, at=last: F.struct(
        F.lit(kind).alias("kind"), fp.alias("fingerprint"), location.alias("location"), name.alias("name"), n.alias("n"), more.alias("more"), text.alias("text"), at.alias("text_at"))
    fields = lambda kind, fp, side, col: F.transform(F.coalesce(F.col(col), F.array().cast("array<struct<field_path:string,type_json:string>>")), lambda f: row(kind, fp, F.lit(side), f["field_path"], text=f["type_json"]))
    names = lambda col: F.coalesce(F.col(col), F.array().cast("array<string>"))
    times = lambda h: F.size(F.filter(names("header_names"), lambda x: x.eqNullSafe(h))).cast("long")
    fp = F.col("fingerprint")
    plain = F.concat(
        F.array(row("path", name=F.col("raw_path")), row("variant", fp)),
        F.transform(F.array_distinct(names("header_names")), lambda h: row("header", name=h, n=times(h), more=times(h) - 1)), F.transform(names("param_names"), lambda p: row("param", name=p)),
    )
    texts = F.concat(
        F.array(row("endpoint", text=F.col("protocol"), at=-last)),
        fields("field", none, "request", "req_fields"), fields("field", none, "response", "resp_fields"), fields("variant_field", fp, "request", "req_fields"), fields("variant_field", fp, "response", "resp_fields"),
    )
    seen = ["method", "path_pattern", last.alias("born"), F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen")]
    one_each = lambda rows: obs.select(*seen, F.explode(rows).alias("x")).select("method", "path_pattern", "born", "first_seen", "last_seen", "x.*")
    counters = _filled(_added(one_each(plain), STATE_KEY)).unionByName(_filled(_added(_added(one_each(texts), [*STATE_KEY, "text"]), STATE_KEY, _last_text())))
    ranges = leaves(obs, VARIANT).withColumn("kind", F.lit("leaf"))
    calls = _top(obs.select(*ENDPOINT, "observed_at", "seq", "status_code", "latency_ms", "fingerprint"), k)
    return counters.unionByName(_filled(ranges)).unionByName(_filled(calls))


def recent_calls(state: DataFrame) -> DataFrame:
    """The calls that states keep, one a row."""
    return state.where("kind = 'recent'").select(*ENDPOINT, F.explode("recent").alias("c")).select(*ENDPOINT, "c.*")


def merge_counters(state: DataFrame, kind: str) -> DataFrame:
    counters = state.where(F.col("kind") == kind)
    return _added(counters, STATE_KEY, _last_text()) if kind in WITH_TEXT else _added(counters, STATE_KEY).withColumn("text", F.lit(None).cast("string"))


def ranges_of(state: DataFrame, kind: str) -> DataFrame:
    """key..., r, n, seqs of a state's leaves; a counter's range is there in any case, with nothing in it."""
    leaf = F.col("kind") == "leaf"
    rows = state.where(leaf | (F.col("kind") == kind))
    return rows.select(*VARIANT, F.when(leaf, F.col("r")).otherwise(F.shiftright("born", LEAF_BITS)).alias("r"), F.when(leaf, F.col("n")).otherwise(0).alias("n"), F.when(leaf, F.col("seqs")).alias("seqs"))


def merge_leaves(ranges: DataFrame, key: list[str] = VARIANT) -> DataFrame:
    return ranges.groupBy(*key, "r").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("seqs")).alias("seqs"))


def merge_states(state: DataFrame, k: int = NEWEST) -> DataFrame:
    """States of several batches as that of one."""
    rest = _top(recent_calls(state), k)
    out = _filled(merge_leaves(state.where("kind = 'leaf'")).withColumn("kind", F.lit("leaf"))).unionByName(_filled(rest))
    for kind in ("endpoint", "path", "variant", "field", "variant_field", "header", "param"):
        out = out.unionByName(_filled(merge_counters(state, kind)))
    return out


def endpoints_of(state: DataFrame) -> DataFrame:
    """A1 from states."""
    return merge_counters(state, "endpoint").select(*ENDPOINT, F.col("n").alias("call_count"), "first_seen", "last_seen", F.col("text").alias("protocol"))


def raw_paths_of(state: DataFrame) -> DataFrame:
    """A3 from states."""
    return merge_counters(state, "path").select(*ENDPOINT, F.col("name").alias("raw_path"), F.col("n").alias("seen_count"))


def presence_of(state: DataFrame, kind: str) -> DataFrame:
    """A4 (field), A5 (variant_field), A6 (header) or A7 (param) from states."""
    key = VARIANT if kind == "variant_field" else ENDPOINT
    counted = merge_counters(state, kind).withColumnRenamed("n", "seen_count")
    ranges = ranges_of(state, kind)
    rows = with_totals(counted, merge_leaves(ranges, key), span(ranges), key).withColumn("total_calls", F.col("total_calls") + F.col("more"))
    if kind in ("header", "param"):
        return rows.select(*key, "name", "seen_count", "total_calls")
    return rows.select(*key, "location", F.col("name").alias("field_path"), "seen_count", "total_calls", F.col("text").alias("type_json"))


def variants_of(state: DataFrame) -> DataFrame:
    """A9 and A10 from states."""
    out = merge_counters(state, "variant").select(*VARIANT, F.col("n").alias("call_count"), "first_seen", "last_seen")
    return out.withColumn("label", variant_label(F.col("fingerprint")))


def status_codes_of(state: DataFrame, k: int = NEWEST) -> DataFrame:
    """A14 from states that keep at least k calls."""
    return status_codes(recent_calls(state), k)
