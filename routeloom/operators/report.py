"""List, show and stats over the catalogue."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.operators import fold

if TYPE_CHECKING:
    from routeloom.operators.catalog import CatalogStore

COLUMNS = ["method", "path", "protocol", "source", "calls", "coverage"]
LOW_COVERAGE = 0.30
BAR = 8
# Reason phrases of status codes.
STATUS = {
    100: "Continue", 101: "Switching Protocols", 200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found",
    304: "Not Modified", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 409: "Conflict", 410: "Gone",
    422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def listed(catalogue: DataFrame, min_calls: int = 0, source: str = "", protocol: str = "") -> DataFrame:
    """F1 and F8."""
    out = catalogue
    if min_calls > 0:
        out = out.where(F.col("call_count") >= min_calls)
    if source:
        out = out.where(F.col("source") == source)
    if protocol:
        out = out.where(F.col("protocol") == protocol)
    return out.orderBy("path_pattern", "method")


def exported(catalogue: DataFrame, min_calls: int = 0) -> DataFrame:
    """F2."""
    return catalogue.where((F.col("protocol") != "grpc") & (F.col("call_count") >= min_calls))


def lookup(catalogue: DataFrame, method: str, path: str) -> DataFrame:
    """the method in any case, the path exactly."""
    return catalogue.where((F.upper("method") == method.upper()) & (F.col("path_pattern") == path))


def source_place(file: Column, line: Column) -> Column:
    """base name and line of a source file, empty without one."""
    base = F.try_element_at(F.split(file, "/"), F.lit(-1))
    return F.when(F.coalesce(file, F.lit("")) == "", "").when(F.coalesce(line, F.lit(0)) > 0, F.concat(base, F.lit(":"), line.cast("string"))).otherwise(base)


def note(calls: Column, cover: Column) -> Column:
    """F6."""
    return F.when(calls <= 0, "not yet seen").when(cover < LOW_COVERAGE, "low coverage").otherwise("")


def bar(cover: Column) -> Column:
    """eight cells and a percentage, halves to even."""
    full = F.floor(cover * BAR + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(BAR) - full), F.lit(" "), F.format_string("%3.0f%%", F.bround(cover * 100, 0)))


def derived(catalogue: DataFrame) -> DataFrame:
    """All list columns by name."""
    cover = fold.coverage(F.col("call_count"), F.col("source"))
    return catalogue.select(
        "method", F.col("path_pattern").alias("path"), "protocol", "source", F.col("call_count").alias("calls"), cover.alias("coverage"), bar(cover).alias("bar"), "framework",
        source_place(F.col("source_file"), F.col("source_line")).alias("file"), F.when(F.col("requires_auth"), "yes").otherwise("-").alias("auth"),
        note(F.col("call_count"), cover).alias("note"), "description", F.array_join("tags", ",").alias("tags"), "first_seen", "last_seen",
    )


def columns(catalogue: DataFrame, names: list[str] | None = None) -> DataFrame:
    """the asked columns in order; an unknown name is blank under its upper-case header."""
    rows = derived(catalogue)
    return rows.select(*[F.col(n).alias(n) if n in rows.columns else F.lit("").alias(n.upper()) for n in (names or COLUMNS)])


def fields_at(field_stats: DataFrame, location: str) -> DataFrame:
    """F4."""
    return field_stats.where(F.col("location") == location)


def sorted_fields(field_stats: DataFrame) -> DataFrame:
    """F9."""
    return field_stats.orderBy("location", "field_path")


def status_text(code: Column) -> Column:
    """a literal map of the fixed phrases."""
    pairs = [F.lit(x) for kv in STATUS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("Response"))


def header_placeholder(name: Column) -> Column:
    """F13."""
    low = F.lower(name)
    return (
        F.when(low == "authorization", "Bearer {{token}}").when(low.isin("x-api-key", "x-apikey", "api-key", "x-api-token"), "{{api_key}}")
        .when(low.isin("x-auth-token", "x-access-token", "x-token"), "{{token}}").when(low.isin("accept", "content-type"), "application/json")
        .otherwise(F.concat(F.lit("{{"), F.translate(low, "- ", "__"), F.lit("}}")))
    )


def scan_order(scanned: DataFrame) -> DataFrame:
    """F11."""
    return scanned.orderBy("path_pattern", "method")


def show(store: CatalogStore, method: str, path: str, calls: int = 0) -> dict | None:
    """One endpoint with fields, headers, parameters, variants and its newest calls; bounded by one endpoint's names."""
    found = lookup(store.endpoints(), method, path).limit(1).collect()
    if not found:
        return None
    own = lambda df: df.where((F.col("method") == found[0]["method"]) & (F.col("path_pattern") == path))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    state, out = own(store.states()), found[0].asDict(recursive=True)
    out["fields"] = rows(sorted_fields(fold.presence_of(state, "field")))
    out["headers"] = rows(fold.presence_of(state, "header").orderBy("name"))
    out["query_params"] = rows(fold.presence_of(state, "param").orderBy("name"))
    out["variants"] = rows(own(store.variants()).orderBy("first_seen"))
    if calls:
        out["calls"] = rows(own(store.newest(calls)).orderBy("rank"))
    return out


def show_json(shown: dict | None, indent: int = 2) -> str:
    """S14."""
    return json.dumps(shown, indent=indent, default=str, ensure_ascii=False, sort_keys=True)
