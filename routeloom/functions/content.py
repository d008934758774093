"""Content operators as column expressions: capture filters (S2, S4, S5) and classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request headers that are never tracked.
SKIPPED_HEADERS = [
    "accept-encoding", "connection", "content-length", "host", "keep-alive", "origin", "proxy-authorization",
    "referer", "te", "trailer", "transfer-encoding", "upgrade", "user-agent",
]
BODY_LIMIT = 1048576


def capped(body: Column, limit: int = BODY_LIMIT) -> Column:
    """At most limit bytes of a body."""
    return F.substring(body, 1, limit)


def captured(path: Column, include: str = "", ignore: str = "") -> Column:
    """Prefix filter on the path without its query; ignore is a comma list."""
    plain = F.substring_index(path, "?", 1)
    keep = plain.startswith(include) if include else F.lit(True)
    for part in [p.strip() for p in ignore.split(",") if p.strip()]:
        keep = keep & ~plain.startswith(part)
    return keep


def header_names(names: Column) -> Column:
    """Tracked header names in canonical case, each once."""
    kept = F.filter(names, lambda h: ~((F.lower(h) == "cookie") | F.lower(h).startswith("sec-") | F.lower(h).isin(SKIPPED_HEADERS)))
    canon = F.transform(kept, lambda h: F.array_join(F.transform(F.split(h, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "-"))
    return F.array_distinct(canon)


def trimmed(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def media_type(content_type: Column) -> Column:
    """Lower case, without parameters; null is empty."""
    return trimmed(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))


def body_kind(content_type: Column) -> Column:
    """Which inference a body gets."""
    ct = media_type(content_type)
    return (
        F.when(ct == "application/json", "json").when(ct.contains("application/graphql"), "graphql")
        .when(ct == "application/x-www-form-urlencoded", "form").when(ct.startswith("multipart/form-data"), "multipart")
        .when(ct.isin("application/xml", "text/xml"), "xml").when(ct.startswith("application/grpc"), "grpc").otherwise("json")
    )


def protocol(content_type: Column, body: Column) -> Column:
    """I3; the JSON test for GraphQL looks for the bytes of a query key."""
    ct = media_type(content_type)
    asks = F.coalesce(body.contains(F.lit(b'"query"')), F.lit(False))
    return (
        F.when(ct.startswith("application/grpc"), "grpc").when(ct.isin("application/xml", "text/xml"), "xml")
        .when(ct == "application/x-www-form-urlencoded", "form").when(ct.contains("application/graphql"), "graphql")
        .when((ct == "application/json") & asks, "graphql").otherwise("rest")
    )


def string_format(s: Column) -> Column:
    """I4: ordered format rules, empty where none applies (any colon without :// is ipv6)."""
    return (
        F.when(s.rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), "uuid")
        .when(s.rlike(r"\A[^@ \t\n\f\r]+@[^@ \t\n\f\r]+\.[^@ \t\n\f\r]+\z"), "email")
        .when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"), "date-time")
        .when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "date")
        .when(s.startswith("http://") | s.startswith("https://"), "uri")
        .when(s.rlike(r"\A[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\z"), "ipv4")
        .when((F.octet_length(s) >= 2) & s.contains(":") & ~s.contains("://"), "ipv6").otherwise("")
    )


def form_type(v: Column) -> Column:
    """Type of a form value."""
    whole = v.rlike(r"\A[+-]?[0-9]+\z")
    return (
        F.when(F.lower(v).isin("true", "false"), "boolean").when(whole & v.try_cast("bigint").isNotNull(), "integer")
        .when(v.rlike(r"(?i)\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z|\A[+-]?(inf|infinity|nan)\z"), "number").otherwise("string")
    )


def graphql_operation(query: Column) -> Column:
    """Operation of a query text by its first word."""
    low = F.lower(trimmed(query))
    return (
        F.when(low.startswith("mutation"), "mutation").when(low.startswith("subscription"), "subscription").when(low.startswith("query"), "query")
        .when(low.startswith("{"), "query").otherwise("graphql")
    )
