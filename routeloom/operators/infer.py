"""Payload inference (I1-I12) and flattening (N1): types and names of a body, never its values.

A schema is a JSON text (Spark has no recursive struct type). Inference is one vectorised Arrow pass
over the bodies; everything downstream uses the flattened leaves and stays in SQL.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any
from urllib.parse import unquote_to_bytes
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import content, paths
from routeloom.operators import variants

Schema = dict[str, Any]
FORMATS = [
    ("uuid", re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I | re.A)),
    ("email", re.compile(r"[^@ \t\n\f\r]+@[^@ \t\n\f\r]+\.[^@ \t\n\f\r]+")),
    ("date-time", re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", re.A)),
    ("date", re.compile(r"\d{4}-\d\d-\d\d", re.A)),
    ("uri", re.compile(r"https?://.*", re.S)),
    ("ipv4", re.compile(r"\d{1,3}(\.\d{1,3}){3}", re.A)),
]


def string_format(s: str) -> str:
    for name, pattern in FORMATS:
        if pattern.fullmatch(s):
            return name
    return "ipv6" if len(s.encode()) >= 2 and ":" in s and "://" not in s else ""


def from_value(v: Any) -> Schema:
    """Schema of a parsed JSON value."""
    if v is None:
        return {"nullable": True}
    if isinstance(v, bool):
        return {"type": "boolean"}
    if isinstance(v, (int, float)):
        return {"type": "integer" if float(v).is_integer() else "number"}
    if isinstance(v, str):
        fmt = string_format(v)
        return {"type": "string", **({"format": fmt} if fmt else {})}
    if isinstance(v, list):
        return {"type": "array", "items": items_of(v)}
    if not v:
        return {"type": "object"}
    return {"type": "object", "properties": {k: from_value(v[k]) for k in sorted(v)}, "required": sorted(v)}


def items_of(values: list) -> Schema:
    """One schema for all items: the union of objects (first definition of a name wins), else the first item's."""
    if not values:
        return {"type": "object"}
    if not all(isinstance(v, dict) for v in values):
        return from_value(values[0])
    names = sorted({k for v in values for k in v})
    props = {k: from_value(next(v[k] for v in values if k in v)) for k in names}
    need = [k for k in names if all(k in v for v in values)]
    return {"type": "object", **({"properties": props} if props else {}), **({"required": need} if need else {})}


def _finite(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError("number out of range")
    return x


def _no_constant(name: str) -> float:
    raise ValueError(name)


def parse_json(body: bytes) -> Any:
    """Strict JSON with numbers as doubles; raises ValueError."""
    return json.loads(body.decode("utf-8", "replace"), parse_float=_finite, parse_int=_finite, parse_constant=_no_constant)


def from_json(body: bytes) -> Schema | None:
    """I8."""
    try:
        return from_value(parse_json(body)) if body else None
    except (ValueError, RecursionError):
        return None


def from_xml(body: bytes) -> Schema | None:
    """Attributes, children (repeated ones as arrays of the first), mixed text; names without prefix."""
    root: list[dict] = []
    stack: list[dict] = []

    def start(name: str, attrs: list[str]) -> None:
        node = {"name": name.rpartition(":")[2], "attrs": [a.rpartition(":")[2] for a in attrs[::2]], "kids": [], "text": False}
        if stack:
            stack[-1]["kids"].append(node)
        else:
            root[:] = [node]
        stack.append(node)

    def text(data: str) -> None:
        if stack and data.strip():
            stack[-1]["text"] = True

    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.StartElementHandler, parser.CharacterDataHandler = start, text
    parser.EndElementHandler = lambda _: stack.pop()
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        return None

    def schema(node: dict) -> Schema:
        if not node["kids"] and not node["attrs"]:
            return {"type": "string"}
        props: dict[str, Schema] = {f"@{a}": {"type": "string", "xml_attr": True} for a in node["attrs"]}
        names = [k["name"] for k in node["kids"]]
        for kid in reversed(node["kids"]):  # the first of a name is written last and stays
            own = schema(kid)
            props[kid["name"]] = {"type": "array", "items": own} if names.count(kid["name"]) > 1 else own
        if node["text"] and node["kids"]:
            props["_text"] = {"type": "string"}
        return {"type": "object", "properties": dict(sorted(props.items()))}

    return schema(root[0]) if root else None


INTEGER = re.compile(r"[+-]?[0-9]+")
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(inf|infinity|nan)", re.I)


def form_type(v: str) -> str:
    if v.lower() in ("true", "false"):
        return "boolean"
    if INTEGER.fullmatch(v) and -(2**63) <= int(v) < 2**63:
        return "integer"
    return "number" if NUMBER.fullmatch(v) else "string"


def from_form(body: bytes) -> Schema | None:
    """Names of a urlencoded body, ``k[]`` as arrays, typed by the first non-empty value."""
    first: dict[str, str] = {}
    for pair in body.decode("utf-8", "replace").split("&"):
        if not pair:
            continue
        if ";" in pair or re.search(r"%(?![0-9A-Fa-f]{2})", pair):
            return None
        key, _, value = (unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace") if x != "=" else x for x in pair.partition("="))
        first[key] = first.get(key) or value
    if not first:
        return None
    props = {}
    for key, value in first.items():
        own = {"type": form_type(value)}
        props[key.removesuffix("[]")] = {"type": "array", "items": own} if key.endswith("[]") else own
    return {"type": "object", "properties": dict(sorted(props.items()))}


def graphql_operation(query: str) -> str:
    text = query.strip()
    return next((op for op in ("mutation", "subscription", "query") if text.lower().startswith(op)), "query" if text.startswith("{") else "graphql")


def from_graphql(body: bytes) -> Schema | None:
    """Operation as description and the schema of the variables."""
    try:
        doc = parse_json(body) if body else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict):
        return None
    out: Schema = {"type": "object", "description": graphql_operation(doc["query"]) if isinstance(doc.get("query"), str) else "graphql"}
    if doc.get("variables") is not None:
        out["properties"] = {"variables": from_value(doc["variables"])}
    return out


def infer_body(kind: str, body: bytes) -> Schema | None:
    """I1 on the kind that ``content.body_kind`` gives."""
    if not body:
        return None
    return {
        "json": from_json, "graphql": from_graphql, "form": from_form, "xml": from_xml,
        "multipart": lambda _: {"type": "object"}, "grpc": lambda _: {"type": "object", "description": "grpc"},
    }[kind](body)


def infer_pair(req_kind: str, resp_kind: str, req: bytes, resp: bytes) -> tuple[Schema | None, Schema | None]:
    """A JSON request that holds a query key is GraphQL, and so its response is described."""
    if not req and not resp:
        return None, None
    left, right = infer_body(req_kind, req), infer_body(resp_kind, resp)
    if req_kind == "json" and b'"query"' in req:
        graph = from_graphql(req)
        if graph is not None:
            left = graph
            if right is not None:
                right = {**right, "description": "graphql"}
    return left, right


def dump(schema: Schema | None) -> str | None:
    return None if schema is None else json.dumps(schema, separators=(",", ":"), ensure_ascii=False)


def flatten(schema: Schema | None, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, type) of the leaves; arrays are leaves, a bare root leaf has no path and goes."""
    if schema is None:
        return []
    props = schema.get("properties")
    if not props:
        return [(prefix, dump(schema))] if prefix else []
    return [leaf for name in sorted(props) for leaf in flatten(props[name], f"{prefix}.{name}" if prefix else name)]


def top_names(schema: Schema | None) -> list[str]:
    return sorted(schema.get("properties", {})) if schema and schema.get("type") == "object" else []


def parts(schema: Schema | None) -> tuple[str | None, list[dict], list[str]]:
    """Text, leaves and top-level names of a schema."""
    return dump(schema), [{"field_path": p, "type_json": t} for p, t in flatten(schema)], top_names(schema)


SMALL_BODY = 4096  # bytes up to which a body is worth remembering: 16 MB a worker at most


@lru_cache(4096)
def _small_side(kind: str, body: bytes) -> tuple[str | None, list[dict], list[str]]:
    return parts(infer_body(kind, body))


def side(kind: str, body: bytes) -> tuple[str | None, list[dict], list[str]]:
    """Equal small bodies (empty, fixed answers) are inferred once a worker."""
    return _small_side(kind, body) if len(body) <= SMALL_BODY else parts(infer_body(kind, body))


INFERRED = (
    "req_schema STRING, resp_schema STRING, req_fields ARRAY<STRUCT<field_path: STRING, type_json: STRING>>, "
    "resp_fields ARRAY<STRUCT<field_path: STRING, type_json: STRING>>, req_names ARRAY<STRING>"
)


def inferred(req_kind: Column, resp_kind: Column, req: Column, resp: Column) -> Column:
    """All inferred parts of a pair as one struct, by one Arrow-batched function."""

    @F.pandas_udf(INFERRED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for rk, sk, rb, sb in batches:
            rows = []
            for a, b, x, y in zip(rk, sk, rb, sb, strict=True):
                x, y = bytes(x or b""), bytes(y or b"")
                if a == "json" and b'"query"' in x:
                    left, right = map(parts, infer_pair(a, b, x, y))
                else:
                    left, right = side(a, x), side(b, y)
                rows.append((left[0], right[0], left[1], right[1], left[2]))
            yield pd.DataFrame(rows, columns=["req_schema", "resp_schema", "req_fields", "resp_fields", "req_names"])

    return run(req_kind, resp_kind, req, resp)


def auth_scheme(names: Column) -> Column:
    """Scheme of the first authorization header (a bare one is bearer)."""
    own = F.filter(F.transform(names, lambda h: F.lower(h)), lambda h: (h == "authorization") | h.startswith("authorization:"))
    first = F.try_element_at(own, F.lit(1))
    scheme = F.substring(first, F.lit(15), F.length(first))
    return F.when(first.isNull(), "none").when(first == "authorization", "bearer").when(scheme.isin("bearer", "basic", "apikey"), scheme).otherwise("other")


def fingerprint(names: Column, top: Column) -> Column:
    """``auth:<scheme>|body:<sorted top-level names>``."""
    return F.concat(F.lit("auth:"), auth_scheme(F.coalesce(names, F.array().cast("array<string>"))), F.lit("|body:"), F.array_join(F.array_sort(top), ","))


def in_jvm(pairs: DataFrame) -> DataFrame:
    """The columns of ``INFERRED`` as ``x``, without Python; XML and forms have no schema."""
    none, empty = F.array().cast("array<struct<field_path: string, type_json: string>>"), F.array().cast("array<string>")
    found = F.struct(F.col("req.schema").alias("req_schema"), F.col("resp.schema").alias("resp_schema"), F.coalesce("req.fields", none).alias("req_fields"), F.coalesce("resp.fields", none).alias("resp_fields"), F.coalesce("req.names", empty).alias("req_names"))
    return variants.inferred(pairs).withColumn("x", found)


def observe(pairs: DataFrame, body_limit: int = content.BODY_LIMIT, strip_query: bool = False, python: bool = True) -> DataFrame:
    """Captured pairs -> observations: names and types only, one row for each pair, no shuffle.

    Without python, JSON and GraphQL bodies are inferred from VARIANT values in the JVM (``variants``), and
    XML and forms get no schema; small equal bodies are remembered by the Arrow pass alone, which is faster.
    """
    req, resp = content.capped(F.col("req_body"), body_limit), content.capped(F.col("resp_body"), body_limit)
    kinds = {"req_kind": content.body_kind(F.col("req_content_type")), "resp_kind": content.body_kind(F.col("resp_content_type"))}
    base = pairs.select(
        "seq", "observed_at", F.upper("method").alias("method"), paths.normalize_path(F.col("raw_path"), strip_query).alias("path_pattern"), "raw_path",
        content.protocol(F.col("req_content_type"), req).alias("protocol"), "status_code", "latency_ms", "req_content_type", "resp_content_type",
        F.coalesce("req_headers", F.array().cast("array<string>")).alias("header_names"), paths.query_params(F.col("raw_path")).alias("param_names"),
        *[k.alias(name) for name, k in kinds.items()], req.alias("req_body"), resp.alias("resp_body"),
    )
    found = base.withColumn("x", inferred(F.col("req_kind"), F.col("resp_kind"), F.col("req_body"), F.col("resp_body"))) if python else in_jvm(base)
    return found.select(
        "seq", "observed_at", "method", "path_pattern", "raw_path", "protocol", "status_code", "latency_ms", "req_content_type", "resp_content_type",
        "x.req_schema", "x.resp_schema", "x.req_fields", "x.resp_fields", "header_names", "param_names", fingerprint(F.col("header_names"), F.col("x.req_names")).alias("fingerprint"),
    )


__all__ = ["dump", "flatten", "from_form", "from_graphql", "from_json", "from_value", "from_xml", "infer_body", "infer_pair", "observe", "string_format"]
