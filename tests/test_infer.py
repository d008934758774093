import datetime as dt
import json
import random

import pytest

from pyspark.sql import functions as F

from routeloom import types
from routeloom.operators import infer, variants


@pytest.mark.parametrize("body,want", [
    (b"null", {"nullable": True}), (b"true", {"type": "boolean"}), (b"1.0", {"type": "integer"}), (b"3.14", {"type": "number"}), (b"[]", {"type": "array", "items": {"type": "object"}}),
    (b"{}", {"type": "object"}), (b"", None), (b"{not valid}", None), (b"1e400", None), (b"NaN", None),
])
def test_json(body, want):
    assert infer.from_json(body) == want


def test_items():
    got = infer.from_json(b'[{"name":"a","email":"b"},{"name":"c"},{"name":"d","email":"e"}]')["items"]
    assert got["required"] == ["name"] and set(got["properties"]) == {"name", "email"}
    assert infer.from_json(b'[1,{"a":2}]')["items"] == {"type": "integer"}


def test_xml():
    got = infer.from_xml(b'<?xml version="1.0"?><p:product id="99"><title>x</title><tag>a</tag><tag>b</tag>text</p:product>')
    assert set(got["properties"]) == {"@id", "title", "tag", "_text"} and got["properties"]["tag"]["type"] == "array" and got["properties"]["@id"]["xml_attr"]
    assert infer.from_xml(b"<a>") is None and infer.from_xml(b"<a>x</a>") == {"type": "string"}


def test_form():
    got = infer.from_form(b"name=Bob&age=30&score=98.6&active=true&tags[]=go&tags[]=http&ids%5B%5D=1")["properties"]
    assert {k: v["type"] for k, v in got.items()} == {"name": "string", "age": "integer", "score": "number", "active": "boolean", "tags": "array", "ids": "array"}
    assert got["ids"]["items"] == {"type": "integer"} and infer.from_form(b"a=%zz") is None and infer.from_form(b"") is None


def test_graphql_and_pair():
    got = infer.from_graphql(b'{"query":"mutation M { a }","variables":{"x":1}}')
    assert got["description"] == "mutation" and got["properties"]["variables"]["properties"]["x"] == {"type": "integer"}
    left, right = infer.infer_pair("json", "json", b'{"query":"{ a }"}', b'{"data":1}')
    assert left["description"] == "query" and right["description"] == "graphql"
    assert infer.infer_pair("json", "json", b"", b"") == (None, None)


def test_flatten():
    got = dict(infer.flatten(infer.from_json(b'{"a":{"b":1,"c":[{"d":2}]},"e":{}}')))
    assert set(got) == {"a.b", "a.c", "e"} and infer.flatten(infer.from_json(b"[1]")) == [] and json.loads(got["a.b"]) == {"type": "integer"}


SCALARS = [None, True, 1, 2.5, 3.0, 1e20, 1e300, -7, 10**40, "", "x", "a@b.com", "2020-01-01", "2020-01-01T00:00:00Z", "1.2.3.4", "a:b", "http://x", "12345678-1234-1234-1234-1234567890ab"]
NAMES = ["a", "b", "\u00e9", "z.q", 'q"x', "", "n\n", "\U0001f600", "query", "variables"]


def random_value(rng, depth):
    r = rng.random()
    if depth > 0 and r < 0.35:
        return {rng.choice(NAMES): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth > 0 and r < 0.7:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))] if r < 0.55 else [{rng.choice("abc"): random_value(rng, depth - 2) for _ in range(rng.randint(0, 3))} for _ in range(rng.randint(1, 4))]
    return rng.choice(SCALARS)


ODD_BODIES = [
    b"", b" ", b"{", b'{"a":1} x', b"1 2", b"1}", b'1,"x":2', b"[1]]", b"NaN", b"1e999", b"[1,1e999]", b'["Infinity",1e400]', b'["Infinity",1e100]', b"01", b"1.", b"-", b"\xff",
    b'"\xff\xfe"', b'{"\xc3\x28":1}', b"{'a':1}", b"[1,]", b"// c\n1", b' \n\t{"a" : 1 } ', b"\xef\xbb\xbf1", b'"a\tb"', b"1e-400", b"-0", b"9" * 400, b'{"v":1}', b"tru", b"[" * 40 + b"]" * 40,
    b'{"query":"{ a }","variables":{"x":[1,{"y":null}]}}', b'{"query":"mutation M { a }","variables":null}', b'{"query":7,"variables":[]}', b'["query"]', b'"query"',
]


def test_jvm_schemas_equal_plain_ones(spark):
    rng = random.Random(7)
    bodies = [json.dumps(random_value(rng, rng.randint(0, 6)), ensure_ascii=rng.random() < 0.5).encode() for _ in range(250)] + ODD_BODIES + [None]
    kinds = [("json", "json"), ("graphql", "json"), ("json", "graphql"), ("multipart", "grpc")]
    rows = [(i, *kinds[i % 4 if i < 250 else 0], b, bodies[-i]) for i, b in enumerate(bodies)] + [(1000 + i, "graphql", "json", b, b) for i, b in enumerate(ODD_BODIES)]
    pairs = spark.createDataFrame(rows, "i int, req_kind string, resp_kind string, req_body binary, resp_body binary")
    got = {r.i: r for r in variants.inferred(pairs).select("i", "req", "resp").collect()}
    for i, a, b, x, y in rows:
        for want, found in zip(infer.infer_pair(a, b, x or b"", y or b""), (got[i].req, got[i].resp), strict=True):
            schema, fields, names = infer.parts(want)
            if schema is None:
                assert found is None or found.schema is None, (x, y)
            else:
                assert (found.schema, [f.asDict() for f in found.fields], found.names) == (schema, fields, names), (x, y)


def test_jvm_parser_refuses(spark):
    """What Spark's parser takes for no JSON has no schema: a repeated name, the end mark as a name, more than 1000 levels."""
    rows = [(bytearray(b),) for b in (b'{"a":1,"a":2}', b'{"routeloom.end":1}', b"[" * 1200 + b"]" * 1200)]
    assert [r.p for r in spark.createDataFrame(rows, "b binary").select(variants.parts(F.col("b"), F.lit(False)).alias("p")).collect()] == [None] * 3


def test_wide_and_hot_bodies(spark):
    """Thousands of names in one object, and of objects with names of their own in one array."""
    wide = json.dumps({f"k{i}": i for i in range(5000)}).encode()
    many = json.dumps([{f"k{i}": i, "all": 1} for i in range(3000)]).encode()
    df = spark.createDataFrame([(bytearray(wide),), (bytearray(many),)], "b binary")
    got = [r.s for r in df.select(variants.parts(F.col("b"), F.lit(False)).schema.alias("s")).collect()]
    assert got == [infer.dump(infer.from_json(wide)), infer.dump(infer.from_json(many))]


def test_observations_without_python(spark):
    rows = [(i, dt.datetime(2024, 1, 1), "POST", f"/a/{i}", kind, kind, 200, 1, bytearray(b), bytearray(b'{"ok":[1]}'), ["Accept"]) for kind in ("application/json", "application/graphql", None) for i, b in enumerate([b'{"a":{"b":1}}', b'{"query":"{ a }"}', b"[]", b"x"])]
    pairs = spark.createDataFrame(rows, types.PAIR)
    own = infer.observe(pairs, python=False)
    assert "Python" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, own.collect())) == sorted(map(str, infer.observe(pairs).collect()))
