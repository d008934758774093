"""Queries for the operators on single values (inference, schemas, merges, names) and their oracle SQL.

Every supplier runs each vector with ``@k`` replaced by its key, inside Arrow batches on the
executors; the expected results are written down by hand as SQL literals.
"""

from __future__ import annotations

import copy
import json
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.export import documents, merge, schema
from routeloom.operators import catalog, infer, report, variants
from routeloom.plans import adapters as A
from routeloom.plans.source_queries import quoted
from routeloom.scan import core, runner
from routeloom.sources import grpc

Case = tuple[list[str | None], str | None]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def text(v: Any) -> str | None:
    return None if v is None else json.dumps(v, sort_keys=True, ensure_ascii=False)


def vectors(name: str, f: Callable[..., str | None] | None, cases: list[Case], plan: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register f, or a plan over the column ``args``, over the cases: (supplier key, case number, result)."""
    width = max(len(args) for args, _ in cases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "n": b["n"], "result": [f(*[None if a is None else a for a in args][:len(cases[n][0])]) for n, args in zip(b["n"], b["args"], strict=True)]})

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        fill = lambda s: F.lit(None).cast("string") if s is None else F.replace(F.lit(s), F.lit("@k"), key)
        rows = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[fill(a) for a in (*args, *[None] * (width - len(args)))]).alias("args")) for n, (args, _) in enumerate(cases)])
        flat = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.explode(rows).alias("x")).select("k", "x.n", "x.args")
        return plan(flat) if plan else flat.mapInPandas(run, "k bigint, n int, result string")

    QUERIES[name] = query
    values = ", ".join(f"({n}, {quoted(want)})" for n, (_, want) in enumerate(cases))
    ORACLE_SQL[name] = f"SELECT s_suppkey::BIGINT AS k, n, replace(r, '@k', s_suppkey::VARCHAR) AS result FROM supplier, (VALUES {values}) v(n, r)"


def body(kind: str) -> Callable[[str | None], str | None]:
    return lambda s: text(infer.infer_body(kind, s.encode() if s is not None else b""))


def spaced(schema: Column) -> Column:
    """A schema as ``text`` writes it: VARIANT sorts the names."""
    return F.regexp_replace(F.to_json(F.try_parse_json(schema)), r'([:,])(?=["{\[tn])', "$1 ")


def pair_schemas(flat: DataFrame) -> DataFrame:
    arg = lambda i: F.get("args", F.lit(i))
    pairs = flat.select("k", "n", arg(0).alias("req_kind"), arg(1).alias("resp_kind"), arg(2).cast("binary").alias("req_body"), arg(3).cast("binary").alias("resp_body"))
    one = lambda c: F.coalesce(spaced(F.col(c)), F.lit("null"))
    return variants.inferred(pairs).select("k", "n", F.concat(F.lit("["), one("req.schema"), F.lit(", "), one("resp.schema"), F.lit("]")).alias("result"))


def json_schemas(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda flat: flat.select("k", "n", spaced(variants.side(F.lit(kind), F.get("args", F.lit(0)).cast("binary"), False).schema).alias("result"))


OBJECT = '{"type": "object"}'
vectors("i02_pair", None, plan=pair_schemas, cases=[
    (["json", "json", None, None], "[null, null]"), (["json", "json", '{"a@k": 1}', '{"b": "x"}'], '[{"properties": {"a@k": {"type": "integer"}}, "required": ["a@k"], "type": "object"}, {"properties": {"b": {"type": "string"}}, "required": ["b"], "type": "object"}]'),
    (["json", "json", '{"query": "mutation M { a }"}', '{"data": null}'], '[{"description": "mutation", "type": "object"}, {"description": "graphql", "properties": {"data": {"nullable": true}}, "required": ["data"], "type": "object"}]'),
])
vectors("i06_arrays", None, plan=json_schemas("json"), cases=[
    (["[]"], '{"items": {"type": "object"}, "type": "array"}'), (["[1, 2.5]"], '{"items": {"type": "integer"}, "type": "array"}'), (['["s@k"]'], '{"items": {"type": "string"}, "type": "array"}'),
    (['{"a@k": [[true]]}'], '{"properties": {"a@k": {"items": {"items": {"type": "boolean"}, "type": "array"}, "type": "array"}}, "required": ["a@k"], "type": "object"}'),
])
vectors("i07_array_objects", None, plan=json_schemas("json"), cases=[
    (['[{"name": "x", "email@k": "a@b.com"}, {"name": "y"}, {"name": "z", "email@k": "c@d.org"}]'], '{"items": {"properties": {"email@k": {"format": "email", "type": "string"}, "name": {"type": "string"}}, "required": ["name"], "type": "object"}, "type": "array"}'),
    (['[{"a": 1}, {"b": "@k"}]'], '{"items": {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}, "type": "object"}, "type": "array"}'),
])
vectors("i08_json", None, plan=json_schemas("json"), cases=[([None], None), (["{not valid @k}"], None), (["[1,2,3]"], '{"items": {"type": "integer"}, "type": "array"}'), (["NaN"], None), (["1e999"], None), (['"@k"'], '{"type": "string"}'), (["3.0"], '{"type": "integer"}')])
vectors("i09_xml", body("xml"), [
    (['<?xml version="1.0"?><user><name>x</name><email>e</email><address><street>s@k</street></address></user>'],
     '{"properties": {"address": {"properties": {"street": {"type": "string"}}, "type": "object"}, "email": {"type": "string"}, "name": {"type": "string"}}, "type": "object"}'),
    (["<users><user><id>1</id></user><user><id>2</id></user></users>"], '{"properties": {"user": {"items": {"properties": {"id": {"type": "string"}}, "type": "object"}, "type": "array"}}, "type": "object"}'),
    (['<product id="@k"><title>t</title></product>'], '{"properties": {"@id": {"type": "string", "xml_attr": true}, "title": {"type": "string"}}, "type": "object"}'), (["<a><b></a>"], None), (["<a>text @k</a>"], '{"type": "string"}'),
])
vectors("i10_form_body", body("form"), [
    (["name=Bob&age=30&score=98.6&active=true"], '{"properties": {"active": {"type": "boolean"}, "age": {"type": "integer"}, "name": {"type": "string"}, "score": {"type": "number"}}, "type": "object"}'),
    (["tags[]=go&tags[]=http@k"], '{"properties": {"tags": {"items": {"type": "string"}, "type": "array"}}, "type": "object"}'), (["ids%5B%5D=1&x@k="], '{"properties": {"ids": {"items": {"type": "integer"}, "type": "array"}, "x@k": {"type": "string"}}, "type": "object"}'), ([None], None), (["a=%zz"], None),
])
vectors("i11_graphql_body", None, plan=json_schemas("graphql"), cases=[
    (['{"query": "\\n\\tquery Q { a@k }"}'], '{"description": "query", "type": "object"}'), (['{"query": "mutation M($x: Int) { a }", "variables": {"x": 1}}'], '{"description": "mutation", "properties": {"variables": {"properties": {"x": {"type": "integer"}}, "required": ["x"], "type": "object"}}, "type": "object"}'),
    (['{"query": "{ a }", "variables": null}'], '{"description": "query", "type": "object"}'), (['{"query": "fragment F on T { a }"}'], '{"description": "graphql", "type": "object"}'), (['{"other": "@k"}'], '{"description": "graphql", "type": "object"}'), (["[1]"], None),
])
vectors("i12_grpc_types", lambda n: grpc.field_type(int(n)), [([str(i)], t) for i, t in enumerate("number number integer integer integer integer integer boolean string object object string integer string integer integer integer integer string".split(), 1)])
vectors("i13_type_names", lambda language, name: text(core.typed(language, name)), [
    (["zod", "date"], '{"format": "date-time", "type": "string"}'), (["python", "EmailStr"], '{"format": "email", "type": "string"}'), (["python", "List[int]"], '{"type": "array"}'), (["go", "*time.Time"], '{"format": "date-time", "type": "string"}'),
    (["go", "Thing@k"], OBJECT), (["csharp", "decimal"], '{"type": "number"}'), (["java", "List<User@k>"], OBJECT), (["java", "Long"], '{"type": "integer"}'), (["kotlin", "Set<Int>"], '{"type": "array"}'), (["rust", "&str"], '{"type": "string"}'), (["typescript", "Number"], '{"type": "number"}'), (["typescript", "Own@k"], OBJECT),
])


def stats(rows: str) -> list[dict]:
    """``location path seen total type`` lines as field statistics."""
    out = []
    for line in rows.split("; "):
        location, path, seen, total, kind = line.split(" ")
        out.append({"location": location, "field_path": path, "seen_count": int(seen), "total_calls": int(total), "type_json": json.dumps({"type": kind})})
    return out


FIELDS = "request name@k 3 3 string; request address.street 3 3 string; request address.city 1 3 string; request address.geo.lat 3 3 number; response id 3 3 integer"
vectors("n03_nest_location", lambda rows, side, at: text(schema.nest(stats(rows), side, float(at))), [
    ([FIELDS, "response", "0.9"], '{"properties": {"id": {"type": "integer"}}, "required": ["id"], "type": "object"}'), ([FIELDS, "other", "0.9"], None),
    ([FIELDS, "request", "0.9"], '{"properties": {"address": {"properties": {"city": {"type": "string"}, "geo": {"properties": {"lat": {"type": "number"}}, "required": ["lat"], "type": "object"}, "street": {"type": "string"}}, "required": ["street"], "type": "object"}, "name@k": {"type": "string"}}, "required": ["name@k"], "type": "object"}'),
    ([FIELDS, "request", "0.3"], '{"properties": {"address": {"properties": {"city": {"type": "string"}, "geo": {"properties": {"lat": {"type": "number"}}, "required": ["lat"], "type": "object"}, "street": {"type": "string"}}, "required": ["city", "street"], "type": "object"}, "name@k": {"type": "string"}}, "required": ["name@k"], "type": "object"}'),
])
vectors("n04_sample", lambda s: text(schema.sample(json.loads(s))), [
    (['{"type": "object", "properties": {"a@k": {"type": "string"}, "n": {"type": "integer"}, "f": {"type": "number"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "string"}}, "o": {"type": "object"}}}'], '{"a@k": "", "b": false, "f": 0, "l": [], "n": 0, "o": {}}'), (["null"], None), (["{}"], '""'),
])
vectors("n05_required", lambda s, rows: text(schema.annotate_required(json.loads(s), stats(rows), "request")), [
    (['{"type": "object", "properties": {"name@k": {"type": "string"}, "x": {}}, "required": ["x"]}', FIELDS], '{"properties": {"name@k": {"type": "string"}, "x": {}}, "required": ["name@k"], "type": "object"}'),
    (['{"type": "object", "properties": {"unknown": {}}, "required": ["unknown"]}', FIELDS], '{"properties": {"unknown": {}}, "required": ["unknown"], "type": "object"}'),
])
vectors("s07_host_name", catalog.host_name, [(["https://User:pw@Api.Example.com:8443/v@k/x?y#z"], "api.example.com"), (["api@k.example.com/path"], "api@k.example.com"), (["http://localhost:4000"], "localhost"), (["ws://a_b!c@k"], "abc@k")])
vectors("s07_dir_name", catalog.dir_name, [(["/Users/me/My App_@k/"], "users-me-my-app-@k"), (["./a"], "a"), (["///"], "")])
vectors("p10_collection_pattern", merge.item_pattern, [
    (["{{baseUrl}}/api/users/{{id}}/posts/{{postId}}"], "/api/users/{id}/posts/{postId}"), (["{{baseUrl}}/api/users?page=@k"], "/api/users?page=@k"), (["/plain/@k"], "/plain/@k"), (["{{host}}/x"], "{host}/x"),
])
vectors("f12_status_phrases", lambda c: report.STATUS.get(int(c), "Response"), [(["200"], "OK"), (["418"], "Response"), (["422"], "Unprocessable Entity"), (["504"], "Gateway Timeout"), (["204"], "No Content")])
vectors("e7_output_path", lambda fmt, title, out, own, directory, short: documents.output_path(fmt, title, out, {fmt: own} if own else None, directory, short), [
    (["curl", "My API @k", "o@k.sh", "own", "d", "s"], "o@k.sh"), (["curl", "My API", "", "own@k", "d", "s"], "own@k"), (["postman", "My API @k", "", "", "d@k/", "s"], "d@k/my-api-@k-postman.json"),
    (["bruno", "!!", "", "", "d", ""], "d/api-bruno"), (["openapi", "T", "", "", "", "s@k.yaml"], "s@k.yaml"), (["openapi", "T", "", "", "", ""], None),
])


def item(method: str, url: str, raw: str = "", name: str = "") -> dict:
    return {"name": name or f"{method} {url}", "request": {"method": method, "url": {"raw": "{{baseUrl}}" + url}, **({"body": {"mode": "raw", "raw": raw}} if raw else {})}}


def spec_merge(old: str, new: str) -> str:
    done, added = merge.merge_spec(json.loads(old), json.loads(new))
    return json.dumps([done, added], sort_keys=True)


def collection(pairs: str) -> dict:
    """``METHOD url body`` items, parted by `` ; ``."""
    return {"info": {"name": "c"}, "item": [item(*(p.split(" ", 2))) for p in pairs.split(" ; ") if p]}


def collection_diff(old: str, new: str) -> str:
    d = merge.diff_items(collection(old), collection(new))
    return json.dumps({"added": [merge.item_key(i) for i in d["added"]], "conflicts": [c[0] for c in d["conflicts"]], "unchanged": d["unchanged"]})


def collection_merge(old: str, new: str, how: str) -> str:
    done = merge.merge_collection(collection(old), collection(new), json.loads(how))
    return json.dumps([[merge.item_key(i), json.loads(merge.item_body(i) or "null")] for i in done["item"]])


vectors("g1_merge_spec", spec_merge, [
    (['{"paths": {"/a@k": {"get": {"summary": "mine"}}}}', '{"paths": {"/a@k": {"get": {"summary": "new"}, "post": {}}, "/b": {"put": {}}}}'], '[{"paths": {"/a@k": {"get": {"summary": "mine"}, "post": {}}, "/b": {"put": {}}}}, ["POST /a@k", "PUT /b"]]'),
    (["null", '{"openapi": "3.0.3", "paths": {"/a@k": {"get": {}}}}'], '[{"openapi": "3.0.3", "paths": {"/a@k": {"get": {}}}}, ["GET /a@k"]]'),
])
vectors("g2_collection_items", collection_diff, [
    (["", "GET /a@k"], '{"added": ["GET /a@k"], "conflicts": [], "unchanged": []}'), (["GET /a@k", "GET /a@k"], '{"added": [], "conflicts": [], "unchanged": ["GET /a@k"]}'),
    (['POST /u/{{id}} {"a": @k} ; GET /x?page=1', 'POST /u/{{id}} {"a": -1} ; GET /x?page=2'], '{"added": ["GET /x?page=2"], "conflicts": ["POST /u/{id}"], "unchanged": []}'),
])
vectors("g3_collection_merge", collection_merge, [
    (['POST /u {"name": "@k", "custom": 1}', 'POST /u {"name": "", "email": ""} ; GET /n', "{}"], '[["POST /u", {"name": "@k", "custom": 1}], ["GET /n", null]]'),
    (['POST /u {"name": "@k", "custom": 1}', 'POST /u {"name": "", "email": ""}', '{"POST /u": "merge"}'], '[["POST /u", {"custom": 1, "email": "", "name": "@k"}]]'),
    (['POST /u {"name": "@k", "custom": 1}', 'POST /u {"name": "", "email": ""}', '{"POST /u": "replace"}'], '[["POST /u", {"name": "", "email": ""}]]'),
])
vectors("g4_bruno_diff", lambda a, b: json.dumps(merge.diff_bruno(json.loads(a), json.loads(b))), [
    (['{"bruno.json": "x", "a@k.bru": "1", "b.bru": "1"}', '{"bruno.json": "y", "a@k.bru": "1", "b.bru": "2", "c.bru": "3"}'], '{"added": ["c.bru"], "conflicts": ["b.bru"], "unchanged": ["a@k.bru", "bruno.json"]}'),
])


def script(titles: str) -> str:
    return "#!/usr/bin/env bash\n" + "".join(f"\n{merge.RULE}\n# {t}\n{merge.RULE}\ncurl {t}\n" for t in titles.split(","))


def script_merge(old: str, new: str) -> str:
    done, added = merge.merge_script(script(old), script(new))
    return json.dumps([added, [line for line in done.split("\n") if line.startswith("curl")]])


vectors("g5_script_merge", script_merge, [
    (["GET /a@k,POST /b", "GET /a@k,DELETE /c@k"], '[["DELETE /c@k"], ["curl GET /a@k", "curl POST /b", "curl DELETE /c@k"]]'), (["GET /a", "GET /a"], '[[], ["curl GET /a"]]'),
])


def settings(*layers: str) -> str:
    out = copy.deepcopy(merge.defaults())
    for s in layers:
        out = merge.overlay(out, json.loads(s))
    return json.dumps([out["proxy"]["port"], out["export"]["min_calls"], out["export"]["info_title"], out["export"]["outputs"], out["path_overrides"], out["inference"]["confidence_threshold"]])


vectors("g6_settings", settings, [
    (["{}"], '[4000, 0, "Discovered API", {}, [], 0.9]'),
    (['{"proxy": {"port": 5000}, "export": {"outputs": {"curl": "a@k"}}, "path_overrides": ["x"]}', '{"proxy": {"port": 0}, "export": {"min_calls": 2, "outputs": {"postman": "b"}}, "path_overrides": ["y@k"]}'], '[5000, 2, "Discovered API", {"curl": "a@k", "postman": "b"}, ["x", "y@k"], 0.9]'),
])
vectors("s14_show_json", lambda s: report.show_json(json.loads(s), 1), [(['{"b": "@k", "a": [1]}'], '{\n "a": [\n  1\n ],\n "b": "@k"\n}'), (["null"], "null")])


def source_tree(framework: str, path: str) -> str:
    return str(core.applies(runner.REGISTRY[framework], path)).lower()


vectors("s09_tree_rules", source_tree, [
    (["express", "src/a@k.js"], "true"), (["express", "src/.hidden@k/a.js"], "true"), (["express", "node_modules/x@k/a.js"], "false"), (["express", "src/a@k.py"], "false"), (["express", ".git/a.js"], "false"),
    (["fastapi", "src/.hidden@k/a.py"], "false"), (["fastapi", "venv/a@k.py"], "false"), (["go-chi", "vendor/a@k.go"], "false"), (["spring", "a/target/X@k.java"], "false"), (["nextjs", "pages/api/a@k.tsx"], "true"),
])


def written(fmt: str, doc: str) -> str:
    """A document to a file and back."""
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/sub/doc.{documents.ENDINGS[fmt]}"
        if fmt == "bruno":
            documents.write(path, json.loads(doc))
            return text(merge.load_bruno(path))
        documents.write(path, documents.render(fmt, json.loads(doc)))
        return text([merge.load_document(path), merge.load_document(f"{folder}/none")])


vectors("s12_s13_documents", written, [
    (["openapi", '{"openapi": "3.0.3", "paths": {"/a@k": {}}}'], '[{"openapi": "3.0.3", "paths": {"/a@k": {}}}, null]'), (["postman", '{"info": {"name": "é@k"}, "item": []}'], '[{"info": {"name": "é@k"}, "item": []}, null]'),
    (["bruno", '{"bruno.json": "{}", "a@k.bru": "x", "b.txt": "y"}'], '{"a@k.bru": "x", "bruno.json": "{}"}'),
])
