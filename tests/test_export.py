import datetime as dt
import json

import pytest
import yaml

from routeloom import types
from routeloom.engine import Engine
from routeloom.export import documents, merge
from routeloom.export.schema import annotate_required, nest, sample
from routeloom.sources.scratch import settled

DAY = dt.datetime(2024, 1, 1)


def f(location, path, seen, total, kind="string"):
    return {"location": location, "field_path": path, "seen_count": seen, "total_calls": total, "type_json": json.dumps({"type": kind})}


def test_nest():
    rows = [f("request", "name", 3, 3), f("request", "address.street", 3, 3), f("request", "address.city", 1, 3), f("request", "address.geo.lat", 3, 3, "number"), f("response", "id", 3, 3)]
    doc = nest(rows, "request")
    assert doc["required"] == ["name"] and doc["properties"]["address"]["required"] == ["street"] and "id" not in doc["properties"]
    assert sample(doc) == {"address": {"city": "", "geo": {"lat": 0}, "street": ""}, "name": ""} and nest(rows, "other") is None
    again = annotate_required({"type": "object", "properties": {"name": {}, "x": {}}, "required": ["x"]}, rows, "request")
    assert again["required"] == ["name"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("cat")))
    ct = "application/json"
    rows = [
        (1, DAY, "POST", "/users/42", ct, ct, 201, 1, bytearray(b'{"name":"a","email":"b","age":3}'), bytearray(b'{"id":1}'), ["Accept"]),
        (2, DAY, "POST", "/users/43", ct, ct, 201, 1, bytearray(b'{"name":"a","email":"b"}'), bytearray(b'{"id":1}'), ["Accept", "Authorization"]),
        (3, DAY, "GET", "/items?page=2", "", ct, 200, 1, None, bytearray(b"[1]"), []),
    ]
    e.ingest(spark.createDataFrame(rows, types.PAIR))
    return e


def test_openapi(engine):
    doc = engine.export("openapi")
    op = doc["paths"]["/users/{id}"]["post"]
    schema = op["requestBody"]["content"]["application/json"]["schema"]
    assert schema["required"] == ["email", "name"] and list(op["responses"]) == ["201"] and len(op["x-variants"]) == 2
    assert doc["paths"]["/items?page=2"]["get"]["parameters"][0]["name"] == "page"
    assert yaml.safe_load(documents.render("openapi", doc)) == json.loads(documents.render("openapi-json", doc))
    assert engine.export("swagger")["paths"]["/users/{id}"]["post"]["parameters"][1]["in"] == "body"


def test_postman_and_scripts(engine):
    items = engine.export("postman")["item"]
    assert len(items) == 3 and sum("/users/{id}" in i["name"] for i in items) == 2 and any("(authenticated)" in i["name"] for i in items)
    script = engine.export("curl")
    assert "curl -s -X POST \"$BASE_URL/users/$id\"" in script and "# set id before running" in script
    assert "<<'EOF'" in engine.export("httpie") and "post-users-id.bru" in engine.export("bruno")


def test_merges(engine):
    doc = engine.export("openapi")
    one, added = merge.merge_spec({"paths": {"/users/{id}": {"get": {}}}}, doc)
    assert set(added) == {"POST /users/{id}", "GET /items?page=2"} and merge.merge_spec(one, doc)[1] == [] and merge.merge_spec(None, doc)[0]["openapi"]
    col = engine.export("postman")
    assert merge.diff_items({"item": []}, col)["added"] == col["item"] and merge.merge_collection(col, col)["item"] == col["item"]
    old = json.loads(json.dumps(col))
    target = next(i for i in old["item"] if "body" in i["request"])
    target["request"]["body"]["raw"] = '{"name": "kept", "custom": 1}'
    key = merge.item_key(target)
    done = next(i for i in merge.merge_collection(old, col, {key: "merge"})["item"] if merge.item_key(i) == key)
    body = json.loads(done["request"]["body"]["raw"])
    assert body["name"] == "kept" and body["custom"] == 1 and "email" in body
    script = engine.export("curl")
    blocks = merge.script_blocks(script)
    part, added = merge.merge_script(script.replace(blocks[0][1], ""), script)
    assert added == [blocks[0][0]] and "curl -s" in part.split(blocks[0][0])[1] and merge.merge_script(part, script)[1] == []
    files = engine.export("bruno")
    assert merge.diff_bruno({"bruno.json": "x", "post-users-id.bru": "y"}, files)["conflicts"] == ["post-users-id.bru"]
    assert merge.overlay(merge.defaults(), {"export": {"min_calls": 2}, "path_overrides": [1]})["export"]["min_calls"] == 2


def test_output_path():
    assert documents.output_path("curl", out="x") == "x" and documents.output_path("curl", outputs={"curl": "y"}, output_dir="d") == "y"
    assert documents.output_path("curl", "My API", output_dir="d/") == "d/my-api-curl.sh" and documents.output_path("curl") is None


def test_commands(engine, spark, tmp_path):
    assert engine.stats() == {"observed": 2, "scan": 0, "scan+obs": 0, "total": 2}
    assert [r.path for r in engine.list_endpoints(cols=["path", "calls"]).collect()] == ["/items?page=2", "/users/{id}"]
    shown = engine.show("post", "/users/{id}", calls=5)
    assert len(shown["calls"]) == 2 and len(shown["variants"]) == 2 and engine.show("GET", "/none") is None
    src = tmp_path / "app"
    src.mkdir()
    (src / "a.js").write_text("app.post('/users/:id', f)\napp.get('/new', g)\n")
    engine.scan(str(src), ["express"])
    assert engine.stats() == {"observed": 1, "scan": 1, "scan+obs": 1, "total": 3}


def test_descriptors(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2

    from routeloom.sources.grpc import read_descriptors

    s = descriptor_pb2.FileDescriptorSet()
    file = s.file.add(name="a.proto", package="p")
    m = file.message_type.add(name="M")
    m.field.add(name="x", type=5)
    svc = file.service.add(name="S")
    svc.method.add(name="Do", input_type=".p.M", output_type=".p.M")
    (tmp_path / "d.pb").write_bytes(s.SerializeToString())
    row = read_descriptors(spark, str(tmp_path)).first()
    assert row.path_pattern == "/p.S/Do" and json.loads(row.req_schema)["properties"]["x"] == {"type": "integer"}


@pytest.fixture(scope="module")
def export_rows(engine):
    return settled(engine.store.export_rows())


@pytest.mark.parametrize("fmt", ["openapi", "openapi-json", "swagger", "postman", "curl", "httpie", "bruno"])
@pytest.mark.parametrize("calls", [0, 99])
def test_files_from_parts(export_rows, tmp_path, fmt, calls):
    """A file put together from sorted parts says what the document on the driver says, also without any endpoint."""
    opts = documents.Options(title="Ä \"t\"", min_calls=calls)
    want, path = documents.build(export_rows, fmt, opts), str(tmp_path / "doc")
    documents.write_document(export_rows, fmt, path, opts)
    if fmt == "bruno":
        assert {p.name: p.read_text() for p in (tmp_path / "doc").iterdir()} == want and all(documents.SEQ not in t for t in want.values())
    else:
        text = (tmp_path / "doc").read_text()
        assert text == documents.render(fmt, want)


def test_export_to_a_file(engine, tmp_path):
    assert engine.export("curl", out=str(tmp_path / "r.sh")) is None and (tmp_path / "r.sh").read_text() == engine.export("curl")


def test_ranks(spark):
    from routeloom.operators.ranks import with_rank

    rows = [(k * 7919 % 1000, "x") for k in range(1000)] + [(5, "x")]
    got = with_rank(spark.createDataFrame(rows, "k long, rank_ string"), "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.rank)] == sorted(k for k, _ in rows) and [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 1002))
