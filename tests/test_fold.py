"""Closed forms against a sequential replay of the same log."""

import datetime as dt
import random

import pytest

from routeloom.operators import fold, infer
from routeloom.operators.catalog import CatalogStore, skeleton_fields
from routeloom import types

DAY = dt.datetime(2024, 1, 1)


def pair(seq, path, body=None, resp=None, headers=(), method="GET", status=200, ct="application/json"):
    return (seq, DAY + dt.timedelta(seconds=seq), method, path, ct, ct, status, 5, bytearray(body) if body else None, bytearray(resp) if resp else None, list(headers))


def random_pairs(n, seed):
    r = random.Random(seed)
    out = []
    for seq in sorted(r.sample(range(10 * n * 5000), n)):
        names = [k for k in "abc" if r.random() < 0.4]
        body = ("{" + ",".join(f'"{k}":{r.choice(["1", chr(34) + "x" + chr(34), "true"])}' for k in names) + "}").encode()
        out.append(pair(seq, f"/k{r.randrange(4)}" + r.choice(["", "?p=1", "?p=1&q=2"])[: r.randrange(2) * 9], body if r.random() < 0.8 else None, b'{"ok":1}', r.choices(["Accept", "X-A", "Authorization:basic"], k=r.randrange(4))))
    return out


def replay(obs):
    fields, headers, params = {}, {}, {}
    for o in sorted(obs, key=lambda o: o["seq"]):
        key = (o["method"], o["path_pattern"])
        seen = [("request", f["field_path"], f["type_json"]) for f in o["req_fields"] or []] + [("response", f["field_path"], f["type_json"]) for f in o["resp_fields"] or []]
        for k, row in fields.items():
            if k[:2] == key and k[2:] not in [s[:2] for s in seen]:
                row[1] += 1
        for loc, path, kind in seen:
            row = fields.setdefault((*key, loc, path), [0, 0, ""])
            row[:] = [row[0] + 1, row[1] + 1, kind]
        for table, names in ((headers, o["header_names"]), (params, o["param_names"])):
            for k, row in table.items():
                if k[:2] == key and k[2] not in names:
                    row[1] += 1
            for n in names:
                row = table.setdefault((*key, n), [0, 0])
                row[:] = [row[0] + 1, row[1] + 1]
    return fields, headers, params


def test_presence_matches_replay(spark):
    obs = infer.observe(spark.createDataFrame(random_pairs(300, 1), types.PAIR)).cache()
    fields, headers, params = replay([r.asDict(recursive=True) for r in obs.collect()])
    assert {(r.method, r.path_pattern, r.location, r.field_path): [r.seen_count, r.total_calls, r.type_json] for r in fold.fields(obs).collect()} == fields
    assert {(r.method, r.path_pattern, r.name): [r.seen_count, r.total_calls] for r in fold.headers(obs).collect()} == headers
    assert {(r.method, r.path_pattern, r.name): [r.seen_count, r.total_calls] for r in fold.query_params(obs).collect()} == params


def test_birth_ordinal_and_presence(spark):
    rows = [pair(1, "/api/users", resp=b'{"a":1}'), pair(2, "/api/users"), pair(3, "/api/users", resp=b'{"a":1,"b":2}')]
    obs = infer.observe(spark.createDataFrame(rows, types.PAIR))
    assert {r.field_path: (r.seen_count, r.total_calls) for r in fold.fields(obs).collect()} == {"a": (2, 3), "b": (1, 1)}


def test_variants_and_labels(spark):
    rows = [pair(1, "/api/login", b'{"email":1,"password":2}', method="POST"), pair(2, "/api/login", b'{"token":1}', method="POST"), pair(3, "/api/login", b'{"token":1}', method="POST", headers=["Authorization"])]
    obs = infer.observe(spark.createDataFrame(rows, types.PAIR))
    assert {r.fingerprint: r.label for r in fold.variants(obs).collect()} == {"auth:none|body:email,password": "password-login", "auth:none|body:token": "token-login", "auth:bearer|body:token": "authenticated"}


def test_skeleton(spark):
    obs = infer.observe(spark.createDataFrame([pair(i, "/a", resp=b'{"x":1}') for i in range(1, 5)], types.PAIR))
    scans = spark.createDataFrame([("GET", "/a", "response", "x", "{}", 0), ("GET", "/a", "response", "y", "{}", 99), ("GET", "/b", "request", "z", "{}", 0)], "method string, path_pattern string, location string, field_path string, type_json string, born bigint")
    got = {(r.path_pattern, r.field_path): (r.seen_count, r.total_calls) for r in skeleton_fields(scans, fold.fields(obs), obs).collect()}
    assert got == {("/a", "x"): (4, 4), ("/a", "y"): (0, 0), ("/b", "z"): (0, 0)}


def test_no_values_in_the_log(spark):
    obs = infer.observe(spark.createDataFrame([pair(1, "/a", b'{"name":"secret-value-1"}', b'{"pin":"secret-value-2"}')], types.PAIR))
    assert "secret-value" not in str(obs.collect())


def test_store(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    assert store.endpoints().count() == 0
    obs = infer.observe(spark.createDataFrame([pair(1, "/api/things/1", method="DELETE"), pair(2, "/api/users")], types.PAIR))
    store.record(obs, "a")
    store.record(obs, "a")  # a replayed batch counts once
    assert {r.path_pattern: r.call_count for r in store.endpoints().collect()} == {"/api/things/{id}": 1, "/api/users": 1}
    store.annotate("get", "/api/users", "All users", ["u"])
    store.annotate("get", "/api/users", "", None)
    store.label_variant("GET", "/api/users", "auth:none|body:", "plain")
    row = next(r for r in store.endpoints().collect() if r.path_pattern == "/api/users")
    assert row.description == "All users" and row.tags == ["u"] and row.source == "observed"
    assert [r.label for r in store.variants().where("path_pattern = '/api/users'").collect()] == ["plain"]
    store.override_path("GET", "/x", "/y")
    assert store.overrides().count() == 1
    store.delete("DELETE", "/api/things/{id}")
    assert [r.path_pattern for r in store.endpoints().collect()] == ["/api/users"]
    store.clear()
    assert store.observations().count() == 0


@pytest.mark.parametrize("parts", [3])
def test_stream_equals_batch(spark, tmp_path, parts):
    from routeloom.streaming import fold as streams

    pairs = spark.createDataFrame(random_pairs(60, 2), types.PAIR)
    pairs.repartition(parts).write.parquet(str(tmp_path / "in"))
    store = CatalogStore(spark, str(tmp_path / "cat"))
    q = streams.ingest_stream(streams.pair_stream(spark, str(tmp_path / "in"), max_files=1), store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(fold.fields(store.observations())) == key(fold.fields(infer.observe(pairs)))


LOG = "seq long, observed_at timestamp, method string, path_pattern string, raw_path string, protocol string, status_code int, latency_ms long, req_fields array<struct<field_path:string,type_json:string>>, resp_fields array<struct<field_path:string,type_json:string>>, header_names array<string>, param_names array<string>, fingerprint string"


def log(spark, rows):
    """rows: (seq, path, [(field, type)], [header])"""
    return spark.createDataFrame([(s, DAY, "GET", p, p, "rest", 200, 1, f, None, h, None, "v") for s, p, f, h in rows], LOG)


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


ODD = [
    (5, "/a", [("x", "t1"), (None, "t0")], ["H", None, "H"]), (9, "/a", [("x", "t2")], None), (9, "/a", [("x", "t2")], None), (12, "/a", [("x", None), ("y", "t1")], ["H"]),
    (None, "/a", [("x", "t9"), ("lost", "t9")], ["H", "G"]), (7, None, [("x", "t1")], ["H"]), (-3000, "/a", [("z", "t1")], []), (1 << 61, "/a", [], None), (4, "/b", None, None),
]
# the newest type counts, also a null one; a field, header or path without name or number has no row
ODD_FIELDS = {("/a", "x"): (5, 6 - 1, None), ("/a", "y"): (1, 2, "t1"), ("/a", "z"): (1, 6, "t1")}


def presence(df):
    return {(r.path_pattern, r.field_path): (r.seen_count, r.total_calls, r.type_json) for r in df.collect()}


def test_odd_rows_count_as_before(spark):
    got = presence(fold.fields(log(spark, ODD)))
    assert got == presence(fold.presence_of(fold.states(log(spark, ODD)), "field")) == {**ODD_FIELDS, ("/a", None): (1, 5, "t0")}
    assert {r.name: (r.seen_count, r.total_calls) for r in fold.headers(log(spark, ODD)).where("path_pattern = '/a' and name is not null").collect()} == {"H": (4, 6)}


def test_births_are_counted_once(spark):
    fields = fold.fields(log(spark, ODD))
    assert plan(fields).count("Generate explode(array(") == 1
    assert presence(fields)[("/a", "z")] == (1, 6, "t1")


def test_levels_above_the_log_are_left_out(spark):
    levels = lambda seqs: fold.span(spark.createDataFrame([(s >> fold.LEAF_BITS,) for s in seqs], "r long")).first().levels
    assert levels([0, 1000]) == [0] and levels([3, 1 << 20]) == [0] and levels([3, 1 << 30]) == [0, 1] and levels([-1, 5]) == [0, 1, 2, 3, 4] and levels([]) == [0]


def test_points_beside_the_log(spark):
    points = spark.createDataFrame([("/a", 11), ("/a", -(1 << 40)), ("/a", 1 << 62), ("/none", 5), ("/b", 5), ("/b", 4), ("/a", None)], "path_pattern string, born long").selectExpr("'GET' AS method", "*")
    ask = lambda rows: {(r.path_pattern, r.born): r.since for r in fold.calls_since(log(spark, rows), points).collect()}
    assert ask(ODD) == {("/a", 11): 2, ("/a", -(1 << 40)): 6, ("/a", 1 << 62): 0, ("/none", 5): 0, ("/b", 5): 0, ("/b", 4): 1, ("/a", None): None}
    assert set(ask([]).values()) == {0, None}


def test_birth_whose_range_is_gone(spark):
    state = fold.states(log(spark, [(5, "/a", [("x", "t")], []), (5000, "/a", [("x", "t")], []), (9000, "/a", [], [])]))
    got = presence(fold.presence_of(state.where("kind <> 'leaf' or r > 0"), "field"))  # as after a deletion while a stream's counters go on
    assert got == {("/a", "x"): (2, 2, "t")}


def test_counting_sorts_no_sightings(spark):
    """max_by of a text needs sorted rows: it gets one for each text, not one for each sighting."""
    rows = log(spark, ODD)
    for df in (fold.fields(rows), fold.variant_fields(rows)):
        lines = [x for x in plan(df, "sparkPlan").splitlines() if "SortAggregate" in x]
        assert lines and not any("count(1)" in x for x in lines)


def test_states_sort_texts_only(spark):
    obs = log(spark, ODD)
    lines = plan(fold.states(obs), "sparkPlan").splitlines()
    below = [lines[k + 1] for k, x in enumerate(lines) if "SortAggregate" in x and "partial_max_by" in x]
    assert len(below) == 1 and "HashAggregate" in below[0]  # over counted texts, not over sightings
    state = fold.states(obs)
    for df in (state, fold.merge_states(state.unionByName(fold.states(log(spark, [(50, "/a", [("x", "t5")], ["G"])]))))):
        got = {(r.kind, r.path_pattern, r.name): (r.n, r.more, r.born, r.text, r.text_at) for r in df.where("kind in ('endpoint', 'path', 'header', 'field')").collect()}
        new = df is not state
        assert got[("field", "/a", "x")] == ((6, 0, 5, "t5", 50) if new else (5, 0, 5, None, 12))
        assert got[("header", "/a", "H")] == (4, 1, 5, None, 12) and got[("field", "/a", "lost")] == (1, 0, None, None, None)
        assert got[("path", "/a", "/a")] == ((8, 0, -3000, None, 1 << 61) if new else (7, 0, -3000, None, 1 << 61))
        assert got[("endpoint", "/a", None)] == ((8, 0, -3000, "rest", 3000) if new else (7, 0, -3000, "rest", 3000))
