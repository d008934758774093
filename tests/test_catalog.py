"""The catalogue's overlays: deletions, stamps, touches, streams through the capture filter."""

import datetime as dt

import pytest

from routeloom import types
from routeloom.engine import Engine

DAY = dt.datetime(2024, 1, 1)


def pair(seq, method, path, headers=()):
    return (seq, DAY + dt.timedelta(seconds=seq), method, path, "application/json", "application/json", 200, 1, None, bytearray(b'{"a":1}'), list(headers))


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "cat"))


def calls(e):
    return {(r.method, r.path_pattern): r.call_count for r in e.store.endpoints().collect()}


def test_delete_survives_replay(spark, engine):
    rows = spark.createDataFrame([pair(1, "DELETE", "/api/things/1"), pair(2, "GET", "/a"), pair(3, "GET", "/a")], types.PAIR)
    engine.ingest(rows, batch="b1")
    engine.annotate("GET", "/a", "old words")
    engine.delete("delete", "/api/things/{id}")
    engine.delete("GET", "/a")
    assert calls(engine) == {} and engine.store.export_rows().count() == 0
    engine.ingest(rows, batch="b1")  # the same batch again
    assert calls(engine) == {}
    engine.ingest(spark.createDataFrame([pair(4, "GET", "/a")], types.PAIR))
    assert calls(engine) == {("GET", "/a"): 1} and engine.store.endpoints().first().description == ""


def test_scan_after_delete(spark, engine):
    scanned = lambda line: spark.createDataFrame([("GET", "/s", "rest", "express", "a.js", line, None, None, [], f"v{line}", [], [], False, False)], types.SCANNED)
    engine.store.add_scan(scanned(1))
    engine.store.add_scan(scanned(2))
    assert engine.store.endpoints().first().description == "v2" and engine.store.table("scans").count() == 2
    engine.delete("GET", "/s")
    assert calls(engine) == {}
    engine.store.add_scan(scanned(3))
    assert engine.store.endpoints().first().source_line == 3


def test_stamps_differ():
    from routeloom.operators.catalog import CatalogStore

    stamps = [CatalogStore.stamp() for _ in range(50)]
    assert stamps == sorted(stamps, key=lambda s: s >> 10) and len(set(stamps)) > 45


def test_touch(spark, engine):
    engine.ingest(spark.createDataFrame([pair(1, "GET", "/a")], types.PAIR))
    engine.store.touch("get", "/a", source="scan")
    engine.store.touch("POST", "/b", "grpc", "scan")
    got = {(r.method, r.path_pattern): (r.call_count, r.source, r.protocol) for r in engine.store.endpoints().collect()}
    assert got == {("GET", "/a"): (2, "scan+obs", "rest"), ("POST", "/b"): (1, "scan", "grpc")}


def test_overlays(spark, engine):
    engine.ingest(spark.createDataFrame([pair(1, "GET", "/a")], types.PAIR))
    engine.annotate("get", "/a", "first", ["x"])
    engine.annotate("GET", "/a", "", ["y", "z"])
    row = engine.store.endpoints().first()
    assert (row.description, row.tags) == ("first", ["y", "z"])
    engine.store.override_path("GET", "/x/", "/x/{one}")
    engine.store.override_path("GET", "/x/", "/x/{two}")
    assert engine.store.overrides().first().override_pattern == "/x/{two}"
    v = engine.store.variants().first()
    engine.label_variant("GET", "/a", v.fingerprint, "mine")
    assert engine.store.variants().first().label == "mine"
    engine.clear()
    assert calls(engine) == {}


def test_stream_captures_as_batch_does(spark, engine, tmp_path):
    spark.createDataFrame([pair(1, "GET", "/a", ["Cookie", "sec-fetch", "x-tenant"]), pair(2, "GET", "/health", [])], types.PAIR).write.parquet(str(tmp_path / "in"))
    engine.ingest_stream(str(tmp_path / "in"), str(tmp_path / "ck"), ignore="/health").awaitTermination()
    (row,) = engine.store.observations().collect()
    assert row.raw_path == "/a" and row.header_names == ["X-Tenant"]
