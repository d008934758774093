"""Snapshots: two writers and a reader, replays, merged states, removal of old folders; range tree and live state against plain counts."""

import datetime as dt
import random
import threading
from collections import Counter
from pathlib import Path

import pytest

from routeloom import types
from routeloom.engine import Engine
from routeloom.operators import fold, infer
from routeloom.operators.catalog import CatalogStore
from routeloom.sources import capture
from routeloom.sources.snapshots import Folder, Snapshots
from routeloom.streaming import live

DAY = dt.datetime(2024, 1, 1)


def pair(seq, method="GET", path="/a", headers=()):
    return (seq, DAY + dt.timedelta(seconds=seq), method, path, "application/json", "application/json", 200, 1, None, bytearray(b'{"a":1}'), list(headers))


def observed(spark, rows):
    return infer.observe(capture.capture(spark.createDataFrame(rows, types.PAIR)))


def test_one_of_two_writers_is_first(spark, tmp_path):
    snaps = [Snapshots(spark, str(tmp_path / "s")) for _ in range(2)]
    names = [[], []]

    def write(k):
        for i in range(12):
            snaps[k].commit(lambda version, live: [*live, Folder("t", f"{k}-{i}", f"f{k}-{i}", version)])
            names[k].append((k, i))

    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append({f.batch for f in Snapshots(spark, str(tmp_path / "s")).load()[1]})

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    reader = threading.Thread(target=read)
    for t in [reader, *threads]:
        t.start()
    for t in threads:
        t.join()
    done.set()
    reader.join()
    version, live_ = snaps[0].load()
    assert version == 24 and {f.batch for f in live_} == {f"{k}-{i}" for k in range(2) for i in range(12)} and sorted(f.since for f in live_) == list(range(1, 25))
    assert all(a <= b for a, b in zip(seen, seen[1:], strict=False))


def test_readers_never_miss_a_replayed_batch(spark, tmp_path):
    a, b = (CatalogStore(spark, str(tmp_path)) for _ in range(2))
    rows = [pair(1), pair(2)]
    a.record(observed(spark, rows), "one")
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(b.table("observations").count())

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(3):
        a.record(observed(spark, rows), "one")
    done.set()
    reader.join()
    assert seen and set(seen) == {2}
    assert len(list(Path(f"{tmp_path}/catalog=default/observations").iterdir())) == 4
    a.snapshots.vacuum(0)
    assert len(list(Path(f"{tmp_path}/catalog=default/observations").iterdir())) == 1 and b.table("observations").count() == 2


def test_states_say_what_the_log_says(spark, tmp_path):
    r = random.Random(4)
    heads = [["Accept"], ["Accept", "Accept", "X-A"], [], ["Authorization"]]
    rows = [pair(s, r.choice(["GET", "POST"]), r.choice(["/a", "/b?x=1", "/c/7"]), r.choice(heads)) for s in r.sample(range(40_000), 300)]
    e = Engine(spark, str(tmp_path))
    for k in range(3):
        e.store.record(observed(spark, rows[k::3]), f"b{k}")
    flat = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))

    def check():
        log, state = e.store.observations(), e.store.states()
        for got, want in (
            (fold.endpoints_of(state), fold.endpoints(log)), (fold.presence_of(state, "field"), fold.fields(log)), (fold.presence_of(state, "variant_field"), fold.variant_fields(log)),
            (fold.presence_of(state, "header"), fold.headers(log)), (fold.presence_of(state, "param"), fold.query_params(log)), (fold.variants_of(state), fold.variants(log)),
            (fold.raw_paths_of(state), fold.raw_paths(log)), (fold.status_codes_of(state), fold.status_codes(log)),
        ):
            assert flat(got.select(want.columns)) == flat(want)

    check()
    assert e.store.compact() and e.store.compact() is None
    e.store.record(observed(spark, rows[1::3]), "b1")
    e.delete("GET", "/a")
    e.store.record(observed(spark, [pair(5), pair(41_000)]), "late")
    check()
    shown = e.show("get", "/a", 5)
    assert shown["call_count"] == 2 and [c["seq"] for c in shown["calls"]] == [41_000, 5]


def test_range_tree_counts(spark):
    r = random.Random(8)
    seqs = sorted(r.sample(range(1 << 12), 400) + [r.randrange(1 << 62) for _ in range(200)] + [(1 << 40) + k for k in range(300)])
    obs = spark.createDataFrame([("GET", "/x", s) for s in seqs], "method string, path_pattern string, seq long")
    ask = [*r.sample(seqs, 60), 0, 1 << 62, (1 << 40) - 1, (1 << 61) + 5]
    points = spark.createDataFrame([("GET", "/x", s) for s in ask] + [("GET", "/none", 3)], "method string, path_pattern string, born long")
    got = {(x.path_pattern, x.born): x.since for x in fold.calls_since(obs, points).collect()}
    assert got == {**{("/x", a): sum(s >= a for s in seqs) for a in ask}, ("/none", 3): 0}


@pytest.mark.parametrize("shards", [1, 4])
def test_live_state(spark, tmp_path, shards):
    """Repeated and reordered pairs over two runs of the stream; rows of one endpoint over several shards add up."""
    r = random.Random(shards)
    rows = [pair(s, "GET", f"/a?p{s % 3}=1", ["Accept"] * (s % 3)) for s in r.sample(range(9000), 60)]
    store = CatalogStore(spark, str(tmp_path))
    stream = lambda: spark.readStream.schema(types.PAIR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (rows[30:], rows[:40] + rows[:5]):
        spark.createDataFrame(part, types.PAIR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.live_totals(stream(), store, str(tmp_path / "ck"), shards=shards).awaitTermination()
    flat = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    log = observed(spark, rows)

    def check():
        state = live.live_states(store)
        for got, want in ((fold.endpoints_of(state), fold.endpoints(log)), (fold.presence_of(state, "header"), fold.headers(log)), (fold.presence_of(state, "param"), fold.query_params(log)), (fold.presence_of(state, "field"), fold.fields(log))):
            assert flat(got.select(want.columns)) == flat(want)

    check()
    before = store.table("live").count()
    assert live.compact_live(store) and store.table("live").count() < before
    check()


def test_repeats_within_the_watermark(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "cat"))
    rows = [pair(s) for s in range(20)]
    for part in (rows[10:], rows[5:15], rows[:10]):
        spark.createDataFrame(part, types.PAIR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(types.PAIR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from routeloom.streaming import fold as streams

    streams.ingest_stream(stream, e.store, str(tmp_path / "ck"), delay="1 hour").awaitTermination()
    assert Counter(x.seq for x in e.store.observations().select("seq").collect()) == Counter(range(20))
    assert e.store.endpoints().first().call_count == 20
