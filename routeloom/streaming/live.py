"""State mode (S3): running totals of fields, headers, parameters and variants, kept in the state of the stream.

The state of an endpoint is what ``fold.states`` says of a batch: counters with their births, and the
sequence numbers seen, two bytes each, by ranges. A pair that the source repeats is known by its
number and not counted again, in this batch or in any later one; a late pair moves a birth back and
counts from there. So totals are those of a batch over the same pairs, in whatever order they come.

Endpoints are dealt over SHARDS keys by range, so that a hot one is not one task's work, and the
shards' states add up. Each micro-batch publishes the rows that changed under its id: replayed, it
takes its own place, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from routeloom.operators import fold, infer
from routeloom.operators.catalog import CatalogStore
from routeloom.sources import capture

SHARDS = 16
CHANGED = (
    "method STRING, path_pattern STRING, shard INT, kind STRING, fingerprint STRING, location STRING, name STRING, n BIGINT, more BIGINT, born BIGINT, "
    "first_us BIGINT, last_us BIGINT, text STRING, text_at BIGINT, r BIGINT, seqs ARRAY<BIGINT>"
)
NAMES = [c.split()[0] for c in CHANGED.split(", ")]


def sightings(row: Any) -> Iterator[tuple[tuple, int, str | None, int]]:
    """What one observation says: (kind, fingerprint, location, name), times, text, the text's rank."""
    fp, seq = row.fingerprint, int(row.seq)
    yield ("endpoint", None, None, None), 1, row.protocol, -seq
    yield ("path", None, None, row.raw_path), 1, None, seq
    yield ("variant", fp, None, None), 1, None, seq
    for side, found in (("request", row.req_fields), ("response", row.resp_fields)):
        for f in [] if found is None else found:
            yield ("field", None, side, f["field_path"]), 1, f["type_json"], seq
            yield ("variant_field", fp, side, f["field_path"]), 1, f["type_json"], seq
    heads = [] if row.header_names is None else list(row.header_names)
    for h in dict.fromkeys(heads):
        yield ("header", None, None, h), heads.count(h), None, seq
    for p in [] if row.param_names is None else row.param_names:
        yield ("param", None, None, p), 1, None, seq


class EndpointTotals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "rows string")
        self.leaves = handle.getMapState("leaves", "fingerprint string, r bigint", "seqs binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.counters.get() if self.counters.exists() else None
        counters: dict[tuple, list] = {tuple(k): v for k, v in json.loads(known[0])} if known else {}
        seen: dict[tuple[str, int], set[int]] = {}
        changed: dict[tuple, None] = {}
        grown: dict[tuple[str, int], None] = {}
        for frame in rows:
            for row in frame.itertuples(index=False):
                seq, us = int(row.seq), int(row.observed_us)
                leaf, offset = (row.fingerprint, seq >> fold.LEAF_BITS), seq & ((1 << fold.LEAF_BITS) - 1)
                if leaf not in seen:
                    held = self.leaves.getValue(leaf) if self.leaves.containsKey(leaf) else None
                    seen[leaf] = set(np.frombuffer(bytes(held[0]), np.uint16).tolist()) if held else set()
                if offset in seen[leaf]:
                    continue
                seen[leaf].add(offset)
                grown[leaf] = None
                for k, times, text, at in sightings(row):
                    c = counters.get(k)
                    if c is None:
                        counters[k] = [times, times - 1, seq, us, us, text, at]
                    else:
                        c[0], c[1], c[2], c[3], c[4] = c[0] + times, c[1] + times - 1, min(c[2], seq), min(c[3], us), max(c[4], us)
                        if at > c[6]:
                            c[5], c[6] = text, at
                    changed[k] = None
        if not grown:
            return
        self.counters.update((json.dumps([[list(k), v] for k, v in counters.items()]),))
        out = [(*key, *k, *counters[k], None, None) for k in changed]
        for fp, r in grown:
            offsets = np.array(sorted(seen[fp, r]), np.uint16)
            self.leaves.updateValue((fp, r), (offsets.tobytes(),))
            out.append((*key, "leaf", fp, None, None, len(offsets), *[None] * 6, r, (offsets.astype(np.int64) + (r << fold.LEAF_BITS)).tolist()))
        yield pd.DataFrame(out, columns=NAMES).astype(object).where(lambda d: d.notna(), None)

    def close(self) -> None:
        pass


def live_changes(pairs: DataFrame, include: str = "", ignore: str = "", shards: int = SHARDS) -> DataFrame:
    """A stream of pairs -> the rows of the endpoints' states that each micro-batch changed."""
    obs = infer.observe(capture.capture(pairs, include, ignore))
    keyed = obs.select(
        *fold.ENDPOINT, F.pmod(F.shiftright("seq", fold.LEAF_BITS), F.lit(shards)).cast("int").alias("shard"), "seq", F.unix_micros("observed_at").alias("observed_us"),
        "fingerprint", "protocol", "raw_path", "req_fields", "resp_fields", "header_names", "param_names",
    )
    return keyed.groupBy(*fold.ENDPOINT, "shard").transformWithStateInPandas(statefulProcessor=EndpointTotals(), outputStructType=CHANGED, outputMode="Update", timeMode="None")


def live_totals(pairs: DataFrame, store: CatalogStore, checkpoint: str, once: bool = True, include: str = "", ignore: str = "", shards: int = SHARDS, **trigger: str) -> StreamingQuery:
    """Keep totals of a stream of pairs in its state and publish what changes to the catalogue (``live_states``)."""
    pairs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"first_seen": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us"), "version": F.lit(batch_id).cast("long")})
        store.append("live", rows, f"live-{batch_id:012d}")

    writer = live_changes(pairs, include, ignore, shards).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or ({"availableNow": True} if once else {"processingTime": "10 seconds"}))).start()


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each row of live states."""
    key = [*fold.ENDPOINT, "shard", "kind", "fingerprint", "location", "name", "r"]
    newest = Window.partitionBy(*key).orderBy(F.col("version").desc())
    return rows.withColumn("__v", F.row_number().over(newest)).where("__v = 1").drop("__v")


def live_states(store: CatalogStore) -> DataFrame:
    """States (fold.STATE, without recent calls) of all shards: what endpoints_of, presence_of and variants_of read."""
    return latest(store.alive("live")).withColumn("recent", F.lit(None).cast(f"array<{fold.RECENT}>")).select(*fold.STATE_COLUMNS)


def compact_live(store: CatalogStore) -> int | None:
    """Keep only the newest version of each row, in one folder. None: nothing to do. Run it while the stream rests."""
    return store.merge("live", latest)
