"""Operator 9 [native]: size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards belong to tiers by size (a tier
spans a factor of ``fanout``); when a tier holds at least ``fanout`` runs, they are merged into
files of the next tier, at most target-sized, by a shuffle-free read, coalesce and write. Shards of
a target's half or more are sealed. Only DataFrame operations touch rows.

A manifest version lists the live shards, one JSON line each. It is written beside the manifests and
then given its final name in one atomic step that fails if that version exists: an HDFS rename without
overwriting, a hard link on a local file system. Other file systems are refused. So a reader sees the
old list or the new one, and of two writers one loses: its append is committed again on top of the
other's version, its merge is thrown away and planned anew.

Files are deleted only when no kept version names them. Kept are the newest version and those that
were current within the last ``keep_seconds``, so a reader has that long to finish. A job that dies at
any point leaves at worst files that no manifest names; the vacuum removes those after a day. Planning
needs one entry a shard, never a row's data, on the driver.

Edge cases: an empty table gives an empty manifest and no rows. Rows keep all columns, nulls and
repeats; a row is in exactly one live shard.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
FANOUT = 4
ROWS_PER_SHARD = 4000
KEEP_SECONDS = 6 * 3600
ORPHAN_SECONDS = 24 * 3600
ENTRY = "path string, bytes bigint, rows bigint, tier int"


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int


def tier_of(size: int, target: int, fanout: int) -> int:
    """0 for the smallest shards; the sealed tier holds those of half a target or more."""
    top = sealed_tier(target, fanout)
    if 2 * size >= target:
        return top
    steps = math.ceil(math.log(target / (2 * max(1, size)), fanout) - 1e-9)
    return max(0, top - max(1, steps))


def sealed_tier(target: int, fanout: int) -> int:
    return max(1, math.ceil(math.log(max(fanout, target / (1 << 20)), fanout)))


def plan(shards: list[Shard], target: int, fanout: int) -> dict[int, list[Shard]]:
    """The tiers to merge now: those below the sealed one with at least fanout runs."""
    by: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: s.path):
        by.setdefault(s.tier, []).append(s)
    return {t: g for t, g in by.items() if t < sealed_tier(target, fanout) and len(g) >= fanout}


class Conflict(RuntimeError):
    """Another writer committed that version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, keep_seconds: float = KEEP_SECONDS):
        self.spark, self.root, self.target, self.fanout, self.keep = spark, root.rstrip("/"), target_bytes, max(2, fanout), keep_seconds
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.scheme = self.fs.getUri().getScheme()
        if self.scheme not in ("file", "hdfs", "viewfs"):
            raise ValueError(f"no atomic commit without overwriting on {self.scheme}: use HDFS or a local file system")
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))
        self.fs.mkdirs(self._path(f"{self.root}/data"))

    def manifest_path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if version == 0:
            return []
        stream = self.fs.open(self._path(self.manifest_path(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**json.loads(line)) for line in text.splitlines()]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Write version base + 1 atomically; raises Conflict if another writer was first."""
        draft = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in shards).encode()))
        out.close()
        try:
            self._publish(draft, self._path(self.manifest_path(base + 1)))
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"manifest version {base + 1} exists: another writer committed first") from e
        finally:
            self.fs.delete(draft, False)
        return base + 1

    def _publish(self, draft, final) -> None:
        """Give a finished file its name in one step that fails if the name is taken."""
        jvm = self.spark._jvm
        if self.scheme == "file":  # rename overwrites there, a hard link does not
            none = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
            jvm.java.nio.file.Files.createLink(*(jvm.java.nio.file.Paths.get(p.toUri().getPath(), none) for p in (final, draft)))
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(rename, 0))

    def _current(self) -> int:
        found = self.versions()
        return found[-1] if found else 0

    def _written(self, folder: str) -> list[Shard]:
        """The files of a finished write. Row counts come from Parquet footers."""
        files = [f for f in self.fs.listStatus(self._path(folder)) if f.getPath().getName().endswith(".parquet")]
        if not files:
            return []
        rows = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        count = {r["f"]: r["count"] for r in rows}
        out = []
        for f in files:
            name = f.getPath().getName()
            if count.get(name):
                out.append(Shard(f"{folder}/{name}", f.getLen(), count[name], tier_of(f.getLen(), self.target, self.fanout)))
        return sorted(out, key=lambda s: s.path)

    def append(self, df: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> int:
        """Arrivals become small shards: one or more a task, none shared between tasks."""
        base = self._current()
        folder = f"{self.root}/data/{base + 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        new = self._written(folder)
        while True:
            try:
                return self.commit(base, self.manifest(base) + new)
            except Conflict:  # the shards are as good on top of the other writer's version
                base = self._current()

    def compact(self) -> int:
        """Merge tiers until none is due; one commit a round."""
        while True:
            base = self._current()
            live = self.manifest(base)
            due = plan(live, self.target, self.fanout)
            if not due:
                return base
            made: list[Shard] = []
            folders: list[str] = []
            for t, group in sorted(due.items()):
                folder = f"{self.root}/data/{base + 1:08d}-t{t}-{uuid.uuid4().hex[:8]}"
                folders.append(folder)
                total = sum(s.bytes for s in group)
                # a run of the next tier is fanout times as large, the last step fills targets
                size = min(self.target, max(1 << 20, self.fanout * total // len(group)))
                files = max(1, min(math.ceil(total / size), len(group) // 2))
                self.spark.read.parquet(*[s.path for s in group]).coalesce(files).write.parquet(folder)
                up = min(t + 1, sealed_tier(self.target, self.fanout))
                new = [Shard(s.path, s.bytes, s.rows, max(s.tier, up)) for s in self._written(folder)]
                if sum(s.rows for s in new) != sum(s.rows for s in group):
                    raise RuntimeError("a merge changed the number of rows; the old manifest stays")
                made += new
            gone = {s.path for g in due.values() for s in g}
            try:
                self.commit(base, [s for s in live if s.path not in gone] + made)
            except Conflict:  # the plan is stale
                for folder in folders:
                    self.fs.delete(self._path(folder), True)
            else:
                self.vacuum()

    def vacuum(self, now: float | None = None) -> None:
        """Delete versions out of date for longer than keep_seconds, shards only they name, and old files nobody names.

        A version went out of date when its successor was written.
        """
        found, now = self.versions(), time.time() if now is None else now
        written = [self.fs.getFileStatus(self._path(self.manifest_path(v))).getModificationTime() / 1000 for v in found]
        old = [v for v, replaced in zip(found, written[1:]) if replaced <= now - self.keep]
        named = {s.path for v in found if v not in set(old) for s in self.manifest(v)}
        for v in old:
            for s in self.manifest(v):
                if s.path not in named:
                    self.fs.delete(self._path(s.path), False)
            self.fs.delete(self._path(self.manifest_path(v)), False)
        used = {p.rsplit("/", 2)[1] for p in named}
        for folder in self.fs.listStatus(self._path(f"{self.root}/data")):
            if folder.getPath().getName() not in used and folder.getModificationTime() / 1000 < now - max(self.keep, ORPHAN_SECONDS):
                self.fs.delete(folder.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version with the shard's file name; None where it has no shard."""
        shards = self.manifest(version)
        return self.spark.read.parquet(*[s.path for s in shards]) if shards else None


def compact_documents(df: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", **policy: float) -> DataFrame:
    """Append df, compact, and tell for each row its shard, that shard's tier and the version.

    Two columns of the result describe the row (id, n_bytes), the others its place.
    """
    store = ShardStore(df.sparkSession, root, **policy)
    store.append(df)
    version = store.compact()
    rows = store.read(version)
    if rows is None:
        return df.select(F.col(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit("").alias("shard"), F.lit(0).alias("tier"), F.lit(version).cast("long").alias("version")).where("false")
    # a manifest is one line a shard; Spark broadcasts it or not by the file's size
    place = store.spark.read.schema(ENTRY).json(store.manifest_path(version)).select(F.substring_index("path", "/", -1).alias("shard"), "tier")
    out = rows.select(F.col(id_col), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.col("_metadata.file_name").alias("shard"))
    return out.join(place, "shard").select(id_col, "n_bytes", "shard", "tier", F.lit(version).cast("long").alias("version"))
