"""Shared plumbing of the training-data operators.

Conventions that every operator of this subpackage keeps:

* A null text counts as empty; an operator reads only the columns it is told to read, so extra
  columns (even ones named like its own outputs) never reach its internals.
* ``annotate``-style functions return the id column and the operator's own columns, one row for
  each input row, repeated rows included. ``filter``/``rewrite``-style functions return the input
  schema unchanged.
* Texts are handled in slices bounded by bytes, so a slice of very long documents takes no more
  memory than one of short ones (a single document is never cut).
* White space and words are the ASCII ones: a word is a run of bytes outside space and 0x09-0x0D,
  which is what ``bytes.split()`` without arguments yields.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ROWS_PER_BATCH = 1024

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and bound the rows of an Arrow batch.

    Where the executors cannot see the package through their own path, it is shipped as an archive.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = sc.master.startswith("local") and os.path.realpath(os.getcwd()) == str(root)
    if str(root) not in seen and not here and sc.applicationId not in _SHIPPED and root.is_dir():
        package = Path(tempfile.mkdtemp()) / "routeloom.zip"
        with zipfile.ZipFile(package, "w") as z:
            for p in sorted((root / "routeloom").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(package))
        _SHIPPED.add(sc.applicationId)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, leaf: str) -> str:
    """A folder for written tables: under spark.checkpoint.dir, which every executor sees.

    Where that setting is absent, a temporary folder takes its place on a local master (tests, one
    machine); a cluster has none that all see, so there it raises.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{Path(tempfile.gettempdir()).resolve()}/routeloom-shared"
    return f"{base.rstrip('/')}/{leaf}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    release(df.sparkSession)  # of what the previous step still held when it returned
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished stages' shuffle files are unreferenced."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder under one name each, dropped when no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark, "scratch")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        release(self.spark)
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def crc_mod_py(value: object, m: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % m


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts whose bytes stay within limit (one text at least)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def annotate(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list, list[bytes]], dict[str, Iterable]]],
    slice_bytes: int = 8 << 20,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One output row for each input row: the id and what the made function returns.

    ``make`` runs once a task and returns f(ids, texts, *extras) -> columns by name.
    """
    names = [n for n, _ in fields]
    kind = next(f.dataType for f in df.schema.fields if f.name == id_col)
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(n, t) for n, t in fields]])
    more = list((extra or {}).items())
    n_more = len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        f = make()
        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            rest = [b.column(2 + k).to_pylist() for k in range(n_more)]
            for lo, hi in slices(texts, slice_bytes):
                out = f(ids[lo:hi].to_pylist(), texts[lo:hi], *[r[lo:hi] for r in rest])
                cols = [ids[lo:hi].cast(arrow.field(0).type)]
                cols += [pa.array(out[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    source = df.select(
        F.col(id_col), F.col(text_col).cast("string").alias("__text"), *[c.alias(f"__x{k}") for k, (_, c) in enumerate(more)]
    )
    return source.mapInArrow(run, schema)


def same_schema(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Map batches to batches of the input's own schema (filters and rewrites)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield f(b)

    return df.mapInArrow(run, df.schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans_union(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean cover of [0, n) by half-open spans."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


__all__ = ["ASCII_SPACE", "LOWER", "Scratch", "annotate", "as_bytes", "crc_mod", "crc_mod_py", "documents", "mix64", "prepare", "reliable", "same_schema", "shared_dir", "slices", "spans_union"]
