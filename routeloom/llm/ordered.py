"""Running totals along a sorted table, however long the run of one key is.

``running`` sorts by ranges of (keys, order), so a key's rows may lie in many tasks; each task sums
along its own rows, writes them and, besides, the total of its first and of its last key. What the
tasks before hold of a key is added when the written rows are read: two rows a task at most, which
bounds what is broadcast by the number of tasks, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm.common import Scratch


def running(df: DataFrame, keys: list[str], order: list[Column], values: list[str], scratch: Scratch, name: str, xor: bool = False, keep: list[str] | None = None) -> DataFrame:
    """keys (longs, not null), keep and values, each value replaced by its sum (or exclusive or) over the key's rows up to this one.

    Rows that are equal in all of keys and order may stand either way round; values are longs.
    """
    keep = keep or []
    kinds = dict(df.dtypes)
    n_keys, n_keep = len(keys), len(keep)
    accumulate = np.bitwise_xor.accumulate if xor else np.add.accumulate
    join = np.bitwise_xor if xor else np.add
    less = np.bitwise_xor if xor else np.subtract

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, first, schema, task = None, None, None, None, 0

        def total(key: tuple, sums: tuple) -> pa.RecordBatch:
            row = [*key, *[None] * n_keep, *sums, task, True]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if schema is None:
                fields = [*(b.schema.field(i) for i in range(b.num_columns - 1)), pa.field("task", pa.int64()), pa.field("edge", pa.bool_())]
                schema = pa.schema([pa.field(f.name, f.type, True) for f in fields])
                task = b.column(b.num_columns - 1)[0].as_py()
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
            new = np.empty(n, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = last is None or tuple(key[:, 0].tolist()) != last
            at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            same = np.cumsum(new) == 0  # rows that still belong to the key of the batch before
            out = []
            for i in range(len(values)):
                v = b.column(n_keys + n_keep + i).to_numpy(zero_copy_only=False)
                acc = accumulate(v)
                before = np.concatenate([np.zeros(1, v.dtype), acc[:-1]])
                seg = less(acc, before[at])
                if held is not None and same.any():
                    seg = np.where(same, join(seg, held[i]), seg)
                out.append(seg)
            starts = np.flatnonzero(new)
            if first is None and len(starts) > (last is None):  # the first key ends in this batch
                end = starts[1 if last is None else 0] - 1
                sums = tuple(int(s[end]) for s in out) if end >= 0 else held
                yield total(tuple(key[:, 0].tolist()) if end >= 0 else last, sums)
                first = True
            last, held = tuple(key[:, -1].tolist()), tuple(int(s[-1]) for s in out)
            columns = [*(b.column(i) for i in range(n_keys + n_keep)), *(pa.array(s, schema.field(n_keys + n_keep + i).type) for i, s in enumerate(out))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, task), pa.int64()), pa.array(np.zeros(n, bool))], schema=schema)
        if last is not None:
            yield total(last, held)

    columns = [*keys, *keep, *values]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", task long, edge boolean"
    rows = scratch.save(name, ranged.select(*columns, F.spark_partition_id().cast("long").alias("task")).mapInArrow(run, schema))
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    gather = F.bit_xor if xor else F.sum
    edges = rows.where("edge").select(*keys, "task", *[gather(c).over(before).alias(f"__{c}") for c in values]).where(F.col(f"__{values[0]}").isNotNull())
    whole = rows.where("not edge").join(F.broadcast(edges), [*keys, "task"], "left")
    plus = (lambda a, b: a.bitwiseXOR(b)) if xor else (lambda a, b: a + b)
    return whole.select(*keys, *keep, *[plus(F.col(c), F.coalesce(F.col(f"__{c}"), F.lit(0).cast("long"))).alias(c) for c in values])


__all__ = ["running"]
