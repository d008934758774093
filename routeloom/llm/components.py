"""Connected components of an edge list by hooking and contraction.

First every task folds its own edges, in slices of at most SLICE, by union-find, which leaves at
most one edge a node and slice. Then rounds follow until no edge is left: each node hooks to its
smallest neighbour (or stays, where it is itself the smallest), jumps twice along the hooks, and the
edges are renamed to the hooks' ends; edges within one name go. Names only ever come from the same
component, so nothing is lost, and every round takes away all nodes but local minima: chains in any
order settle in about log(n) rounds. Lineage is cut by checkpoints every round.

Edge cases: loops only give their node no row; repeated and reversed edges count once; an edge with
a null end is ignored; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import reliable

SLICE = 1 << 18  # edges that a task folds at once


def folded(edges: DataFrame, slice_edges: int) -> DataFrame:
    """(a, b), a < b: for each task's slices of edges, every node with the smallest one that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        seen = 0

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def out(schema: pa.Schema) -> pa.RecordBatch:
            pairs = [(r, x) for x in up if (r := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(up.setdefault(a, a)), top(up.setdefault(b, b))
                if x != y:
                    up[max(x, y)] = min(x, y)
            seen += batch.num_rows
            if seen >= slice_edges:
                yield out(schema)
                up.clear()
                seen = 0
        if schema is not None and up:
            yield out(schema)

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, slice_edges: int = SLICE) -> DataFrame:
    """(a, b) pairs -> (node, root) for every node with an edge to another; root is the smallest node of its component."""
    pairs = reliable(folded(edges.select("a", "b").where("a <> b"), slice_edges).distinct())
    label = None
    while pairs.limit(1).count():
        both = pairs.union(pairs.select("b", "a")).toDF("node", "near")
        hook = reliable(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("up")))
        step = hook.toDF("at", "end")
        for _ in range(2):
            hook = hook.join(step, F.col("up") == F.col("at")).select("node", F.col("end").alias("up"))
        hook = reliable(hook)
        a, b = hook.toDF("a", "x"), hook.toDF("b", "y")
        pairs = pairs.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = reliable(pairs.distinct())
        if label is None:
            label = hook.toDF("node", "root")
        else:
            ends = hook.toDF("root", "up")
            label = reliable(label.join(ends, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if label is None else label
