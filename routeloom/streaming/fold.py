"""Incremental ingestion (S1, S3): pairs from files, observations appended batch by batch.

Log mode writes each micro-batch, with its mergeable state, under its batch id: a replayed batch takes
its own place, and reports merge states. A source that may deliver a pair more than once is given a
``delay``: pairs are then told apart by their number, for as long as the event time's watermark
waits, across batches. State mode (``streaming.live``) keeps the totals in the state of the stream.
The source is lossless; ``max_files`` bounds a batch instead of dropping pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from routeloom import types
from routeloom.operators import infer
from routeloom.sources import capture
from routeloom.operators.catalog import CatalogStore


def pair_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(types.PAIR).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def ingest_stream(pairs: DataFrame, store: CatalogStore, checkpoint: str, once: bool = True, include: str = "", ignore: str = "", delay: str = "", name: str = "stream", **trigger: str) -> StreamingQuery:
    """Append each micro-batch's observations to the catalogue's log, exactly once by batch id; filters are those of a batch.

    With a delay ("1 hour"), pairs with the number of one that is at most that much older are taken
    for repetitions; pairs that come later than that behind the newest are dropped. Streams into one
    catalogue need different names.
    """
    if delay:
        pairs = pairs.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["seq"])

    def write(batch: DataFrame, batch_id: int) -> None:
        store.record(infer.observe(capture.capture(batch, include, ignore)), f"{name}-{batch_id:012d}")

    writer = pairs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or ({"availableNow": True} if once else {"processingTime": "10 seconds"}))).start()
