"""Captured pairs from files (S1-S5): the capture agent writes them, the engine reads and filters them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom import types
from routeloom.functions import content


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(types.PAIR).format(fmt).load(path)


def capture(pairs: DataFrame, include: str = "", ignore: str = "", body_limit: int = content.BODY_LIMIT) -> DataFrame:
    """The pairs that pass the prefix filter, with capped bodies and tracked header names only."""
    kept = pairs.where(content.captured(F.col("raw_path"), include, ignore))
    return kept.withColumns({
        "req_body": content.capped(F.col("req_body"), body_limit), "resp_body": content.capped(F.col("resp_body"), body_limit),
        "req_headers": content.header_names(F.coalesce("req_headers", F.array().cast("array<string>"))),
    })
