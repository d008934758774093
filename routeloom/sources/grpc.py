"""gRPC services from serialized descriptor sets (S11, I12); the engine itself opens no connection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Wire numbers of the field kinds -> type.
KINDS = {
    1: "number", 2: "number", 3: "integer", 4: "integer", 5: "integer", 6: "integer", 7: "integer", 8: "boolean", 9: "string", 10: "object", 11: "object",
    12: "string", 13: "integer", 14: "string", 15: "integer", 16: "integer", 17: "integer", 18: "integer",
}
METHODS = "service STRING, method STRING, path_pattern STRING, input_type STRING, output_type STRING, req_schema STRING, resp_schema STRING, client_streaming BOOLEAN, server_streaming BOOLEAN"


def field_type(kind: int) -> str:
    return KINDS.get(kind, "string")


def methods_of(blob: bytes) -> Iterator[tuple]:
    """Methods of all services of a descriptor set; reflection services are left out, schemas are one level deep."""
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet.FromString(blob).file
    index: dict[str, dict] = {}

    def add(prefix: str, message: object) -> None:
        name = f"{prefix}.{message.name}" if prefix else message.name
        index[name] = {"type": "object", **({"properties": {f.name: {"type": field_type(f.type)} for f in sorted(message.field, key=lambda f: f.name)}} if message.field else {})}
        for inner in message.nested_type:
            add(name, inner)

    for f in files:
        for m in f.message_type:
            add(f.package, m)
    for f in files:
        for s in f.service:
            full = f"{f.package}.{s.name}" if f.package else s.name
            if full.startswith("grpc.reflection."):
                continue
            for m in s.method:
                sides = [t.lstrip(".") for t in (m.input_type, m.output_type)]
                schemas = [json.dumps(index[t]) if t in index else None for t in sides]
                yield (full, m.name, f"/{full}/{m.name}", *sides, *schemas, m.client_streaming, m.server_streaming)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """One row for each method of every descriptor set below path; a broken file yields nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for blob in b["content"]:
                try:
                    rows += list(methods_of(bytes(blob)))
                except Exception:  # a set that cannot be parsed must not end the scan
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METHODS.split(", ")])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInPandas(run, METHODS)
