"""The SQL surface: extractors as a table function, the catalogue's views by name.

    register(spark)
    SELECT * FROM routes(TABLE(files), 'express')      -- files: path, content
    views(store, "shop")
    SELECT * FROM shop_endpoints JOIN shop_fields USING (method, path_pattern)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.operators.catalog import CatalogStore
from routeloom.scan.runner import REGISTRY, file_facts

ROUTES = T.StructType([
    T.StructField("method", T.StringType()), T.StructField("path_pattern", T.StringType()), T.StructField("framework", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("source_line", T.IntegerType()), T.StructField("req_schema", T.StringType()), T.StructField("resp_schema", T.StringType()), T.StructField("req_type", T.StringType()),
    T.StructField("resp_type", T.StringType()), T.StructField("description", T.StringType()), T.StructField("deprecated", T.BooleanType()), T.StructField("requires_auth", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


class Routes:
    """X1-X27 as a table function: the routes (or the error) of each row (path, content), body types by name."""

    def eval(self, file: Row, framework: str) -> Iterator[tuple]:
        if framework not in REGISTRY:
            raise ValueError(f"no such framework: {framework}")
        for f in file_facts(file["path"], "", [framework], file["content"], None):
            if f["kind"] in ("route", "error"):
                yield tuple(f.get(name) for name in ROUTES.names)


def register(spark: SparkSession) -> None:
    spark.udtf.register("routes", F.udtf(Routes, returnType=ROUTES))


def views(store: CatalogStore, name: str) -> None:
    """Temporary views <name>_endpoints, _fields, _headers, _params, _variants and _observations over the newest snapshot."""
    for part, df in (
        ("endpoints", store.endpoints()), ("fields", store.fields()), ("headers", store.headers()), ("params", store.query_params()), ("variants", store.variants()), ("observations", store.observations()),
    ):
        df.createOrReplaceTempView(f"{name}_{part}")


__all__ = ["register", "views"]
