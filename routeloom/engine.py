"""The engine's commands as methods."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from routeloom.export import documents, merge
from routeloom.operators import catalog, fold, infer, report
from routeloom.scan import runner
from routeloom.sources import capture
from routeloom.streaming import fold as streams


class Engine:
    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        self.spark, self.store = spark, catalog.CatalogStore(spark, root, name)

    @classmethod
    def for_target(cls, spark: SparkSession, root: str, url: str) -> Engine:
        return cls(spark, root, catalog.host_name(url))

    @classmethod
    def for_dir(cls, spark: SparkSession, root: str, directory: str) -> Engine:
        return cls(spark, root, catalog.dir_name(directory))

    def ingest(self, pairs: DataFrame, include: str = "", ignore: str = "", batch: str | None = None) -> None:
        self.store.record(infer.observe(capture.capture(pairs, include, ignore)), batch)

    def ingest_stream(self, path: str, checkpoint: str, fmt: str = "parquet", include: str = "", ignore: str = "") -> StreamingQuery:
        return streams.ingest_stream(streams.pair_stream(self.spark, path, fmt), self.store, checkpoint, include=include, ignore=ignore)

    def scan(self, directory: str, frameworks: list[str] | None = None, dry_run: bool = False) -> DataFrame:
        """Routes of a source tree, stored unless it is a dry run."""
        found = runner.scan_tree(self.spark, directory, frameworks)
        if not dry_run:
            self.store.add_scan(found)
        return report.scan_order(found)

    def list_endpoints(self, min_calls: int = 0, source: str = "", protocol: str = "", cols: list[str] | None = None) -> DataFrame:
        return report.columns(report.listed(self.store.endpoints(), min_calls, source, protocol), cols)

    def show(self, method: str, path: str, calls: int = 0) -> dict | None:
        return report.show(self.store, method, path, calls)

    def stats(self) -> dict[str, int]:
        return {r["source"]: r["n"] for r in fold.source_counts(self.store.endpoints()).collect()}

    def annotate(self, method: str, path: str, description: str = "", tags: list[str] | None = None) -> None:
        self.store.annotate(method, path, description, tags)

    def label_variant(self, method: str, path: str, fingerprint: str, label: str) -> None:
        self.store.label_variant(method, path, fingerprint, label)

    def delete(self, method: str, path: str) -> None:
        self.store.delete(method, path)

    def clear(self) -> None:
        self.store.clear()

    def export(self, fmt: str = "openapi", options: documents.Options | None = None, out: str = "", existing: Any = None, resolutions: dict[str, str] | None = None) -> Any:
        """A document, merged with an existing one if given, and written if out is given; written without merging it is put together from the executors' parts and not returned."""
        if out and existing is None:
            documents.write_document(self.store.export_rows(), fmt, out, options)
            return None
        doc = documents.build(self.store.export_rows(), fmt, options)
        if existing is not None:
            if fmt in ("openapi", "openapi-json", "swagger"):
                doc = merge.merge_spec(existing, doc)[0]
            elif fmt == "postman":
                doc = merge.merge_collection(existing, doc, resolutions)
            elif fmt == "bruno":
                new = set(merge.diff_bruno(existing, doc)["added"]) | {k for k, how in (resolutions or {}).items() if how == "replace"}
                doc = {**existing, **{k: v for k, v in doc.items() if k in new}}
            else:
                doc = merge.merge_script(existing, doc)[0]
        if out:
            documents.write(out, documents.render(fmt, doc))
        return doc
