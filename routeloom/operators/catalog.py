"""Catalogue: append-only logs, overlay tables and the views derived from them.

Parquet has no MERGE, so nothing is updated in place: observations and scans are appended,
annotations, labels, overrides, touches and deletions are overlay rows. Every write goes to a folder
of its own, which a snapshot names in one atomic step (``sources.snapshots``). A batch of traffic is
written with its mergeable state (``fold.states``), and the views merge states: only calls beyond the
newest hundred of an endpoint are looked up in the log. Overlay rows are ordered by stamps that two
writers never share; a deletion covers the batches that were there before it, whatever their numbers.
"""

from __future__ import annotations

import datetime as dt
import re
import secrets
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom import types
from routeloom.operators import fold
from routeloom.sources.snapshots import Folder, Snapshots

ENDPOINT = fold.ENDPOINT
OVERLAYS = {
    "observations": types.OBSERVATION,
    "states": fold.STATE,
    "live": "version BIGINT, shard INT, kind STRING, method STRING, path_pattern STRING, fingerprint STRING, location STRING, name STRING, n BIGINT, more BIGINT, born BIGINT, first_seen TIMESTAMP, last_seen TIMESTAMP, text STRING, text_at BIGINT, r BIGINT, seqs ARRAY<BIGINT>",
    "scans": f"scan_no BIGINT, {types.SCANNED}",
    "annotations": "at BIGINT, method STRING, path_pattern STRING, description STRING, tags ARRAY<STRING>",
    "labels": "at BIGINT, method STRING, path_pattern STRING, fingerprint STRING, label STRING",
    "overrides": "at BIGINT, method STRING, raw_prefix STRING, override_pattern STRING",
    "deletions": "at BIGINT, method STRING, path_pattern STRING",
    "touches": "at BIGINT, method STRING, path_pattern STRING, protocol STRING, source STRING, seen_at TIMESTAMP",
}
COLUMNS = {t: re.findall(r"(?:^|, )(\w+)(?= )", re.sub(r"<.*?>+", "", ddl)) for t, ddl in OVERLAYS.items()}


def host_name(url: str) -> str:
    """Catalogue name of a target URL."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip(), flags=re.I)
    host = re.split(r"[/?#]", host, maxsplit=1)[0].rpartition("@")[2]
    host = re.sub(r":[0-9]*$", "", host)
    return re.sub(r"[^A-Za-z0-9.-]", "", host).lower()


def dir_name(path: str) -> str:
    """Catalogue name of a scanned directory."""
    return re.sub(r"[^a-z0-9]+", "-", path.lower()).strip("-")


def source_of(has_scan: Column, has_obs: Column) -> Column:
    """A2."""
    return F.when(has_scan & has_obs, "scan+obs").when(has_scan, "scan").otherwise("observed")


def schema_score(req: Column, resp: Column, n_params: Column, description: Column, tags: Column) -> Column:
    """Richness of a scanned endpoint."""
    one = lambda s: F.when(s.isNotNull(), 2 + F.coalesce(F.size(F.json_object_keys(F.get_json_object(s, "$.properties"))), F.lit(0))).otherwise(0)
    return one(req) + one(resp) + n_params + F.when(F.coalesce(description, F.lit("")) != "", 1).otherwise(0) + F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, 1).otherwise(0)


def dedupe_scanned(scanned: DataFrame, order: Column | None = None, within: list[str] | None = None) -> DataFrame:
    """One row for each (method, path), of each project where ``within`` names it: the richest; ties by registry order, file and line."""
    score = schema_score(F.col("req_schema"), F.col("resp_schema"), F.greatest(F.coalesce(F.size("params"), F.lit(0)), F.lit(0)), F.col("description"), F.col("tags"))
    rank = Window.partitionBy(*(within or []), *ENDPOINT).orderBy(score.desc(), order if order is not None else F.col("framework"), "source_file", "source_line")
    return scanned.withColumn("__rank", F.row_number().over(rank)).where("__rank = 1").drop("__rank")


def reconcile(observed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Full outer merge on the exact (method, pattern); a scan's texts win, counters stay."""
    o, s = observed.alias("o"), scanned.alias("s")
    joined = o.join(s, [F.col(f"o.{k}") == F.col(f"s.{k}") for k in ENDPOINT], "full_outer")
    has_scan, has_obs = F.col("s.method").isNotNull(), F.col("o.method").isNotNull()
    return joined.select(
        *[F.coalesce(f"o.{k}", f"s.{k}").alias(k) for k in ENDPOINT], F.coalesce("o.protocol", "s.protocol", F.lit("rest")).alias("protocol"),
        source_of(has_scan, has_obs).alias("source"), F.coalesce("s.framework", F.lit("")).alias("framework"), F.coalesce("s.source_file", F.lit("")).alias("source_file"),
        F.coalesce("s.source_line", F.lit(0)).alias("source_line"), "o.first_seen", "o.last_seen", F.coalesce("o.call_count", F.lit(0)).alias("call_count"),
        F.coalesce("s.description", F.lit("")).alias("description"), F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("s.deprecated", F.lit(False)).alias("deprecated"), F.coalesce("s.requires_auth", F.lit(False)).alias("requires_auth"),
    )


def new_and_updated(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """How many scanned endpoints are new to the catalogue and how many update it."""
    mark = known.select(*ENDPOINT).distinct().withColumn("known", F.lit(True))
    return scanned.select(*ENDPOINT).distinct().join(mark, ENDPOINT, "left").agg(F.count_if(F.col("known").isNull()).alias("new"), F.count_if("known").alias("updated"))


def skeleton_fields(scans: DataFrame, observed_fields: DataFrame, obs: DataFrame) -> DataFrame:
    """Fields known only from a scan count 0 of 0, and are ignored where traffic has them.

    scans: method, path_pattern, location, field_path, type_json, born (the seq before which the scan
    came). A field that traffic saw later counts every observation from the scan on.
    """
    births = scans.groupBy(*ENDPOINT, "location", "field_path").agg(F.min("born").alias("scan_born"), F.min_by("type_json", "born").alias("scan_type"))
    key = [*ENDPOINT, "location", "field_path"]
    births = fold.calls_since(obs.select(*ENDPOINT, "seq"), births.withColumnRenamed("scan_born", "born"))
    merged = observed_fields.join(births, key, "full_outer")
    return merged.select(
        *key, F.coalesce("seen_count", F.lit(0)).alias("seen_count"),
        F.greatest(F.coalesce("total_calls", F.lit(0)), F.coalesce("since", F.lit(0))).alias("total_calls"), F.coalesce("type_json", "scan_type").alias("type_json"),
    )


def export_rows(catalogue: DataFrame, obs: DataFrame) -> DataFrame:
    """Each endpoint with its children as arrays; every child is aggregated before it is joined, so nothing fans out."""
    return exported_rows(catalogue, fold.fields(obs), fold.headers(obs), fold.query_params(obs), fold.status_codes(obs), fold.variants(obs), fold.variant_fields(obs))


def state_rows(catalogue: DataFrame, state: DataFrame) -> DataFrame:
    """J4 from states (fold.STATE)."""
    fields = [fold.presence_of(state, kind) for kind in ("field", "header", "param", "variant_field")]
    return exported_rows(catalogue, *fields[:3], fold.status_codes_of(state), fold.variants_of(state), fields[3])


def exported_rows(catalogue: DataFrame, fields: DataFrame, headers: DataFrame, params: DataFrame, codes: DataFrame, variants: DataFrame, variant_fields: DataFrame) -> DataFrame:
    pack = lambda df, cols, name, key=ENDPOINT: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    stat = ["seen_count", "total_calls"]
    out = catalogue
    for child in (
        pack(fields, ["location", "field_path", *stat, "type_json"], "fields"), pack(headers, ["name", *stat], "headers"), pack(params, ["name", *stat], "query_params"), codes,
        pack(variants, ["first_seen", "fingerprint", "label", "call_count", "last_seen"], "variants"), pack(variant_fields, ["fingerprint", "location", "field_path", *stat, "type_json"], "variant_fields"),
    ):
        out = out.join(child, ENDPOINT, "left")
    return out


def with_touches(catalogue: DataFrame, touches: DataFrame) -> DataFrame:
    """M7: calls of touches are added, new endpoints appended, times widened; scan and observed meet as both."""
    t = touches.groupBy(*ENDPOINT).agg(
        F.count("*").alias("t_calls"), F.min("seen_at").alias("t_first"), F.max("seen_at").alias("t_last"), F.min_by("protocol", "at").alias("t_protocol"),
        F.bool_or(F.col("source").contains("scan")).alias("t_scan"), F.bool_or(F.col("source") != "scan").alias("t_obs"),
    )
    has = lambda word, mark: F.coalesce(F.col("source").contains(word), F.lit(False)) | F.coalesce(mark, F.lit(False))
    joined = catalogue.join(t, ENDPOINT, "full_outer")
    new = {
        "protocol": F.coalesce("protocol", "t_protocol"), "source": source_of(has("scan", "t_scan"), has("obs", "t_obs")), "call_count": F.coalesce("call_count", F.lit(0)) + F.coalesce("t_calls", F.lit(0)),
        "first_seen": F.least("first_seen", "t_first"), "last_seen": F.greatest("last_seen", "t_last"), "framework": F.coalesce("framework", F.lit("")), "source_file": F.coalesce("source_file", F.lit("")),
        "source_line": F.coalesce("source_line", F.lit(0)), "description": F.coalesce("description", F.lit("")), "tags": F.coalesce("tags", F.array().cast("array<string>")),
        "deprecated": F.coalesce("deprecated", F.lit(False)), "requires_auth": F.coalesce("requires_auth", F.lit(False)),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in catalogue.columns])


class CatalogStore:
    """A catalogue under one directory, one Parquet folder for each write, the live ones named by the newest snapshot."""

    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        self.spark, self.root = spark, f"{root.rstrip('/')}/catalog={name}"
        self.snapshots = Snapshots(spark, self.root)

    def _read(self, table: str, folders: list[Folder]) -> DataFrame:
        """Rows of a snapshot's folders, with the folder's name."""
        mine = [f"{self.root}/{table}/{f.name}" for f in folders if f.table == table]
        schema = f"{OVERLAYS[table]}, folder STRING"
        return self.spark.read.schema(schema).parquet(*mine) if mine else self.spark.createDataFrame([], schema)

    def table(self, table: str) -> DataFrame:
        return self._read(table, self.snapshots.load()[1]).drop("folder")

    def _write(self, table: str, rows: DataFrame, batch: str) -> Folder:
        name = f"{batch}-{uuid.uuid4().hex}"
        rows.select(*COLUMNS[table], F.lit(name).alias("folder")).write.parquet(f"{self.root}/{table}/{name}")
        return Folder(table, batch, name, 0)

    def _publish(self, written: list[Folder]) -> int:
        """Name new folders; one that holds a batch again takes its earlier folder's place and age."""

        def change(version: int, live: list[Folder]) -> list[Folder]:
            since = {(f.table, b): f.since for f in live for b in (f.batch, *f.covers)}
            merged = {(f.table, b) for f in live for b in f.covers}
            new = [Folder(f.table, f.batch, f.name, since.get((f.table, f.batch), version)) for f in written if (f.table, f.batch) not in merged]
            again = {(f.table, f.batch) for f in new}
            return [f for f in live if (f.table, f.batch) not in again] + new

        return self.snapshots.commit(change)

    def append(self, table: str, rows: DataFrame, batch: str | None = None) -> int:
        """Append in one step; a batch id makes the write idempotent (its earlier folder is no longer named)."""
        return self._publish([self._write(table, rows, batch or uuid.uuid4().hex)])

    @staticmethod
    def stamp() -> int:
        """A number that grows with time and that two writers never share: microseconds, then random bits."""
        return (time.time_ns() // 1000 << 10) | secrets.randbelow(1 << 10)

    def _row(self, table: str, **values: object) -> None:
        self.append(table, self.spark.createDataFrame([{"at": self.stamp(), **values}], OVERLAYS[table]))

    def record(self, observations: DataFrame, batch: str | None = None) -> int:
        """A batch of observations and its state, published together."""
        batch = batch or uuid.uuid4().hex
        log = self._write("observations", observations, batch)
        return self._publish([log, self._write("states", fold.states(self._read("observations", [log])), batch)])

    def merge(self, table: str, how: Callable[[DataFrame], DataFrame]) -> int | None:
        """Put all folders of a table into one; deletions so far are applied to it. None: nothing to merge."""
        version, live = self.snapshots.load()
        old = [f for f in live if f.table == table]
        if len(old) < 2:
            return None
        made = self._write(table, how(self._alive(table, live)), f"merged-{uuid.uuid4().hex}")
        gone = {f.name for f in old}
        covers = tuple(sorted({b for f in old for b in (f.batch, *f.covers) if not b.startswith("merged-")}))

        def change(now: int, found: list[Folder]) -> list[Folder]:
            if gone - {f.name for f in found}:
                raise RuntimeError("a batch was written again while its table was being merged: merge anew")
            return [f for f in found if f.name not in gone] + [Folder(table, made.batch, made.name, version, covers)]

        return self.snapshots.commit(change)

    def compact(self) -> int | None:
        """Merge the states of all batches into one folder; the log stays as it is."""
        return self.merge("states", fold.merge_states)

    def add_scan(self, scanned: DataFrame) -> None:
        """M6: a scan; the latest scan's texts replace those of earlier ones, also with blanks."""
        self.append("scans", scanned.withColumn("scan_no", F.lit(self.stamp()).cast("long")))

    def touch(self, method: str, path: str, protocol: str = "rest", source: str = "observed") -> None:
        """M7: an endpoint from any source counts one call, also from a scan; times and sources are kept."""
        self._row("touches", method=method.upper(), path_pattern=path, protocol=protocol, source=source, seen_at=dt.datetime.now())

    def annotate(self, method: str, path: str, description: str = "", tags: list[str] | None = None) -> None:
        """M3: an empty description and absent tags leave what is there."""
        self._row("annotations", method=method.upper(), path_pattern=path, description=description or None, tags=tags)

    def label_variant(self, method: str, path: str, fingerprint: str, label: str) -> None:
        """M5."""
        self._row("labels", method=method.upper(), path_pattern=path, fingerprint=fingerprint, label=label)

    def override_path(self, method: str, raw_prefix: str, pattern: str) -> None:
        """M4."""
        self._row("overrides", method=method.upper(), raw_prefix=raw_prefix, override_pattern=pattern)

    def override_paths(self, rows: DataFrame) -> None:
        """M4 for many: method, raw_prefix, override_pattern."""
        self.append("overrides", rows.withColumn("method", F.upper("method")).withColumn("at", F.lit(self.stamp()).cast("long")))

    def overrides(self) -> DataFrame:
        """M4: the latest pattern of each (method, prefix)."""
        return self.table("overrides").groupBy("method", "raw_prefix").agg(F.max_by("override_pattern", "at").alias("override_pattern"))

    def delete(self, method: str, path: str) -> None:
        """M1: everything known of the endpoint up to now; every view follows, as a cascade would.

        Nothing is rewritten or looked up: a deletion is a row, and it covers the batches (of traffic,
        scans and overlays) of the snapshots before its own. So it cannot be half done, a batch that is
        replayed later stays deleted, and whatever a later batch brings is kept, late rows too.
        """
        self._row("deletions", method=method.upper(), path_pattern=path)

    def clear(self) -> None:
        """M2: an empty snapshot, then all folders go."""
        self.snapshots.commit(lambda version, live: [])
        self.snapshots.vacuum(0)

    def _alive(self, table: str, live: list[Folder]) -> DataFrame:
        rows = self._read(table, live)
        deletions = [f for f in live if f.table == "deletions"]
        first = max((f.since for f in deletions), default=0)
        if not any(f.table == table and f.since < first for f in live):
            return rows.drop("folder")
        since = self.spark.createDataFrame([(f.name, f.since) for f in live if f.table in (table, "deletions")], "folder STRING, since BIGINT")
        last = self._read("deletions", live).join(since, "folder").groupBy(*ENDPOINT).agg(F.max("since").alias("__until"))
        joined = rows.join(since, "folder").join(last, ENDPOINT, "left").where(F.col("__until").isNull() | (F.col("since") > F.col("__until")))
        return joined.select(*COLUMNS[table])

    def alive(self, table: str) -> DataFrame:
        """Rows of a log that no deletion covers."""
        return self._alive(table, self.snapshots.load()[1])

    def observations(self) -> DataFrame:
        """The log."""
        return self.alive("observations")

    def states(self) -> DataFrame:
        return self.alive("states")

    def scanned(self) -> DataFrame:
        """The latest scan row of each endpoint."""
        latest = Window.partitionBy(*ENDPOINT).orderBy(F.col("scan_no").desc())
        return self.alive("scans").withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r", "scan_no")

    def endpoints(self) -> DataFrame:
        """The catalogue: traffic reconciled with scans, touches counted, annotations on top (a later scan replaces them, M6)."""
        base = with_touches(reconcile(fold.endpoints_of(self.states()), self.scanned()), self.alive("touches"))
        scans = self.alive("scans").groupBy(*ENDPOINT).agg(F.max("scan_no").alias("scan_no"))
        kept = self.alive("annotations").join(scans, ENDPOINT, "left").where(F.col("scan_no").isNull() | (F.col("at") > F.col("scan_no")))
        notes = kept.groupBy(*ENDPOINT).agg(
            F.max_by("description", F.when(F.col("description").isNotNull(), F.col("at"))).alias("note"), F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("at"))).alias("note_tags")
        )
        out = base.join(notes, ENDPOINT, "left")
        return out.withColumn("description", F.coalesce("note", "description")).withColumn("tags", F.coalesce("note_tags", "tags")).drop("note", "note_tags")

    def variants(self) -> DataFrame:
        """Variants with manual labels, which later sightings never change."""
        own = self.alive("labels").groupBy(*fold.VARIANT).agg(F.max_by("label", "at").alias("manual"))
        return fold.variants_of(self.states()).join(own, fold.VARIANT, "left").withColumn("label", F.coalesce("manual", "label")).drop("manual")

    def fields(self) -> DataFrame:
        return fold.presence_of(self.states(), "field")

    def headers(self) -> DataFrame:
        return fold.presence_of(self.states(), "header")

    def query_params(self) -> DataFrame:
        return fold.presence_of(self.states(), "param")

    def newest(self, k: int) -> DataFrame:
        """the k newest calls of each endpoint; the log is read only for more than states keep."""
        columns = [*ENDPOINT, "observed_at", "seq", "status_code", "latency_ms", "fingerprint"]
        calls = fold.recent_calls(self.states()) if k <= fold.NEWEST else self.observations()
        return fold.newest(calls.select(*columns), k)

    def export_rows(self) -> DataFrame:
        return state_rows(self.endpoints(), self.states())
