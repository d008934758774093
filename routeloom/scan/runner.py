"""Detection (D1) and the distributed scan: files -> routes, project types joined by name (J3), deduplicated.

A file belongs to the outermost directory above it that holds a manifest; what manifests, route
templates and types say holds within such a project and never reaches another one. Files with no
manifest above them are one project of their own, for which all that was detected anywhere counts. A
scan looks at each file once: one pass gives routes, types, templates and errors (``facts``), the rest
is joins over those. Of a tree, paths are placed into projects first and only files that an extractor
of their project reads are opened at all (``scan_tree``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom import types
from routeloom.operators.catalog import dedupe_scanned
from routeloom.scan import dotnet, go, javascript, jvm, php, python, ruby, rust
from routeloom.scan.core import LONGEST_LINE, Extractor, applies
from routeloom.sources import tree as sources
from routeloom.sources.scratch import settled

_BY_NAME = {e.name: e for m in (javascript, python, go, dotnet, jvm, ruby, php, rust) for e in m.EXTRACTORS}
ORDER = [
    "express", "fastify", "koa", "nestjs", "nextjs", "nuxt", "hapi", "fastapi", "flask", "django", "go-chi", "go-gin", "go-echo", "go-fiber", "go-stdlib", "aspnet-mvc",
    "aspnet-minimal", "spring", "rails", "sinatra", "laravel", "symfony", "codeigniter", "zend", "actix", "axum", "ktor",
]
REGISTRY: dict[str, Extractor] = {n: _BY_NAME[n] for n in ORDER}

# Manifest file names (endings, where they start with a dot) -> {text to look for: framework}. Names are those of the registry.
MANIFESTS: dict[str, dict[str, str]] = {
    "package.json": {'"express"': "express", '"fastify"': "fastify", '"koa"': "koa", '"@nestjs/core"': "nestjs", '"next"': "nextjs", '"nuxt"': "nuxt", '"nuxi"': "nuxt", '"@hapi/hapi"': "hapi", '"hapi"': "hapi"},
    "requirements.txt": {"fastapi": "fastapi", "flask": "flask", "django": "django"}, "pyproject.toml": {"fastapi": "fastapi", "flask": "flask", "django": "django"},
    "go.mod": {"go-chi/chi": "go-chi", "gin-gonic/gin": "go-gin", "labstack/echo": "go-echo", "gofiber/fiber": "go-fiber", "module ": "go-stdlib"},
    ".csproj": {"microsoft.aspnetcore.mvc": "aspnet-mvc", "microsoft.aspnet.mvc": "aspnet-mvc", "microsoft.net.sdk.web": "aspnet-minimal"},
    "pom.xml": {"spring-boot": "spring"}, "build.gradle": {"spring-boot": "spring"}, "build.gradle.kts": {"ktor": "ktor"},
    "Gemfile": {"rails": "rails", "sinatra": "sinatra"},
    "composer.json": {"laravel/framework": "laravel", "symfony/framework-bundle": "symfony", "codeigniter4/framework": "codeigniter", "codeigniter/framework": "codeigniter", "zendframework/zend-mvc": "zend", "laminas/laminas-mvc": "zend"},
    "Cargo.toml": {"actix-web": "actix", "axum": "axum"},
}
FALLBACK = "go-stdlib"  # only where its manifest names no other framework
DEPTH = 3  # directory levels that are searched for manifests
SCANNED = set(re.findall(r"(?:^|, )(\w+)(?= )", re.sub(r"<.*?>+", "", types.SCANNED)))


SKIP_EVERYWHERE = frozenset.intersection(*[e.skip for e in REGISTRY.values()])
HIDDEN_READ = any(e.hidden for e in REGISTRY.values())


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, content) of a tree; text is read whole, unreadable files are skipped.

    Where tasks cannot open files by themselves (a store that only Spark reads), Spark's reader takes
    the place of the tree source.
    """
    if sources.readable(root):
        return sources.opened(sources.tree(spark, root, SKIP_EVERYWHERE, hidden=str(HIDDEN_READ).lower()), root).where("content is not null").select("path", "content")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    top = re.escape(root.rstrip("/").rpartition("/")[2])
    return raw.select(F.regexp_replace("path", f"^.*?/{top}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def is_manifest(name: str) -> Column:
    """Whether a path's file has this name, or this ending."""
    base = F.element_at(F.split("path", "/"), -1)
    return base.endswith(name) if name.startswith(".") else base == name


def manifests(files: DataFrame) -> DataFrame:
    """Manifest files of the first directory levels."""
    ends = F.lit(False)
    for name in MANIFESTS:
        ends = ends | is_manifest(name)
    shallow = F.size(F.split("path", "/")) <= DEPTH
    return files.where(ends & shallow & ~F.col("path").rlike(r"(^|/)(node_modules|vendor|\.git|__pycache__)/"))


def named(files: DataFrame) -> DataFrame:
    """path and frameworks of each manifest: those whose name stands in it, in any case."""
    low = F.lower("content")
    hits = F.array_compact(F.array(*[F.when(is_manifest(end) & low.contains(needle), F.lit(fw)) for end, table in MANIFESTS.items() for needle, fw in table.items()]))
    return manifests(files).select("path", F.when(F.size(hits) > 1, F.array_remove(hits, FALLBACK)).otherwise(hits).alias("frameworks"))


def detect(files: DataFrame) -> DataFrame:
    """Frameworks that manifests name."""
    return named(files).select(F.explode("frameworks").alias("framework")).distinct()


def selected(files: DataFrame, frameworks: list[str] | None = None) -> list[str]:
    """Named frameworks, else the detected ones, else all (a list bounded by the registry)."""
    names = frameworks or [r["framework"] for r in detect(files).collect()]
    return [n for n in ORDER if n in names] or ORDER


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def with_project(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files (path, ...) -> with project: the outermost of folders (folder, distinct) above the path, empty if there is none.

    Manifests count down to DEPTH levels, so that many folders are asked for, each by an equi-join.
    """
    out = files.crossJoin(folders.agg(F.coalesce(F.bool_or(F.col("folder") == ""), F.lit(False)).alias("__top")))  # one row
    found = F.when(F.col("__top"), F.lit(""))
    parts = F.split("path", "/")
    for k in range(1, DEPTH):
        mine = folders.select(F.col("folder").alias(f"__f{k}"))
        out = out.withColumn(f"__k{k}", F.when(F.size(parts) > k, F.array_join(F.slice(parts, 1, k), "/")))
        out = out.join(mine, F.col(f"__k{k}") == F.col(f"__f{k}"), "left")
        found = found.when(F.col(f"__f{k}").isNotNull(), F.col(f"__f{k}"))
    return out.select(*files.columns, F.coalesce(found, F.lit("")).alias("project"))


def projects(hits: DataFrame) -> DataFrame:
    """D1 by project, from what manifests name: project and the frameworks of its manifests, in registry order; the empty project has those of all, if no manifest is its own."""
    hits = hits.withColumn("folder", folder_of(F.col("path")))
    placed = with_project(hits, hits.select("folder").distinct())
    all_of = F.array_intersect(F.array(*[F.lit(n) for n in ORDER]), F.array_distinct(F.flatten(F.collect_list("frameworks")))).alias("frameworks")
    own = placed.groupBy("project").agg(all_of)
    rest = placed.agg(all_of).select(F.lit("").alias("project"), "frameworks").join(own.where("project = ''").select("project"), "project", "left_anti")
    return own.unionByName(rest)


FACT = (
    f"kind STRING, project STRING, {types.SCANNED}, req_type STRING, resp_type STRING, controller STRING, action STRING, type_name STRING, schema STRING, error STRING"
)
FACT_COLUMNS = re.findall(r"(?:^|, )(\w+)(?= )", re.sub(r"<.*?>+", "", FACT))


def file_facts(path: str, project: str, names: list[str], text: str | None, error: str | None) -> Iterator[dict]:
    """What one file says to the extractors of its project: routes, types, a route template, or why it could not be read."""
    mine = [REGISTRY[n] for n in names if applies(REGISTRY[n], path)]
    if text is not None and mine and max(map(len, text.split("\n"))) > LONGEST_LINE:
        text, error = None, f"a line is longer than {LONGEST_LINE} characters"
    if text is None:
        yield from (dict(kind="error", project=project, framework=e.name, source_file=path, error=error) for e in mine if error)
        return
    if "aspnet-mvc" in names and (template := dotnet.template_of(path, text)):
        yield dict(kind="template", project=project, source_file=path, schema=template)
    for e in mine:
        place = dict(project=project, framework=e.name, source_file=path)
        try:
            found = list(e.routes(path, text))
            known = list(e.types(text)) if e.types else []
        except Exception as x:  # one bad file must not end the scan
            yield dict(kind="error", **place, error=repr(x))
            continue
        for name, schema in known:
            yield dict(kind="type", **place, type_name=name, schema=json.dumps(schema))
        for r in found:
            controller, action = r.conventional or (None, None)
            yield dict(
                kind="route", **place, method=r.method.upper(), path_pattern=r.path, protocol="rest", source_line=r.line, req_schema=json.dumps(r.req) if r.req else None,
                resp_schema=json.dumps(r.resp) if r.resp else None, status_codes=r.codes, description=r.description, tags=r.tags, params=[{**p, "schema": p["schema"]} for p in r.params],
                deprecated=r.deprecated, requires_auth=r.auth, req_type=r.req_type or None, resp_type=r.resp_type or None, controller=controller, action=action,
            )


def facts(files: DataFrame, root: str | None = None) -> DataFrame:
    """files (path, project, frameworks[, content]) -> FACT rows; with a root, files are opened here, and only those that count."""
    text = F.lit(None).cast("string") if root else F.col("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = sources.reader_of(root) if root else None
        for b in batches:
            rows = []
            for path, project, names, content in zip(b["path"], b["project"], b["frameworks"], b["content"], strict=True):
                error = None
                if read is not None:
                    wanted = any(applies(REGISTRY[n], path) for n in names) or ("aspnet-mvc" in names and path.endswith(".cs"))
                    content, error = read(path) if wanted else (None, None)
                rows += file_facts(path, project, list(names), content if isinstance(content, str) else None, error)
            yield pd.DataFrame(rows, columns=FACT_COLUMNS).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "project", "frameworks", text.alias("content")).mapInPandas(run, FACT)


def types_of(found: DataFrame) -> DataFrame:
    """Types of a project: (project, framework, type name, schema); the first by path wins."""
    return found.where("kind = 'type'").groupBy("project", "framework", "type_name").agg(F.min_by("schema", "source_file").alias("schema"))


@F.pandas_udf(T.StringType())
def conventional_path(path: pd.Series, template: pd.Series, controller: pd.Series, action: pd.Series) -> pd.Series:
    """The project's template filled in, where a route follows it."""
    return pd.Series([dotnet.conventional(t, c, a) if t and c is not None else p for p, t, c, a in zip(path, template, controller, action, strict=True)], dtype=object)


def resolved(found: DataFrame) -> DataFrame:
    """Routes (types.SCANNED and project) of FACT rows, with their project's template and types filled in."""
    templates = found.where("kind = 'template'").groupBy("project").agg(F.min_by("schema", "source_file").alias("__template"))
    raw = found.where("kind = 'route'").drop("schema").join(templates, "project", "left")
    raw = raw.withColumn("path_pattern", conventional_path("path_pattern", "__template", "controller", "action"))
    table = types_of(found)
    for side in ("req", "resp"):
        # an equi-join; the planner broadcasts the table while it is small
        t = table.select("project", "framework", F.col("type_name").alias(f"{side}_type"), F.col("schema").alias("__own"))
        raw = raw.join(t, ["project", "framework", f"{side}_type"], "left").withColumn(f"{side}_schema", F.coalesce(f"{side}_schema", "__own")).drop("__own")
    return raw.select("project", *[c for c in FACT_COLUMNS if c in SCANNED])


def placed_files(files: DataFrame, hits: DataFrame, frameworks: list[str] | None) -> DataFrame:
    """files with project and the frameworks to look for (the named ones, else the project's, else all); hits: what manifests name."""
    folders = hits.select(folder_of(F.col("path")).alias("folder")).distinct()
    placed = with_project(files, folders)
    if frameworks:
        return placed.withColumn("frameworks", F.array(*[F.lit(n) for n in ORDER if n in frameworks]))
    known = placed.join(projects(hits).where(F.size("frameworks") > 0), "project", "left")
    return known.withColumn("frameworks", F.coalesce("frameworks", F.array(*[F.lit(n) for n in ORDER])))


def all_facts(files: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """FACT rows of files (path, content)."""
    return facts(placed_files(files, named(files), frameworks))


def type_table(files: DataFrame, names: list[str]) -> DataFrame:
    """(framework, type name, schema) of files that are one project."""
    one = files.select("path", "content", F.lit("").alias("project"), F.array(*[F.lit(n) for n in names]).alias("frameworks"))
    return types_of(facts(one)).drop("project")


def order() -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in ORDER]), F.col("framework"))


def errors_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'error'").select("framework", "source_file", "error")


def scan_projects(files: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """X1-X27 over a table that holds many projects: one row for each (project, method, path)."""
    return dedupe_scanned(resolved(settled(all_facts(files, frameworks))), order(), ["project"])


def scan(files: DataFrame, frameworks: list[str] | None = None, errors: bool = False) -> DataFrame:
    """All routes of a source tree, one row for each (method, path)."""
    found = all_facts(files, frameworks)
    return errors_of(found) if errors else dedupe_scanned(resolved(settled(found)).drop("project"), order())


def tree_facts(spark: SparkSession, root: str, frameworks: list[str] | None = None) -> DataFrame:
    """FACT rows of a tree: directories that no extractor reads are not listed, files that none of their project reads are not opened.

    The index and what manifests name are asked for several times each, so both are settled: one listing,
    each manifest opened once for detection. Files are dealt anew before they are opened, as rows of paths do not tell their work.
    """
    if not sources.readable(root):
        return all_facts(source_files(spark, root), frameworks)
    mine = [REGISTRY[n] for n in frameworks or ORDER]
    index = settled(sources.tree(spark, root, frozenset.intersection(*[e.skip for e in mine]), hidden=str(any(e.hidden for e in mine)).lower()))
    hits = settled(named(sources.opened(manifests(index), root)))
    return facts(placed_files(index, hits, frameworks).repartition(sources.tasks_of(index), "path"), root)


def scan_tree(spark: SparkSession, root: str, frameworks: list[str] | None = None, errors: bool = False) -> DataFrame:
    """X1-X27 of a tree."""
    found = tree_facts(spark, root, frameworks)
    return errors_of(found) if errors else dedupe_scanned(resolved(settled(found)).drop("project"), order())
