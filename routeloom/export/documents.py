"""OpenAPI, Swagger, Postman, Bruno, curl and HTTPie documents (E1-E7, S13) from export rows.

Export rows are one for each endpoint with their children already aggregated (J4). What an endpoint
gives to a document is made where its row is (``fragments``); files are put together from sorted parts
(``write_document``), so that no document has to fit into one task or the driver.
"""

from __future__ import annotations

import json
import re
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.export.schema import THRESHOLD, nest, sample_text
from routeloom.functions.paths import TOKEN_WORDS
from routeloom.operators.ranks import with_rank
from routeloom.operators.report import STATUS
from routeloom.sources.scratch import folder, settled
from routeloom.sources.tree import write_tree

VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
BODY_VERBS = {"POST", "PUT", "PATCH"}
PARAM = re.compile(r"\{([^}]+)\}")
# Document versions, the collection schema's address and conventional header values.
OPENAPI_VERSION, SWAGGER_VERSION = "3.0.3", "2.0"
POSTMAN_SCHEMA = "https://schema.getpostman.com/json/collection/v2.1.0/collection.json"
JSON_TYPE = "application/json"
RULE = "# " + "-" * 75


@dataclass
class Options:
    title: str = "Discovered API"
    version: str = "0.0.1"
    min_calls: int = 0
    threshold: float = THRESHOLD


@dataclass
class Endpoint:
    """An export row with the parts that all formats share, derived once."""

    row: dict
    threshold: float = THRESHOLD
    request: dict | None = field(init=False)
    response: dict | None = field(init=False)

    def __post_init__(self) -> None:
        self.request, self.response = (nest(self.row.get("fields") or [], side, self.threshold) for side in ("request", "response"))

    @property
    def method(self) -> str:
        return self.row["method"].upper()

    @property
    def path(self) -> str:
        return self.row["path_pattern"]

    @property
    def title(self) -> str:
        return f"{self.method} {self.path}"

    @property
    def params(self) -> list[str]:
        return list(dict.fromkeys(PARAM.findall(self.path)))

    @property
    def needs_auth(self) -> bool:
        words = [w for w in self.path.lower().split("/") if w and not (w.startswith("{") and w.endswith("}"))]
        return bool(self.row.get("requires_auth")) and not (words and words[-1] in TOKEN_WORDS)

    @property
    def codes(self) -> list[int]:
        return list(self.row.get("status_codes") or []) or [200]

    @property
    def variants(self) -> list[dict]:
        return sorted(self.row.get("variants") or [], key=lambda v: (str(v["first_seen"]), v["fingerprint"]))

    def variant_request(self, fingerprint: str) -> dict | None:
        return nest([f for f in self.row.get("variant_fields") or [] if f["fingerprint"] == fingerprint], "request", self.threshold)

    def names(self, what: str) -> list[str]:
        return sorted(x["name"] for x in self.row.get(what) or [])

    @property
    def sends_body(self) -> bool:
        return self.request is not None and self.method in BODY_VERBS

    def path_in(self, template: str) -> str:
        return PARAM.sub(lambda m: template.replace("x", m.group(1)), self.path)


def status_text(code: int) -> str:
    return STATUS.get(code, "Response")


def _clean(d: dict) -> dict:
    """Without empty parts."""
    return {k: v for k, v in d.items() if v not in (None, "", [], False) or k in ("required", "schema") and v is not None}


def _content(schema: dict) -> dict:
    return {JSON_TYPE: {"schema": schema}}


def _common(e: Endpoint) -> dict:
    return _clean({"description": e.row.get("description"), "tags": e.row.get("tags"), "deprecated": e.row.get("deprecated"), "security": [{"bearerAuth": []}] if e.needs_auth else None})


def openapi_operation(e: Endpoint) -> dict:
    op = _common(e)
    params = [{"name": n, "in": "path", "required": True, "schema": {"type": "string"}} for n in e.params]
    params += [{"name": n, "in": "query", "required": False, "schema": {"type": "string"}} for n in e.names("query_params")]
    if params:
        op["parameters"] = params
    if e.request:
        op["requestBody"] = {"required": True, "content": _content(e.request)}
    has_body = lambda c: e.response and (200 <= c < 300)
    op["responses"] = {str(c): {"description": status_text(c), **({"content": _content(e.response)} if has_body(c) else {})} for c in e.codes}
    if len(e.variants) > 1:
        op["x-variants"] = []
        for v in e.variants:
            own = e.variant_request(v["fingerprint"])
            op["x-variants"].append(_clean({"fingerprint": v["fingerprint"], "label": v["label"], "call_count": v["call_count"], "requestBody": {"required": True, "content": _content(own)} if own else None}))
    return op


def swagger_operation(e: Endpoint) -> dict:
    op = _common(e)
    params: list[dict] = [{"name": n, "in": "path", "required": True, "type": "string"} for n in e.params]
    if e.request:
        params.append({"name": "body", "in": "body", "required": True, "schema": e.request})
        op["consumes"] = [JSON_TYPE]
    if e.response:
        op["produces"] = [JSON_TYPE]
    if params:
        op["parameters"] = params
    op["responses"] = {str(c): {"description": status_text(c), **({"schema": e.response} if e.response and 200 <= c < 300 else {})} for c in e.codes}
    return op


def placeholder(name: str) -> str:
    """F13 of one name."""
    low = name.lower()
    if low == "authorization":
        return "Bearer {{token}}"
    if low in ("x-api-key", "x-apikey", "api-key", "x-api-token"):
        return "{{api_key}}"
    if low in ("x-auth-token", "x-access-token", "x-token"):
        return "{{token}}"
    return JSON_TYPE if low in ("accept", "content-type") else "{{" + re.sub("[- ]", "_", low) + "}}"


def postman_items(e: Endpoint) -> list[dict]:
    """One item an endpoint, or one for each of its variants if there are several."""
    headers = [{"key": n, "value": placeholder(n)} for n in e.names("headers") if n.lower() != "content-type"]
    if e.needs_auth and not any(h["key"].lower() == "authorization" for h in headers):
        headers.append({"key": "Authorization", "value": "Bearer {{token}}"})
    url = {"raw": "{{baseUrl}}" + e.path_in("{{x}}"), "host": ["{{baseUrl}}"], "path": [s for s in e.path_in("{{x}}").split("/") if s]}
    if e.params:
        url["variable"] = [{"key": n, "value": ""} for n in e.params]
    if e.names("query_params"):
        url["query"] = [{"key": n, "value": ""} for n in e.names("query_params")]
    items, many = [], e.variants if len(e.variants) > 1 else []
    for k, v in enumerate(many or [None], 1):
        schema = e.request if v is None else e.variant_request(v["fingerprint"])
        request: dict = {"method": e.method, "header": [*headers, *([{"key": "Content-Type", "value": JSON_TYPE}] if schema else [])], "url": url}
        if schema:
            request["body"] = {"mode": "raw", "raw": sample_text(schema), "options": {"raw": {"language": "json"}}}
        items.append({"name": e.title if v is None else f"{e.title} ({v['label'] or f'variant {k}'})", "request": request})
    return items


def _script_head(auth: bool, usage: str) -> str:
    out = ["#!/usr/bin/env bash", "# Requests of the discovered endpoints, generated from the catalogue.", f"# Usage: {usage}", "", 'BASE_URL="${BASE_URL:-http://localhost:4000}"']
    return "\n".join([*out, *(['TOKEN="${TOKEN:-}"'] if auth else [])]) + "\n"


def curl_call(e: Endpoint) -> str:
    """E4."""
    parts = [f'curl -s -X {e.method} "$BASE_URL{e.path_in("$x")}"']
    if e.needs_auth:
        parts.append('-H "Authorization: Bearer $TOKEN"')
    if e.sends_body:
        parts.append('-H "Content-Type: application/json"')
    parts.append('-H "Accept: application/json"')
    if e.sends_body:
        parts.append("-d '" + sample_text(e.request, "  ") + "'")
    return "\n".join([*[f"# set {n} before running" for n in PARAM.findall(e.path)], " \\\n  ".join(parts)])


def httpie_call(e: Endpoint) -> str:
    """E5: the body goes in by a here-document."""
    call = f'http {e.method} "$BASE_URL{e.path_in("$x")}"' + (' "Authorization: Bearer $TOKEN"' if e.needs_auth else "") + " Accept:application/json"
    body = f"{call} Content-Type:application/json <<'EOF'\n{sample_text(e.request)}\nEOF" if e.sends_body else call
    return "\n".join([*[f"# set {n}=<value>" for n in PARAM.findall(e.path)], body])


def bruno_name(method: str, path: str) -> str:
    """P11."""
    return re.sub(r"[^A-Za-z0-9]+", "-", f"{method} {path}").strip("-").lower()


def _block(name: str, lines: dict | str) -> str:
    body = "".join(f"  {k}: {v}\n" for k, v in lines.items()) if isinstance(lines, dict) else f"  {lines}\n"
    return f"{name} {{\n{body}}}\n"


SEQ = "@seq@"  # where a Bruno file has its rank


def bruno_file(e: Endpoint) -> str:
    """E6, with SEQ for the rank in path and method order."""
    blocks = [_block("meta", {"name": e.title, "type": "http", "seq": SEQ})]
    if e.needs_auth:
        blocks.append(_block("auth:bearer", {"token": "{{token}}"}))
    blocks.append(_block(e.method.lower(), {"url": "{{baseUrl}}" + e.path_in(":x"), "body": "json" if e.sends_body else "none", "auth": "bearer" if e.needs_auth else "none"}))
    if e.sends_body:
        blocks.append(_block("body:json", sample_text(e.request, "  ")))
    return "\n".join(blocks)


# what one endpoint gives to a document: (name, text) each
MAKERS: dict[str, Callable[[Endpoint], list[tuple[str, str]]]] = {
    "openapi": lambda e: [(e.title, json.dumps(openapi_operation(e)))], "swagger": lambda e: [(e.title, json.dumps(swagger_operation(e)))],
    "postman": lambda e: [(i["name"], json.dumps(i)) for i in postman_items(e)], "curl": lambda e: [(e.title, curl_call(e))], "httpie": lambda e: [(e.title, httpie_call(e))],
    "bruno": lambda e: [(f"{bruno_name(e.method, e.path)}.bru", bruno_file(e))],
}
MAKERS["openapi-json"] = MAKERS["openapi"]
FRAGMENT = "path string, method string, k int, name string, text string, auth boolean"


def fragments(rows: DataFrame, fmt: str, opts: Options | None = None) -> DataFrame:
    """What each endpoint (F2, F8) of the export rows gives to a document, made where its row is: FRAGMENT rows, k counts those of one endpoint."""
    opts = opts or Options()
    threshold, names = opts.threshold, re.findall(r"(\w+) \w+", FRAGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                e = Endpoint(row, threshold)
                out += [(e.path, e.method, k, name, text, e.needs_auth) for k, (name, text) in enumerate(MAKERS[fmt](e))]
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    return rows.where((F.col("protocol") != "grpc") & (F.col("call_count") >= opts.min_calls)).mapInArrow(run, FRAGMENT)


def path_items(found: DataFrame) -> DataFrame:
    """Operations by path: path, item (JSON); other verbs than VERBS leave an empty item."""
    one = F.when(F.col("method").isin(VERBS), F.struct(F.lower("method").alias("method"), "text"))
    pairs = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(F.to_json(F.array(x["method"])).substr(F.lit(2), F.length(F.to_json(F.array(x["method"]))) - 2), F.lit(": "), x["text"]))
    return found.groupBy("path").agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("item"))


def with_seq(found: DataFrame) -> DataFrame:
    """Bruno files with their rank in path and method order."""
    ranked = with_rank(found, "path", "method")
    return ranked.withColumn("text", F.replace("text", F.lit(SEQ), F.col("rank").cast("string"))).drop("rank")


def _head(fmt: str, opts: Options, auth: bool) -> tuple[dict, dict]:
    """What stands before and after the paths or items."""
    if fmt == "swagger":
        after = {"securityDefinitions": {"bearerAuth": {"type": "apiKey", "in": "header", "name": "Authorization"}}} if auth else {}
        return {"swagger": SWAGGER_VERSION, "info": {"title": opts.title, "version": opts.version}, "host": "localhost", "basePath": "/", "schemes": ["http"]}, after
    if fmt == "postman":
        return {"info": {"name": opts.title, "schema": POSTMAN_SCHEMA}}, {}
    after = {"components": {"securitySchemes": {"bearerAuth": {"type": "http", "scheme": "bearer", "bearerFormat": "JWT"}}}} if auth else {}
    return {"openapi": OPENAPI_VERSION, "info": {"title": opts.title, "version": opts.version}}, after


USAGE = {"curl": "BASE_URL=... TOKEN=... bash requests.sh", "httpie": "BASE_URL=... TOKEN=... bash requests-httpie.sh"}


def _bruno_json(opts: Options) -> str:
    return json.dumps({"version": "1", "name": opts.title, "type": "collection"}, indent=2) + "\n"


def build(rows: DataFrame, fmt: str, opts: Options | None = None) -> Any:
    """A document as one value on the driver: for merging with an existing one, which is such a value too. ``write_document`` makes files of any size."""
    opts = opts or Options()
    found = fragments(rows, fmt, opts)
    if fmt == "bruno":
        return {"bruno.json": _bruno_json(opts), **{r["name"]: r["text"] for r in with_seq(found).orderBy("path", "method").toLocalIterator()}}
    if fmt in ("curl", "httpie"):
        calls = list(found.orderBy("path", "method").toLocalIterator())
        return _script_head(any(r["auth"] for r in calls), USAGE[fmt]) + "".join(_titled(r["name"], r["text"]) for r in calls)
    auth, out = False, [] if fmt == "postman" else {}
    for r in found.orderBy("path", "method", "k").toLocalIterator():
        auth |= r["auth"]
        if fmt == "postman":
            out.append(json.loads(r["text"]))
            continue
        item = out.setdefault(r["path"], {})
        if r["method"] in VERBS:
            item[r["method"].lower()] = json.loads(r["text"])
    before, after = _head(fmt, opts, auth)
    return {**before, "item" if fmt == "postman" else "paths": out, **after}


def _titled(name: str, text: str) -> str:
    return f"\n{RULE}\n# {name}\n{RULE}\n{text}\n"


def _pieces(found: DataFrame, fmt: str) -> DataFrame:
    """(path, method, k, text) as the texts stand in the file; JSON parts end with the comma that the last one loses."""
    as_yaml = fmt in ("openapi", "swagger")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, _, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if as_yaml:
                    out.append(textwrap.indent(yaml.safe_dump({path: json.loads(text)}, sort_keys=False, allow_unicode=True), "  ")[:-1])
                elif fmt == "postman":
                    out.append(textwrap.indent(json.dumps(json.loads(text), indent=2, ensure_ascii=False), "    ") + ",")
                else:
                    out.append(textwrap.indent(json.dumps({path: json.loads(text)}, indent=2, ensure_ascii=False), "  ")[4:-4] + ",")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], names=b.schema.names)

    if fmt in ("curl", "httpie"):
        return found.select("path", "method", "k", F.concat(F.lit(f"\n{RULE}\n# "), "name", F.lit(f"\n{RULE}\n"), "text").alias("text"))
    if fmt != "postman":
        found = path_items(found).select("path", F.lit("").alias("method"), F.lit(0).alias("k"), F.col("item").alias("text"))
    return found.select("path", "method", "k", "text").mapInArrow(run, "path string, method string, k int, text string")


def write_document(rows: DataFrame, fmt: str, path: str, opts: Options | None = None) -> None:
    """A document of any number of endpoints as a file (Bruno: a directory).

    Executors make the parts and write them sorted by ranges; the driver copies the part files one
    after the other between head and tail, byte by byte, and then gives the file its name.
    """
    spark, opts = rows.sparkSession, opts or Options()
    found = fragments(rows, fmt, opts)
    if fmt == "bruno":
        head = spark.createDataFrame([("bruno.json", _bruno_json(opts))], "path string, content string")
        write_tree(with_seq(found).select(F.col("name").alias("path"), F.col("text").alias("content")).unionByName(head), path)
        return
    found = settled(found)
    auth = bool(found.agg(F.bool_or("auth")).first()[0])
    parts = f"{folder(spark, 'document')}/parts"
    _pieces(found, fmt).orderBy("path", "method", "k").select("text").write.text(parts)
    if fmt in ("curl", "httpie"):
        head, tail, bare = _script_head(auth, USAGE[fmt]), "", ""
    else:
        before, after = _head(fmt, opts, auth)
        key = "item" if fmt == "postman" else "paths"
        if fmt in ("openapi", "swagger"):
            dump = lambda d: yaml.safe_dump(d, sort_keys=False, allow_unicode=True) if d else ""
            head, tail, bare = dump(before) + f"{key}:\n", dump(after), dump({**before, key: {}, **after})
        else:
            opening, closing = ("[", "]") if fmt == "postman" else ("{", "}")
            head = json.dumps(before, indent=2, ensure_ascii=False)[:-2] + f',\n  "{key}": {opening}\n'
            tail = f"  {closing}" + (",\n" + json.dumps(after, indent=2)[2:-2] if after else "") + "\n}\n"
            bare = json.dumps({**before, key: [] if fmt == "postman" else {}, **after}, indent=2, ensure_ascii=False) + "\n"
    _join(spark, parts, path, head, tail, bare, fmt in ("openapi-json", "postman"))


def _join(spark: Any, parts: str, path: str, head: str, tail: str, bare: str, commas: bool) -> None:
    """Head, the part files in order (without the last comma, if they have commas) and tail as one file; ``bare`` if the parts are empty and it is given."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    source = at(parts).getFileSystem(conf)
    files = sorted((f for f in source.listStatus(at(parts)) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    draft = at(f"{path}.draft")
    fs = draft.getFileSystem(conf)
    out = fs.create(draft, True)
    if not files and bare:
        out.write(bytearray(bare.encode()))
    else:
        out.write(bytearray(head.encode()))
        for k, f in enumerate(files):
            stream, last = source.open(f.getPath()), commas and k == len(files) - 1
            jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, f.getLen() - 2 * last)
            stream.close()
            if last:
                out.write(bytearray(b"\n"))
        out.write(bytearray(tail.encode()))
    out.close()
    fs.delete(at(path), False)
    if not fs.rename(draft, at(path)):
        raise OSError(f"{path} could not be given its name")
    source.delete(at(parts), True)


ENDINGS = {"openapi": "yaml", "openapi-json": "json", "swagger": "yaml", "postman": "json", "curl": "sh", "httpie": "sh", "bruno": ""}


def render(fmt: str, doc: Any) -> str | dict[str, str]:
    """A document as text (Bruno: texts by file name)."""
    if fmt in ("openapi", "swagger"):
        return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n" if fmt in ("openapi-json", "postman") else doc


def output_path(fmt: str, title: str = "api", out: str = "", outputs: dict[str, str] | None = None, output_dir: str = "", shorthand: str = "") -> str | None:
    """Explicit path, then the format's own, then the directory, then the shorthand; None is standard output."""
    if out:
        return out
    if (outputs or {}).get(fmt):
        return (outputs or {})[fmt]
    slug = re.sub(r"[^A-Za-z0-9]+", "-", title).strip("-").lower() or "api"
    name = f"{slug}-{fmt}" + (f".{ENDINGS[fmt]}" if ENDINGS[fmt] else "")
    return f"{output_dir.rstrip('/')}/{name}" if output_dir else shorthand or None


def write(path: str, content: str | dict[str, str]) -> None:
    """A file, or for Bruno a directory of files."""
    files = {path: content} if isinstance(content, str) else {f"{path}/{n}": t for n, t in content.items()}
    for name, text in files.items():
        Path(name).parent.mkdir(parents=True, exist_ok=True)
        Path(name).write_text(text)
