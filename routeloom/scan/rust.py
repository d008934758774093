"""Actix and Axum."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, Schema, braces, numbered, object_of, typed, under, window

VERBS = "get|post|put|patch|delete|head|options"


def serde_structs(text: str) -> Iterator[tuple[str, Schema]]:
    for m in re.finditer(r"#\[derive\([^)]*(?:Serialize|Deserialize)[^)]*\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?struct\s+(\w+)\s*\{(.*?)\n\}", text, re.S):
        props, need, mark = {}, [], ""
        for line in m.group(2).split("\n"):
            s = line.strip()
            mark += s if s.startswith("#[serde") else ""
            if p := re.match(r"(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*(Option<)?\s*([\w:]+)", s):
                named = re.search(r"rename\s*=\s*\"([^\"]+)", mark)
                if not re.search(r"\bskip\b", mark):
                    name = named.group(1) if named else p.group(1)
                    props[name] = typed("rust", p.group(3)) | ({"nullable": True} if p.group(2) else {})
                    if not p.group(2):
                        need.append(name)
                mark = ""
        if props:
            yield m.group(1), object_of(props, need)


def fixed(path: str) -> str:
    return braces(re.sub(r"\{(\w+):[^}]*\}", r"{\1}", path))


def actix(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    m = re.search(r"web::scope\(\s*\"([^\"]+)", text)
    prefix = m.group(1) if m else ""
    for i, line in enumerate(lines):
        if m := re.search(rf"#\[({VERBS})\(\s*\"([^\"]*)\"", line):
            body = re.search(r"web::Json<(\w+)>", window(lines, i, 5))
            yield Route(m.group(1).upper(), under(prefix, fixed(m.group(2))), i + 1, req_type=body.group(1) if body else "")
        elif m := re.search(rf"\.route\(\s*\"([^\"]*)\"\s*,\s*web::({VERBS})\(\)", line):
            yield Route(m.group(2).upper(), under(prefix, fixed(m.group(1))), i + 1)
        elif m := re.search(r"web::resource\(\s*\"([^\"]*)\"", line):
            for verb in re.findall(rf"web(?:::|\.)({VERBS})\(\)", window(lines, i, 4)):
                yield Route(verb.upper(), under(prefix, fixed(m.group(1))), i + 1)


def axum(path: str, text: str) -> Iterator[Route]:
    m = re.search(r"\.nest\(\s*\"([^\"]+)", text)
    prefix = m.group(1) if m else ""
    for n, line in numbered(text):
        if m := re.search(rf"\.route\(\s*\"([^\"]*)\"\s*,\s*(?:\w+::)*({VERBS})\(\s*([\w:]+)", line):
            name = m.group(3).rpartition("::")[2]
            body = re.search(rf"fn\s+{name}\s*\((?:[^{{]*?)Json(?:\([^)]*\))?\s*:\s*(?:axum::)?Json<(\w+)>", text)
            yield Route(m.group(2).upper(), under(prefix, fixed(m.group(1))), n, req_type=body.group(1) if body else "")


EXTRACTORS = [Extractor("actix", (".rs",), actix, types=serde_structs), Extractor("axum", (".rs",), axum, types=serde_structs)]
