"""Chi, gin, echo, fiber and the standard library. Body types are found by a text scan, not a parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, Schema, braces, each, numbered, object_of, typed, under


def structs(text: str) -> Iterator[tuple[str, Schema]]:
    """Struct types by their JSON names; pointers are nullable, pointers and omitempty optional."""
    for m in re.finditer(r"type\s+(\w+)\s+struct\s*\{(.*?)\n\}", text, re.S):
        props, need = {}, []
        for name, kind, tag in re.findall(r"^\s*([A-Z]\w*)\s+([\w.*\[\]{}]+)\s*(?:`([^`]*)`)?", m.group(2), re.M):
            told = re.search(r'json:"([^"]*)"', tag)
            own, *flags = told.group(1).split(",") if told else [name]
            if own == "-":
                continue
            base = kind.lstrip("*")
            if base.startswith("[]"):
                s: Schema = {"type": "array", "items": typed("go", base[2:])}
            elif "." in base and base not in ("time.Time", "uuid.UUID"):
                s = {"type": "string"}
            else:
                s = typed("go", base)
            if kind.startswith("*"):
                s["nullable"] = True
            props[own or name] = s
            if not kind.startswith("*") and "omitempty" not in flags:
                need.append(own or name)
        if props:
            yield m.group(1), object_of(props, need)


def handler_type(text: str, name: str) -> str:
    """Type of the variable that a handler function binds or decodes."""
    m = re.search(rf"func\s+(?:\([^)]*\)\s*)?{re.escape(name)}\s*\(.*?\n\}}", text, re.S)
    body = m.group(0) if m else ""
    if not re.search(r"\.(?:ShouldBind\w*|Bind\w*|Decode|BodyParser)\(", body):
        return ""
    v = re.search(r"\.(?:ShouldBind\w*|Bind\w*|Decode|BodyParser)\(\s*&?(\w+)", body)
    t = re.search(rf"\bvar\s+{v.group(1)}\s+\*?(\w+)|\b{v.group(1)}\s*:?=\s*&?(\w+)\s*\{{|\b{v.group(1)}\s*:?=\s*new\((\w+)\)", body) if v else None
    return next((g for g in t.groups() if g), "") if t else ""


def verb_routes(text: str, receiver: str, verbs: str, prefix: str, star: bool = False) -> Iterator[Route]:
    for n, line in numbered(text):
        if m := re.search(rf"\b{receiver}\.({verbs})\(\s*\"([^\"]*)\"\s*(?:,\s*(?:.*,\s*)?([\w.]+)\s*\))?", line):
            p = re.sub(r"\*([A-Za-z_]\w*)", r"{\1}", m.group(2)) if star else m.group(2)
            name = (m.group(3) or "").rpartition(".")[2]
            yield Route(m.group(1).upper(), under(prefix, braces(p)) if prefix else braces(p), n, req_type=handler_type(text, name) if name else "")


def first(pattern: str, text: str) -> str:
    m = re.search(pattern, text)
    return m.group(1) if m else ""


def chi(path: str, text: str) -> Iterator[Route]:
    yield from verb_routes(text, "r", "Get|Post|Put|Patch|Delete|Head|Options", first(r"\br\.(?:Route|Mount)\(\s*\"([^\"]+)\"", text))


def gin(path: str, text: str) -> Iterator[Route]:
    yield from verb_routes(text, r"\w+", "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any", first(r"\.Group\(\s*\"([^\"]+)\"", text), star=True)


def echo(path: str, text: str) -> Iterator[Route]:
    yield from verb_routes(text, r"\w+", "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS", first(r"\.Group\(\s*\"([^\"]+)\"", text), star=True)


def fiber(path: str, text: str) -> Iterator[Route]:
    yield from verb_routes(text, "app", "Get|Post|Put|Patch|Delete|Head|Options|All", "", star=True)


def stdlib(path: str, text: str) -> Iterator[Route]:
    for n, line in numbered(text):
        if m := re.search(r"\b(?:mux|http)\.Handle(?:Func)?\(\s*\"(?:([A-Z]+) )?([^\"]+)\"", line):
            yield from each([m.group(1)] if m.group(1) else ["GET", "POST"], m.group(2), line=n)


EXTRACTORS = [Extractor(n, (".go",), f, types=structs) for n, f in (("go-chi", chi), ("go-gin", gin), ("go-echo", echo), ("go-fiber", fiber), ("go-stdlib", stdlib))]
