"""Fastapi, flask, django."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, Schema, braces, each, numbered, object_of, resource, typed, under, window

VERBS = "get|post|put|patch|delete|head|options"
PLAIN = {"str", "int", "float", "bool", "Request", "Response", "BackgroundTasks", "Session", "dict", "list"}


def models(text: str) -> Iterator[tuple[str, Schema]]:
    """Pydantic classes; fields stand four spaces deep."""
    for m in re.finditer(r"^class\s+(\w+)\(.*?(?:BaseModel|Schema|Base)\w*.*?\):\n((?:[ \t].*\n|\n)*)", text + "\n", re.M):
        props, need = {}, []
        for name, kind, default in re.findall(r"^ {4}(\w+)\s*:\s*([^=\n]+?)\s*(=.*)?$", m.group(2), re.M):
            inner = re.fullmatch(r"Optional\[(.+)\]", kind)
            base = inner.group(1) if inner else kind
            item = re.fullmatch(r"(?:List|list)\[(.+)\]", base)
            props[name] = {"type": "array", "items": typed("python", item.group(1))} if item else typed("python", base)
            if base in ("list", "List"):
                props[name] = {"type": "array", "items": {"type": "string"}}
            if not (inner or "None" in default or "default" in default or (default and not default.startswith("= Field(..."))):
                need.append(name)
        if props:
            yield m.group(1), object_of(props, need)


def fastapi(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    m = re.search(r"APIRouter\([^)]*prefix\s*=\s*['\"]([^'\"]+)", text)
    prefix = m.group(1) if m else ""
    for i, line in enumerate(lines):
        m = re.match(rf"\s*@\w+\.({VERBS})\(\s*['\"]([^'\"]*)['\"](.*)", line)
        if not m:
            continue
        near = window(lines, i, 11)
        head = re.search(r"def\s+\w+\s*\((.*?)\)\s*(?:->.*?)?:\s*\n", near + "\n", re.S)
        args = head.group(1) if head else ""
        body = next((t for t in re.findall(r"\w+\s*:\s*([A-Z]\w+)\s*(?=[,)=\n]|$)", args) if t not in PLAIN), "")
        back = re.search(r"response_model\s*=\s*(?:List\[|list\[)?(\w+)", near)
        doc = re.search(r'\)\s*(?:->[^\n]*)?:\s*\n\s*(?:"""|\'\'\')\s*([^\n"\']+)', near)
        tags = re.search(r"tags\s*=\s*\[([^\]]*)\]", near)
        code = re.search(r"status_code\s*=\s*(?:status\.HTTP_)?(\d{3})", near)
        yield Route(
            m.group(1).upper(), braces(under(prefix, m.group(2))) if prefix or m.group(2).strip("/") else "/", i + 1, doc.group(1).strip() if doc else "", re.findall(r"['\"]([^'\"]+)", tags.group(1))[::1] if tags else [],
            "deprecated=True" in near.replace(" ", ""), bool(re.search(r"Depends\(\s*\w*(?:auth|user|token|current)\w*", args, re.I)), req_type=body, resp_type=back.group(1) if back else "", codes=[int(code.group(1))] if code else [],
        )


def flask(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    m = re.search(r"Blueprint\([^)]*url_prefix\s*=\s*['\"]([^'\"]+)", text)
    prefix = m.group(1) if m else ""
    for i, line in enumerate(lines):
        m = re.match(r"\s*@\w+\.route\(\s*['\"]([^'\"]+)['\"](.*)", line)
        if not m:
            continue
        verbs = re.search(r"methods\s*=\s*[\[(]([^\])]*)", m.group(2))
        url = re.sub(r"<(?:\w+:)?(\w+)>", r"{\1}", m.group(1))
        around = "\n".join(lines[max(0, i - 5):i] + lines[i + 1:i + 6])
        auth = bool(re.search(r"@\w*(?:login_required|jwt_required|auth\w*|token_required)", around))
        body = re.search(r"@validate\([^)]*body\s*=\s*(\w+)", window(lines, i + 1, 5))
        yield from each([v.upper() for v in re.findall(r"['\"](\w+)['\"]", verbs.group(1))] if verbs else ["GET"], under(prefix, url) if prefix else url, line=i + 1, auth=auth, req_type=body.group(1) if body else "")


def django(path: str, text: str) -> Iterator[Route]:
    name = lambda p: under(re.sub(r"\(\?P<(\w+)>[^)]*\)|<(?:\w+:)?(\w+)>", lambda m: "{" + (m.group(1) or m.group(2)) + "}", p).strip("^$")) + ("/" if p.rstrip("$").endswith("/") else "")
    for n, line in numbered(text):
        if m := re.search(r"router\.register\(\s*r?['\"]([^'\"]+)['\"]", line):
            yield from resource(under(m.group(1)) + "/", n, "pk")
        elif m := re.search(r"\b(?:re_)?path\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*[\w.]+\.as_view", line):
            yield from each(["GET", "POST"], name(m.group(1)), line=n)


EXTRACTORS = [Extractor("fastapi", (".py",), fastapi, types=models), Extractor("flask", (".py",), flask, types=models), Extractor("django", (".py",), django)]
