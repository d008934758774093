"""What the extractors share: routes, type tables and small text helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

Schema = dict[str, Any]
LONGEST_LINE = 65536  # a file with a longer line is skipped, as a line reader of that buffer would

# Names of a language's types -> (type, format); names that are not listed take the language's default.
TYPES: dict[str, tuple[dict[str, str], str]] = {
    "zod": ({"string": "string", "number": "number", "int": "integer", "integer": "integer", "boolean": "boolean", "bool": "boolean", "array": "array", "object": "object", "date": "string:date-time"}, "string"),
    "python": ({"str": "string", "HttpUrl": "string", "AnyUrl": "string", "EmailStr": "string:email", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "List": "array", "dict": "object", "Dict": "object"}, "string"),
    "typescript": ({"string": "string", "number": "number", "int": "integer", "integer": "integer", "boolean": "boolean", "bool": "boolean", "any": "object", "object": "object", "record": "object", "date": "string:date-time"}, "object"),
    "go": ({**dict.fromkeys(["int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "byte"], "integer"), "string": "string", "float32": "number", "float64": "number", "bool": "boolean", "time.Time": "string:date-time", "uuid.UUID": "string:uuid"}, "object"),
    "csharp": ({"string": "string", "int": "integer", "long": "integer", "short": "integer", "byte": "integer", "double": "number", "float": "number", "decimal": "number", "bool": "boolean"}, "object"),
    "java": ({"String": "string", **dict.fromkeys(["int", "Integer", "long", "Long", "short", "Short", "byte", "Byte"], "integer"), **dict.fromkeys(["double", "Double", "float", "Float", "BigDecimal"], "number"), "Boolean": "boolean", "bool": "boolean"}, "object"),
    "kotlin": ({"String": "string", "Int": "integer", "Long": "integer", "Short": "integer", "Byte": "integer", "Float": "number", "Double": "number", "Boolean": "boolean", **dict.fromkeys(["List", "MutableList", "Set", "Array"], "array")}, "object"),
    "rust": ({"String": "string", "str": "string", **dict.fromkeys(["u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize"], "integer"), "f32": "number", "f64": "number", "bool": "boolean", "Vec": "array"}, "object"),
}


def typed(language: str, name: str) -> Schema:
    """Schema of a type name."""
    table, default = TYPES[language]
    base = re.sub(r"[<\[({].*$", "", name.strip().lstrip("&*")).strip()
    if language == "typescript":
        base = base.lower()
    kind, _, fmt = table.get(base, default).partition(":")
    return {"type": kind, **({"format": fmt} if fmt else {})}


def object_of(props: dict[str, Schema], required: list[str]) -> Schema:
    return {"type": "object", "properties": props, **({"required": required} if required else {})}


@dataclass
class Route:
    method: str
    path: str
    line: int = 0
    description: str = ""
    tags: list[str] = field(default_factory=list)
    deprecated: bool = False
    auth: bool = False
    req: Schema | None = None
    resp: Schema | None = None
    req_type: str = ""  # a name to look up among the project's types
    resp_type: str = ""
    codes: list[int] = field(default_factory=list)
    params: list[dict] = field(default_factory=list)
    conventional: tuple[str, str] | None = None  # (controller, action) where a project-wide template decides the path


@dataclass
class Extractor:
    name: str
    endings: tuple[str, ...]
    routes: Callable[[str, str], Iterator[Route]]  # (path, text)
    skip: frozenset[str] = frozenset()
    types: Callable[[str], Iterator[tuple[str, Schema]]] | None = None
    hidden: bool = False  # whether directories with a leading dot are read, as script walks do


SKIPPED = frozenset(["node_modules", "vendor", "dist", "build", "coverage", ".next", ".nuxt", ".git", "__pycache__", "target", "bin", "obj", "venv", ".venv"])


def applies(e: Extractor, path: str) -> bool:
    """The ending fits and no directory of the path is skipped, or hidden where that counts."""
    *dirs, name = path.split("/")
    return name.endswith(e.endings) and not any(d in SKIPPED or d in e.skip or (not e.hidden and d.startswith(".") and d not in (".", "..")) for d in dirs)


def braces(path: str) -> str:
    """P4 for text: ``:x`` and ``<x>`` to ``{x}``, one slash for many."""
    path = re.sub(r":([A-Za-z_]\w*)|<([A-Za-z_]\w*)>", lambda m: "{" + (m.group(1) or m.group(2)) + "}", path)
    return re.sub(r"/{2,}", "/", path)


def under(*parts: str) -> str:
    """Parts joined by single slashes, with a leading one."""
    return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))


def numbered(text: str) -> list[tuple[int, str]]:
    return list(enumerate(text.split("\n"), 1))


def window(lines: list[str], at: int, size: int) -> str:
    """Lines from index at on, as one text."""
    return "\n".join(lines[at:at + size])


def doc_comments(lines: list[str]) -> dict[int, tuple[str, bool]]:
    """Index of the line after a ``/** */`` block -> (first text, deprecated)."""
    out, start = {}, None
    for i, line in enumerate(lines):
        if start is None and line.strip().startswith("/**"):
            start = i
        if start is not None and "*/" in line:
            body = [re.sub(r"^\s*/?\*+/?\s?|\*/\s*$", "", x).strip() for x in lines[start:i + 1]]
            said = [x for x in body if x and not x.startswith("@")]
            out[i + 1] = (said[0] if said else "", any(x.startswith("@deprecated") for x in body))
            start = None
    return out


def line_comments(lines: list[str], at: int, mark: str = "#", most: int = 3) -> tuple[str, bool]:
    """Text and deprecation of the comment lines right above a line."""
    found: list[str] = []
    for line in reversed(lines[max(0, at - most):at]):
        text = line.strip()
        if not text.startswith(mark):
            break
        found.insert(0, text.lstrip(mark).strip())
    gone = any("deprecated" in x.lower() for x in found)
    said = [x for x in found if not x.lower().lstrip("@").startswith("deprecated")]
    return (said[0] if said else ""), gone


def each(method_list: list[str], path: str, **rest: Any) -> Iterator[Route]:
    for m in method_list:
        yield Route(m, path, **rest)


def resource(base: str, line: int, param: str = "id", forms: bool = False, only: list[str] | None = None, **rest: Any) -> Iterator[Route]:
    """Rows of a resource route: list, create, one, replace, change, delete, and form pages on demand."""
    one = under(base, "{" + param + "}")
    rows = {"index": ("GET", base), "create": ("POST", base), "show": ("GET", one), "update": ("PUT", one), "patch": ("PATCH", one), "destroy": ("DELETE", one)}
    for action, (m, p) in rows.items():
        if only is None or action in only or (action == "patch" and "update" in only):
            yield Route(m, p, line, **rest)
