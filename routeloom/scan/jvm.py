"""Spring controllers and Ktor routing."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, Schema, object_of, typed, under, window


def java_classes(text: str) -> Iterator[tuple[str, Schema]]:
    for m in re.finditer(r"(?:class|record)\s+(\w+)[^{;]*\{(.*?)\n\}", text, re.S):
        props, need, marks = {}, [], ""
        for line in m.group(2).split("\n"):
            s = line.strip()
            marks += s if s.startswith("@") else ""
            if p := re.search(r"(?:private|public|protected)\s+(?:final\s+)?([\w<>\[\]]+)\s+(\w+)\s*(?:=[^;]*)?;", s):
                kind = p.group(1)
                own: Schema = {"type": "array"} if re.match(r"(List|Set)<|.*\[\]", kind) else typed("java", kind)
                if "@Email" in marks:
                    own["format"] = "email"
                if z := re.search(r"@Size\(([^)]*)\)", marks):
                    own |= {{"min": "minLength", "max": "maxLength"}[k]: int(v) for k, v in re.findall(r"(min|max)\s*=\s*(\d+)", z.group(1))}
                props[p.group(2)] = own
                if re.search(r"@Not(Null|Blank|Empty)", marks):
                    need.append(p.group(2))
                marks = ""
        if props:
            yield m.group(1), object_of(props, need)


def spring(path: str, text: str) -> Iterator[Route]:
    """The last class-level mapping of the file is the prefix; any security annotation marks all its routes."""
    if not path.endswith("Controller.java"):
        return
    lines = text.split("\n")
    prefixes = re.findall(r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"", text)
    prefix = prefixes[-1] if prefixes else ""
    auth = bool(re.search(r"@(PreAuthorize|Secured|RolesAllowed)\b", text))
    for i, line in enumerate(lines):
        m = re.search(r"@(Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*(?:\"([^\"]*)\")?)?", line)
        if not m:
            continue
        near = window(lines, i + 1, 8)
        sig = re.search(r"public\s+(?:\w+)<\s*(?:\w+<)?(\w+).*?\((.*?)\)\s*(?:throws[^{]*)?\{", near, re.S)
        if not sig:
            continue
        body = re.search(r"@RequestBody\s+(?:final\s+)?(\w+)", sig.group(2))
        yield Route(m.group(1).upper(), re.sub(r"\{(\w+):[^}]*\}", r"{\1}", under(prefix, m.group(2) or "")), i + 1, auth=auth, deprecated="@Deprecated" in window(lines, max(0, i - 2), 4), req_type=body.group(1) if body else "", resp_type=sig.group(1) if sig.group(1) not in ("Void", "Object") else "")


def kotlin_classes(text: str) -> Iterator[tuple[str, Schema]]:
    for m in re.finditer(r"data\s+class\s+(\w+)\s*\((.*?)\n?\)", text, re.S):
        props, need = {}, []
        for name, kind, maybe, default in re.findall(r"va[lr]\s+(\w+)\s*:\s*(\w+)(?:<[^>]*>)?(\?)?\s*(=[^,\n]*)?", m.group(2)):
            props[name] = typed("kotlin", kind) | ({"nullable": True} if maybe else {})
            if not (maybe or default):
                need.append(name)
        if props:
            yield m.group(1), object_of(props, need)


def ktor(path: str, text: str) -> Iterator[Route]:
    """Prefixes nest by brace depth."""
    lines, depth, stack = text.split("\n"), 0, []
    for i, line in enumerate(lines):
        nested = re.search(r"\broute\(\s*\"([^\"]+)\"", line)
        if nested:
            stack.append((depth, nested.group(1)))
        elif (m := re.search(r"\b(get|post|put|patch|delete|head|options)\s*(?:<\w+>)?(?:\(\s*\"([^\"]*)\"[^)]*\))?\s*\{", line)) and not re.search(r"\.\s*(get|post|put|patch|delete)", line):
            body = re.search(r"call\.receive<(\w+)>", window(lines, i, 10))
            yield Route(m.group(1).upper(), re.sub(r"\{(\w+)(?:\?|\.\.\.)\}", r"{\1}", under(*[p for _, p in stack], m.group(2) or "")), i + 1, auth="authenticate" in "\n".join(lines[max(0, i - 3):i]), req_type=body.group(1) if body else "")
        depth += line.count("{") - line.count("}")
        while stack and depth <= stack[-1][0]:
            stack.pop()


EXTRACTORS = [Extractor("spring", (".java",), spring, types=java_classes), Extractor("ktor", (".kt",), ktor, types=kotlin_classes)]
