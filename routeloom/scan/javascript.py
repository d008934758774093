"""Express, fastify, koa, nestjs, nextjs, nuxt, hapi."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, Schema, braces, doc_comments, each, numbered, object_of, typed, under, window

JS = (".js", ".ts")
VERB = re.compile(r"\b\w+\.(get|post|put|patch|delete|head|options|all)\s*\(\s*['\"`](/[^'\"`]*)['\"`]")
ZOD = re.compile(r"z\.object\(\s*\{(.*?)\}\s*\)", re.S)
ZOD_FIELD = re.compile(r"(\w+)\s*:\s*z\.(\w+)\(")
GENERIC = re.compile(r"Request\s*<[^,<>]*,[^,<>]*,\s*(?:\{([^}]*)\}|(\w+))")
TS_FIELD = re.compile(r"(\w+)\??\s*:\s*([\w<>\[\]]+)")
BODY_FIELD = re.compile(r"(\w+)\s*:\s*\{\s*type\s*:\s*['\"](\w+)['\"]")


def zod_body(text: str) -> Schema | None:
    m = ZOD.search(text)
    if m:
        return {"type": "object", "properties": {k: typed("zod", t) for k, t in ZOD_FIELD.findall(m.group(1))}}
    for m in GENERIC.finditer(text):
        inline, name = m.groups()
        if inline is not None:
            return {"type": "object", "properties": {k: typed("typescript", t) for k, t in TS_FIELD.findall(inline)}}
        if name not in ("any", "unknown"):
            return {"type": "object", "description": f"TS type: {name}"}
    return None


def express(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    docs = doc_comments(lines)
    for i, line in enumerate(lines):
        if m := VERB.search(line):
            said, gone = docs.get(i, ("", False))
            yield Route(m.group(1).upper(), braces(m.group(2)), i + 1, said, deprecated=gone, req=zod_body(window(lines, i, 30)))


def fastify(path: str, text: str) -> Iterator[Route]:
    lines, prefix = text.split("\n"), ""
    for i, line in enumerate(lines):
        if m := re.search(r"register\(.*prefix\s*:\s*['\"`]([^'\"`]+)", line):
            prefix = m.group(1)
        found = [(m.group(1), m.group(2))] if (m := VERB.search(line)) else []
        if (a := re.search(r"method\s*:\s*['\"](\w+)['\"]", line)) and (b := re.search(r"url\s*:\s*['\"`]([^'\"`]+)", line)):
            found = [(a.group(1), b.group(1))]
        for verb, p in found:
            near = window(lines, i, 20)
            at = near.find("body")
            props = {k: typed("zod", t) for k, t in BODY_FIELD.findall(near[at:])} if at >= 0 else {}
            yield Route(verb.upper(), under(prefix, braces(p)) if prefix else braces(p), i + 1, req={"type": "object", "properties": props} if props else None)


def koa(path: str, text: str) -> Iterator[Route]:
    m = re.search(r"new\s+Router\(\s*\{[^}]*prefix\s*:\s*['\"`]([^'\"`]+)", text)
    prefix = m.group(1) if m else ""
    for n, line in numbered(text):
        if m := VERB.search(line):
            yield Route(m.group(1).upper(), under(prefix, braces(m.group(2))) if prefix else braces(m.group(2)), n)


def hapi(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if not re.search(r"\.route\s*\(\s*\{?", line):
            continue
        near = window(lines, i, 11)
        p = re.search(r"path\s*:\s*['\"`]([^'\"`]+)", near)
        m = re.search(r"method\s*:\s*(\[[^\]]*\]|['\"][^'\"]+['\"])", near)
        if p and m:
            yield from each([x.upper() for x in re.findall(r"['\"](\w+|\*)['\"]", m.group(1))], re.sub(r"\{(\w+)[?*][^}]*\}", r"{\1}", p.group(1)), line=i + 1)


DTO_RULE = re.compile(r"@(\w+)\(([^)]*)\)")


def dto_classes(text: str) -> dict[str, Schema]:
    """Classes with their validated fields."""
    out: dict[str, Schema] = {}
    name, props, need, marks = "", {}, [], []
    for line in text.split("\n"):
        s = line.strip()
        if m := re.match(r"export\s+class\s+(\w+)", s):
            name, props, need, marks = m.group(1), {}, [], []
        elif name and s.startswith("@"):
            marks += DTO_RULE.findall(s)
        elif name and (m := re.match(r"(?:readonly\s+)?(\w+)(\?|!)?\s*:\s*([\w<>\[\]]+)", s)):
            rules = dict(marks)
            own = {"type": "array", "items": typed("typescript", m.group(3))} if "[]" in m.group(3) or "IsArray" in rules else typed("typescript", m.group(3))
            own |= {k: v for r, k, v in (("IsEmail", "format", "email"), ("IsUUID", "format", "uuid"), ("IsUrl", "format", "uri"), ("IsDateString", "format", "date-time")) if r in rules}
            own |= {k: int(rules[r]) for r, k in (("MinLength", "minLength"), ("MaxLength", "maxLength"), ("Min", "minimum"), ("Max", "maximum")) if rules.get(r, "").strip().isdigit()}
            props[m.group(1)] = own
            if m.group(2) != "?" and "IsOptional" not in rules:
                need.append(m.group(1))
            marks = []
        elif name and s == "}" and props:
            out[name] = object_of(props, need)
            name = ""
    return out


def signature(lines: list[str], at: int) -> str:
    """A handler's head from line index at to the bracket that opens its body, or to its semicolon, on one line."""
    depth, out = 0, []
    for line in lines[at:at + 60]:
        out.append(line.strip())
        for c in line:
            depth += (c in "([{<") - (c in ")]}") - (c == ">")
            if c in "{;" and depth == (c == "{"):
                return " ".join(out)
    return " ".join(out)


def nestjs(path: str, text: str) -> Iterator[Route]:
    if not path.endswith(".ts") and ".controller." not in path.rpartition("/")[2]:
        return
    dtos, lines = dto_classes(text), text.split("\n")
    prefix, tags, class_auth, pending, marks = "", [], False, None, {}
    for n, line in numbered(text):
        s = line.strip()
        if m := re.match(r"@Controller\(\s*(?:\{[^}]*path\s*:\s*)?(?:['\"`]([^'\"`]*)['\"`])?", s):
            prefix, class_auth = m.group(1) or "", marks.get("auth", False)
            tags, marks = marks.get("tags", []), {}
        elif m := re.match(r"@(Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*(?:['\"`]([^'\"`]*)['\"`])?", s):
            pending = (m.group(1).upper(), m.group(2) or "", n)
        elif s.startswith("@UseGuards") or s.startswith("@ApiBearerAuth"):
            marks["auth"] = True
        elif s.startswith("@Public"):
            marks["auth"] = False
        elif m := re.match(r"@ApiTags\(([^)]*)\)", s):
            marks["tags"] = re.findall(r"['\"]([^'\"]+)['\"]", m.group(1))
        elif m := re.match(r"@ApiOperation\(\{[^}]*summary\s*:\s*['\"]([^'\"]+)", s):
            marks["said"], marks["gone"] = m.group(1), "deprecated: true" in s or marks.get("gone", False)
        elif "@deprecated" in s:
            marks["gone"] = True
        elif pending and re.match(r"(?:public\s+|async\s+)*\w+\s*\(", s):
            verb, sub, at = pending
            s = signature(lines, n - 1)
            body = re.search(r"@Body\([^)]*\)\s*\w+\??\s*:\s*(\w+)", s)
            back = re.search(r"Promise<\s*(\w+)(\[\])?", s)
            params = [{"name": v, "in": {"Param": "path", "Query": "query"}[k], "required": k == "Param", "schema": None} for k, v in re.findall(r"@(Param|Query)\(\s*['\"](\w+)", s)]
            resp = dtos.get(back.group(1)) if back else None
            yield Route(
                verb, braces(under(prefix, sub)), n, marks.get("said", ""), marks.get("tags", tags), marks.get("gone", False), marks.get("auth", class_auth),
                req=dtos.get(body.group(1), {"type": "object", "description": f"DTO: {body.group(1)}"}) if body else None, resp={"type": "array", "items": resp} if resp and back.group(2) else resp, params=params,
            )
            pending, marks = None, {}


def file_url(inner: str) -> str:
    """P6 for text: bracket parameters, groups and index files."""
    parts = [p for p in inner.split("/") if p and p != "index" and not re.fullmatch(r"\(.*\)|@.*", p)]
    return "/" + "/".join(re.sub(r"^\[\[?(?:\.{3})?([^\]]+)\]\]?$", r"{\1}", p) for p in parts)


def nextjs(path: str, text: str) -> Iterator[Route]:
    if m := re.search(r"(?:^|/)(?:src/)?pages/(api(?:/.*)?)\.(?:ts|js|tsx|jsx)$", path):
        verbs = list(dict.fromkeys(re.findall(r"req\.method\s*={2,3}\s*['\"](\w+)['\"]", text))) or ["GET", "POST"]
        yield from each(verbs, file_url(m.group(1)), line=1)
    elif m := re.search(r"(?:^|/)(?:src/)?app/(api(?:/.*)?)/route\.(?:ts|js)$", path):
        for n, line in numbered(text):
            if v := re.search(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", line):
                yield Route(v.group(1), file_url(m.group(1)), n)


def nuxt(path: str, text: str) -> Iterator[Route]:
    if m := re.search(r"(?:^|/)pages/(.+)\.vue$", path):
        yield Route("GET", file_url(m.group(1)), 1)
    elif m := re.search(r"(?:^|/)server/(api|routes)/(.+?)(?:\.(get|post|put|patch|delete|head|options))?\.(?:ts|js|mjs)$", path):
        url = under("api", file_url(m.group(2))) if m.group(1) == "api" else file_url(m.group(2))
        yield from each([m.group(3).upper()] if m.group(3) else ["GET", "POST", "PUT", "PATCH", "DELETE"], url, line=1)


EXTRACTORS = [
    Extractor("express", JS, express, hidden=True), Extractor("fastify", JS, fastify, hidden=True), Extractor("koa", JS, koa, hidden=True), Extractor("nestjs", JS, nestjs, hidden=True),
    Extractor("nextjs", (".ts", ".js", ".tsx", ".jsx"), nextjs), Extractor("nuxt", (".vue", ".ts", ".js", ".mjs"), nuxt), Extractor("hapi", JS, hapi, hidden=True),
]
