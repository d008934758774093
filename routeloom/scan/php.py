"""Laravel, Symfony, CodeIgniter, Zend."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, each, numbered, resource, under

VERBS = "get|post|put|patch|delete|options|head"


def laravel(path: str, text: str) -> Iterator[Route]:
    if not re.search(r"(?:^|/)routes/[^/]+\.php$", path):
        return
    m = re.search(r"prefix\(\s*['\"]([^'\"]+)|['\"]prefix['\"]\s*=>\s*['\"]([^'\"]+)", text)
    prefix = next((g for g in m.groups() if g), "") if m else ""
    fix = lambda p: under(prefix, re.sub(r"\{(\w+)\?\}", r"{\1}", p))
    auth_file = bool(re.search(r"middleware\(\s*\[?['\"]auth", text))
    for n, line in numbered(text):
        if m := re.search(rf"Route::({VERBS}|any)\(\s*['\"]([^'\"]*)['\"]", line):
            verbs = ["GET", "POST", "PUT", "PATCH", "DELETE"] if m.group(1) == "any" else [m.group(1).upper()]
            yield from each(verbs, fix(m.group(2)), line=n, auth="auth" in line or auth_file)
        elif m := re.search(r"Route::(?:api)?[rR]esource\(\s*['\"]([^'\"]+)", line):
            param = re.sub("s$", "", m.group(1).rpartition("/")[2])
            yield from resource(fix(m.group(1)), n, param, only=["index", "create", "show", "update", "destroy"], auth=auth_file)


def symfony(path: str, text: str) -> Iterator[Route]:
    """Attributes and annotations; a route within five lines above the class is its prefix."""
    lines, prefix = text.split("\n"), ""
    fix = lambda p: re.sub(r"\{!?(\w+)(?:<[^>]*>)?(?:\?[^}]*)?\}", r"{\1}", p)
    at_class = next((i for i, x in enumerate(lines) if re.match(r"\s*(?:final\s+|abstract\s+)?class\s+\w+", x)), len(lines))
    for i, line in enumerate(lines):
        m = re.search(r"(?:#\[|\*\s*@)Route\(\s*(?:path\s*[:=]\s*)?['\"]([^'\"]*)['\"](.*)", line)
        if not m:
            continue
        if at_class - 5 <= i < at_class:
            prefix = m.group(1)
            continue
        found = re.search(r"methods\s*[:=]\s*(?:[\[{]([^\]}]*)[\]}]|['\"](\w+)['\"])", m.group(2))
        verbs = re.findall(r"\w+", next(g for g in found.groups() if g)) if found else ["GET"]
        near = "\n".join(lines[max(0, i - 3):i + 4])
        yield from each([v.upper() for v in verbs], under(prefix, fix(m.group(1))), line=i + 1, deprecated="@deprecated" in near, auth="IsGranted" in near)


def codeigniter(path: str, text: str) -> Iterator[Route]:
    if not path.endswith("Config/Routes.php"):
        return
    fix = lambda p: re.sub(r"\(:(\w+)\)", lambda m: "{id}" if m.group(1) == "num" else "{param}", p)
    prefix = ""
    for n, line in numbered(text):
        if m := re.search(r"->group\(\s*['\"]([^'\"]+)", line):
            prefix = m.group(1)
        elif line.strip() in ("});", "}"):
            prefix = ""
        elif m := re.search(rf"->({VERBS}|add)\(\s*['\"]([^'\"]*)['\"]", line):
            yield Route("GET" if m.group(1) == "add" else m.group(1).upper(), under(prefix, fix(m.group(2))), n)
        elif m := re.search(r"->(?:resource|presenter)\(\s*['\"]([^'\"]+)", line):
            yield from resource(under(prefix, m.group(1)), n)


def zend(path: str, text: str) -> Iterator[Route]:
    if not re.search(r"module\.config\.php$|config/autoload/[^/]+\.php$", path):
        return
    for n, line in numbered(text):
        if m := re.search(r"['\"]route['\"]\s*=>\s*['\"](/[^'\"]*)", line):
            p = re.sub(r"[\[\]]", "", re.sub(r":(\w+)", r"{\1}", m.group(1)))
            yield Route("GET", p, n)


EXTRACTORS = [Extractor("laravel", (".php",), laravel), Extractor("symfony", (".php",), symfony), Extractor("codeigniter", (".php",), codeigniter), Extractor("zend", (".php",), zend)]
