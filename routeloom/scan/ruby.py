"""Rails routes and Sinatra."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, braces, line_comments, resource, under

VERB = re.compile(r"^(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]")


def rails(path: str, text: str) -> Iterator[Route]:
    """A stack of prefixes; block lines push, ``end`` pops. Routes carry no line numbers."""
    if not path.endswith("config/routes.rb"):
        return
    stack: list[tuple[str, str]] = []
    here = lambda: under(*[p for p, _ in stack])
    for line in text.split("\n"):
        s = line.split("#")[0].strip()
        opens = bool(re.search(r"\bdo\b(\s*\|[^|]*\|)?\s*$", s))
        push = ("", "")
        if m := re.match(r"(?:namespace|scope)\s+(?:path:\s*)?[:'\"]([\w/:-]+)", s):
            push = (braces(m.group(1)), "")
        elif m := re.match(r"resources\s+:(\w+)(.*)", s):
            only = re.search(r"only:\s*(?:\[([^\]]*)\]|:(\w+)|%i\[([^\]]*)\])", m.group(2))
            names = re.findall(r"\w+", next(g for g in only.groups() if g)) if only else None
            yield from resource(under(here(), m.group(1)), 0, only=names)
            push = (f"{m.group(1)}/{{{re.sub('s$', '', m.group(1))}_id}}", m.group(1))
        elif m := re.match(r"resource\s+:(\w+)", s):
            base = under(here(), m.group(1))
            yield from (Route(v, base) for v in ("GET", "POST", "PUT", "PATCH", "DELETE"))
            push = (m.group(1), "")
        elif s.startswith("member"):
            name = stack[-1][1] if stack else ""
            stack.append((f"../{name}", ""))
            continue
        elif s.startswith("collection"):
            stack.append(("..", ""))
            continue
        elif m := VERB.match(s):
            parts: list[str] = []
            for p, _ in stack:
                if p == "..":
                    parts[-1:] = [parts[-1].split("/")[0]] if parts else []
                elif p.startswith("../"):
                    parts[-1:] = [f"{p[3:]}/{{id}}"]
                else:
                    parts.append(p)
            yield Route(m.group(1).upper(), braces(under(*parts, m.group(2))))
        if opens:
            stack.append(push)
        elif s == "end" and stack:
            stack.pop()


def sinatra(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r"\s*(get|post|put|patch|delete|head|options)\s+['\"]([^'\"]+)['\"].*\bdo\b", line):
            said, gone = line_comments(lines, i)
            yield Route(m.group(1).upper(), braces(m.group(2)), i + 1, said, deprecated=gone)


EXTRACTORS = [Extractor("rails", (".rb",), rails), Extractor("sinatra", (".rb",), sinatra)]
