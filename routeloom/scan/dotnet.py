"""ASP.NET controllers and minimal APIs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from routeloom.scan.core import Extractor, Route, Schema, line_comments, object_of, typed, under, window

HTTP = re.compile(r"\[Http(Get|Post|Put|Patch|Delete|Head|Options)(?:\(\s*\"([^\"]*)\")?")
ROUTE = re.compile(r"\[Route(?:Prefix)?\(\s*\"([^\"]*)\"")
ACTION = re.compile(r"public\s+(?:virtual\s+|override\s+)?(?:async\s+)?([\w<>\[\],.? ]+?)\s+(\w+)\s*\(([^)]*)")


def classes(text: str) -> Iterator[tuple[str, Schema]]:
    for m in re.finditer(r"(?:class|record)\s+(\w+)[^{;]*\{(.*?)\n\s*\}", text, re.S):
        props, need, marks = {}, [], ""
        for line in m.group(2).split("\n"):
            s = line.strip()
            if s.startswith("["):
                marks += s
            if p := re.search(r"public\s+(?:required\s+)?([\w<>\[\]?]+)\s+(\w+)\s*\{\s*get", s):
                kind = p.group(1)
                many = kind.startswith("List<") or "[]" in kind
                own: Schema = {"type": "array"} if many else typed("csharp", kind.rstrip("?"))
                own |= {k: v for k, v in (("nullable", kind.endswith("?")), ("format", "email" if "EmailAddress" in marks else "")) if v}
                props[p.group(2)] = own
                if "Required" in marks or not (kind.endswith("?") or kind.startswith("List<")):
                    need.append(p.group(2))
                marks = ""
        if props:
            yield m.group(1), object_of(props, need)


def clean(path: str, controller: str, action: str) -> str:
    """Tokens and constraints of a route template; single slashes, none at the ends."""
    path = path.replace("[controller]", controller).replace("[action]", action)
    path = re.sub(r"\{\*?(\w+)(?:[:=?][^}]*)?\}", r"{\1}", path)
    return re.sub(r"/{2,}", "/", path).strip("/")


def template_of(path: str, text: str) -> str | None:
    """The conventional route template that a configuration or startup file maps, if it does."""
    name = path.rpartition("/")[2].lower()
    if not name.endswith(".cs") or not any(w in name for w in ("config", "startup", "program")):
        return None
    m = re.search(r"routeTemplate:\s*\"([^\"]+)\"", text) or re.search(r"MapHttpRoute\s*\([^,]+,\s*\"([^\"]+)\"", text)
    return m.group(1) if m else None


def conventional(template: str, controller: str, action: str) -> str:
    """A template's path without its optional id."""
    bare = re.sub(r"/(?:\{id\??\}|\[\{id\}\])$", "", template)
    return clean(bare.replace("{controller}", controller).replace("{action}", action), controller, action)


def mvc(path: str, text: str) -> Iterator[Route]:
    """Actions with an HTTP attribute. Controller names are lower case in paths; a path without any
    route attribute of class or action follows the project's template (see ``conventional``), else
    the controller's name."""
    if not path.endswith("Controller.cs"):
        return
    lines = text.split("\n")
    prefix, controller, class_auth, class_gone = "", "", False, False
    marks: list[str] = []
    for i, line in enumerate(lines):
        s = line.strip()
        if m := re.search(r"class\s+(\w+?)(?:Controller)?\s*(?::|\{|$)", s):
            joined = "\n".join(marks)
            controller, r = m.group(1), ROUTE.search(joined)
            prefix, class_auth, class_gone, marks = r.group(1) if r else "", "[Authorize" in joined, "[Obsolete" in joined, []
        elif s.startswith("["):
            marks.append(s)
        elif controller and (m := ACTION.search(s)):
            joined = "\n".join(marks)
            back, name, args = m.groups()
            renamed = re.search(r"\[ActionName\(\s*\"([^\"]+)", joined)
            action = renamed.group(1) if renamed else name.lower()
            verbs, sub = HTTP.findall(joined), ROUTE.search(joined)
            auth = ("[Authorize" in joined or class_auth) and "[AllowAnonymous" not in joined
            body = re.search(r"\[FromBody\]\s*(\w+)", args)
            inner = re.search(r"(?:ActionResult|Task|IEnumerable|List)<\s*(?:ActionResult<)?\s*(?:IEnumerable<|List<)?(\w+)", back)
            codes = [int(c) for c in re.findall(r"ProducesResponseType\([^)]*?(\d{3})", joined)]
            base = controller.lower()
            for verb, own in verbs:
                template = own or (sub.group(1) if sub else "")
                full = template.lstrip("~/") if template.startswith("~") else f"{prefix or base}/{template.lstrip('/')}"
                said = line_comments(lines, i - len(marks), "///")[0]
                yield Route(
                    verb.upper(), clean(full, base, action), i + 1, re.sub(r"</?summary>", "", said).strip(), [controller], class_gone or "[Obsolete" in joined, auth,
                    req_type=body.group(1) if body else "", resp_type=inner.group(1) if inner else "", codes=codes, conventional=None if prefix or template else (base, action),
                )
            marks = []
        elif s and not s.startswith("//"):
            marks = []


def minimal(path: str, text: str) -> Iterator[Route]:
    lines = text.split("\n")
    groups = {m.group(1): m.group(2) for m in re.finditer(r"\b(\w+)\s*=\s*\w+\.MapGroup\(\s*\"([^\"]+)\"", text)}
    for i, line in enumerate(lines):
        if m := re.search(r"\b(\w+)\.Map(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"\s*,?(.*)", line):
            rest = m.group(4)
            body = re.search(r"\(\s*(?:\[FromBody\]\s*)?([A-Z]\w+)\s+\w+", rest)
            back = re.search(r"Results\.Ok<(\w+)>", window(lines, i, 15))
            yield Route(m.group(2).upper(), under(groups.get(m.group(1), ""), re.sub(r"\{(\w+)(?:[:=?][^}]*)?\}", r"{\1}", m.group(3))), i + 1, auth="RequireAuthorization" in line, req_type=body.group(1) if body else "", resp_type=back.group(1) if back else "")


EXTRACTORS = [Extractor("aspnet-mvc", (".cs",), mvc, types=classes), Extractor("aspnet-minimal", (".cs",), minimal, types=classes)]
