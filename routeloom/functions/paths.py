"""Path operators as column expressions (P1-P12): no UDF, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path words that are never an id.
KEYWORDS = ["me", "self", "current", "latest", "new", "first", "last", "all", "count", "search"]
# Last path words of endpoints that hand out tokens.
TOKEN_WORDS = ["login", "signin", "sign-in", "register", "signup", "sign-up", "token", "refresh", "oauth", "authorize", "callback", "exchange"]

UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
ULID = r"\A[0-9A-HJKMNP-TV-Z]{26}\z"
NANO = r"\A[\p{L}\p{Nd}]+\z"
LETTERS = r"\A\p{L}+\z"
SLUG = r"\A[a-z][a-z0-9-]*-[0-9]+\z"
CAPS = r"\A[A-Z][A-Z0-9-]+\z"


def normalize_segment(seg: Column) -> Column:
    """One segment, or ``{id}``; lengths are bytes, the first rule that applies wins."""
    size = F.octet_length(seg)
    is_id = (
        seg.rlike(r"\A[0-9]+\z") | seg.rlike(UUID) | ((size == 26) & seg.rlike(ULID)) | ((size >= 21) & seg.rlike(NANO) & ~seg.rlike(LETTERS))
        | seg.rlike(SLUG) | ((size >= 3) & seg.rlike(CAPS)) | (~seg.isin(KEYWORDS) & (size > 32))
    )
    return F.when(is_id, F.lit("{id}")).otherwise(seg)


def is_likely_id(seg: Column) -> Column:
    """P3."""
    return normalize_segment(seg) == "{id}"


def normalize_path(raw: Column, strip_query: bool = False) -> Column:
    """The query string stays part of the last segment unless strip_query is asked for."""
    raw = F.split_part(raw, F.lit("?"), F.lit(1)) if strip_query else raw
    return F.when(raw == "", "/").otherwise(F.array_join(F.transform(F.split(raw, "/", -1), normalize_segment), "/"))


def framework_path(path: Column) -> Column:
    """``:name`` and ``<name>`` become ``{name}``, repeated slashes one."""
    path = F.regexp_replace(path, r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")
    path = F.regexp_replace(path, r"<([A-Za-z_][A-Za-z0-9_]*)>", "{$1}")
    return F.regexp_replace(path, "/{2,}", "/")


#: P5: the rewrite steps of each framework's own parameter syntax, in order.
DIALECTS: dict[str, list[tuple[str, str]]] = {
    "gin": [(r"[:*]([A-Za-z_][A-Za-z0-9_]*)", "{$1}")],
    "django": [(r"<(?:[A-Za-z_]+:)?([A-Za-z_][A-Za-z0-9_]*)>", "{$1}")],
    "rails": [(r"[:*]([A-Za-z_][A-Za-z0-9_]*)", "{$1}"), (r"\(\.\{format\}\)", "")],
    "sinatra": [(r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")],
    "laravel": [(r"\{([A-Za-z_][A-Za-z0-9_]*)\?\}", "{$1}")],
    "symfony": [(r"\{!?([A-Za-z_][A-Za-z0-9_]*)(?:<[^>]*>)?(?:\?[^}]*)?\}", "{$1}")],
    "codeigniter": [(r"\(:num\)", "{id}"), (r"\(:(?:alpha|segment|any|alphanum|hash)\)", "{param}")],
    "zend": [(r"\[/:([A-Za-z_][A-Za-z0-9_]*)\]", "/{$1}"), (r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}"), (r"[\[\]]", "")],
    "actix": [(r"\{([A-Za-z_][A-Za-z0-9_]*):[^}]*\}", "{$1}"), (r":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")],
    "ktor": [(r"\{([A-Za-z_][A-Za-z0-9_]*)(?:\?|\.\.\.)\}", "{$1}")],
}


def dialect_path(path: Column, framework: str) -> Column:
    """P5, with a leading slash."""
    for pattern, to in DIALECTS[framework]:
        path = F.regexp_replace(path, pattern, to)
    return F.regexp_replace(F.concat(F.lit("/"), path), "/{2,}", "/")


def _file_parts(path: Column) -> Column:
    """Segments of a route file with bracket parameters rewritten, groups and ``index`` dropped."""
    parts = F.split(path, "/")
    one = lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\[?\.{3}([^\]]+)\]\]?$", "{$1}"), r"^\[([^\]]+)\]$", "{$1}")
    return F.transform(F.filter(parts, lambda s: (s != "") & (s != "index") & ~s.rlike(r"^\(.*\)$")), one)


def file_route(path: Column, root: str) -> Column:
    """A page file below root (``pages/api``, ``pages``, ``server/api`` ...) -> URL path."""
    inner = F.regexp_replace(path, rf"^.*?{root}/", "")
    inner = F.regexp_replace(inner, r"(?:\.(?:get|post|put|patch|delete|head|options))?\.(?:ts|js|tsx|jsx|vue|mjs)$", "")
    inner = F.regexp_replace(inner, r"/route$|^route$", "")
    return F.concat(F.lit("/"), F.array_join(_file_parts(inner), "/"))


def file_method(path: Column) -> Column:
    """The method suffix of a server file (``users.get.ts``), or null."""
    found = F.regexp_extract(path, r"\.(get|post|put|patch|delete|head|options)\.[a-z]+$", 1)
    return F.when(found != "", F.upper(found))


def path_params(pattern: Column) -> Column:
    """Distinct parameter names in order."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"\{([^}]+)\}"), 1))


def query_params(raw: Column) -> Column:
    """Distinct non-empty names after the first ``?``, not URL-decoded."""
    query = F.substring_index(raw, "?", 1)
    rest = F.substring(raw, F.length(query) + 2, F.length(raw))
    names = F.transform(F.split(rest, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.when(raw.contains("?"), F.array_distinct(F.filter(names, lambda x: x != ""))).otherwise(F.array().cast("array<string>"))


def url_template(pattern: Column, style: str) -> Column:
    """Parameters for ``postman`` ({{x}}), ``bruno`` (:x) or ``shell`` ($x)."""
    return F.regexp_replace(pattern, r"\{([^}]+)\}", {"postman": "{{$1}}", "bruno": ":$1", "shell": "\\$$1"}[style])


def postman_pattern(url: Column) -> Column:
    """P10: inverse of the postman template; a query stays, as it is part of a pattern."""
    bare = F.regexp_replace(url, r"^\{\{baseUrl\}\}", "")
    return F.regexp_replace(bare, r"\{\{([^}]+)\}\}", "{$1}")


def slug(text: Column) -> Column:
    """Runs of other characters become one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-"), r"^-|-$", "")


def is_token_path(pattern: Column) -> Column:
    """The last word that is not a parameter hands out tokens."""
    words = F.filter(F.split(F.lower(pattern), "/"), lambda s: (s != "") & ~(s.startswith("{") & s.endswith("}")))
    return F.coalesce(F.try_element_at(words, F.lit(-1)).isin(TOKEN_WORDS), F.lit(False))
