"""Merges with existing documents.

Differences from a plain reading of the formats, all on purpose: script blocks keep their command,
merged Swagger operations are merged as they are, OpenAPI components are merged too, and several
variants of one endpoint are told apart by the item's name.
"""

from __future__ import annotations

import copy
import json
import re
from pathlib import Path
from typing import Any

import yaml

from routeloom.export.documents import POSTMAN_SCHEMA, RULE

Defaults = dict[str, Any]


def load_document(path: str) -> dict | None:
    """A YAML or JSON map, None if there is no such file."""
    p = Path(path)
    if not p.exists():
        return None
    return (json.loads(p.read_text()) if p.suffix == ".json" else yaml.safe_load(p.read_text())) or {}


def load_bruno(directory: str) -> dict[str, str]:
    """The texts of a collection directory by file name."""
    top = Path(directory)
    return {str(p.relative_to(top)): p.read_text() for p in sorted(top.rglob("*")) if p.is_file() and p.suffix in (".bru", ".json")} if top.is_dir() else {}


def merge_spec(existing: dict | None, incoming: dict) -> tuple[dict, list[str]]:
    """G1: operations are only added, by (path, method); so are components and security definitions."""
    out = copy.deepcopy(existing) if existing else {k: copy.deepcopy(v) for k, v in incoming.items() if k != "paths"}
    paths = out.setdefault("paths", {}) or {}
    out["paths"] = paths
    added = []
    for path, item in sorted(incoming.get("paths", {}).items()):
        mine = paths.setdefault(path, {}) or {}
        paths[path] = mine
        for method, op in item.items():
            if method not in mine:
                mine[method] = copy.deepcopy(op)
                added.append(f"{method.upper()} {path}")
    for section in ("components", "securityDefinitions"):
        for name, value in incoming.get(section, {}).items():
            mine = out.setdefault(section, {}).setdefault(name, {})
            for k, v in value.items():
                if isinstance(mine, dict):
                    mine.setdefault(k, copy.deepcopy(v))
    return out, added


def item_url(item: dict) -> str:
    url = item.get("request", {}).get("url", "")
    return url if isinstance(url, str) else url.get("raw", "")


def item_pattern(url: str) -> str:
    """P10."""
    return re.sub(r"\{\{([^}]+)\}\}", r"{\1}", re.sub(r"^\{\{baseUrl\}\}", "", url))


def item_key(item: dict) -> str:
    """``METHOD pattern``, with the variant's label where the name carries one."""
    label = re.search(r" \(([^()]*)\)$", item.get("name", ""))
    return f"{item.get('request', {}).get('method', '').upper()} {item_pattern(item_url(item))}" + (f" ({label.group(1)})" if label else "")


def item_body(item: dict) -> str:
    return (item.get("request", {}).get("body") or {}).get("raw", "")


def diff_items(existing: dict, incoming: dict) -> dict[str, list]:
    """Added items, conflicts (key, old, new) by body text, and unchanged keys."""
    known = {item_key(i): i for i in reversed(existing.get("item", []))}
    out: dict[str, list] = {"added": [], "conflicts": [], "unchanged": []}
    for item in incoming.get("item", []):
        key = item_key(item)
        if key not in known:
            out["added"].append(item)
        elif item_body(known[key]) != item_body(item):
            out["conflicts"].append((key, known[key], item))
        else:
            out["unchanged"].append(key)
    return out


def merge_bodies(old: dict, new: dict) -> dict:
    """The old item with the top-level body names that only the new one has."""
    out = copy.deepcopy(old)
    try:
        mine, theirs = json.loads(item_body(old) or "{}"), json.loads(item_body(new) or "{}")
    except ValueError:
        return out
    if isinstance(mine, dict) and isinstance(theirs, dict):
        both = {**theirs, **mine}
        out["request"]["body"] = {**copy.deepcopy(new["request"].get("body") or {"mode": "raw"}), **(old["request"].get("body") or {}), "raw": json.dumps(dict(sorted(both.items())), indent=2, ensure_ascii=False)}
    return out


def merge_collection(existing: dict, incoming: dict, resolutions: dict[str, str] | None = None) -> dict:
    """Conflicts are kept, replaced or merged by key (default keep); new items follow the old ones."""
    found = diff_items(existing, incoming)
    newer = {key: new for key, _, new in found["conflicts"]}
    choice = resolutions or {}
    items = []
    for item in existing.get("item", []):
        key = item_key(item)
        how = choice.get(key, "keep") if key in newer else "keep"
        items.append(newer[key] if how == "replace" else merge_bodies(item, newer[key]) if how == "merge" else item)
    info = {**existing.get("info", {})}
    info.setdefault("schema", POSTMAN_SCHEMA)
    return {**{k: v for k, v in existing.items() if k not in ("info", "item")}, "info": info, "item": [*items, *found["added"]]}


def diff_bruno(existing: dict[str, str], incoming: dict[str, str]) -> dict[str, list[str]]:
    """Files to write, conflicting and equal ones; an existing manifest is never touched."""
    out: dict[str, list[str]] = {"added": [], "conflicts": [], "unchanged": []}
    for name, text in sorted(incoming.items()):
        if name not in existing:
            out["added"].append(name)
        elif name == "bruno.json" or existing[name] == text:
            out["unchanged"].append(name)
        else:
            out["conflicts"].append(name)
    return out


TITLE = re.compile(rf"^{re.escape(RULE[:5])}-*\n# ([A-Z]+ /.*)\n{re.escape(RULE[:5])}-*$", re.M)


def script_blocks(script: str) -> list[tuple[str, str]]:
    """(title, block with its command) of a request script."""
    heads = list(TITLE.finditer(script))
    return [(m.group(1), script[m.start():n.start() if n else len(script)].rstrip("\n")) for m, n in zip(heads, [*heads[1:], None], strict=True)]


def merge_script(existing: str, incoming: str) -> tuple[str, list[str]]:
    """Blocks whose title is new are appended whole."""
    known = {t for t, _ in script_blocks(existing)}
    new = [(t, b) for t, b in script_blocks(incoming) if t not in known]
    return (existing.rstrip("\n") + "".join(f"\n\n{b}" for _, b in new) + "\n" if new else existing), [t for t, _ in new]


def defaults() -> Defaults:
    """Settings without any file."""
    skip = ["node_modules", "vendor", "__pycache__", "bin", "obj", ".git"]
    return {
        "proxy": {"port": 4000, "bind": "127.0.0.1", "body_size_limit": 1048576}, "scan": {"dir": "./", "frameworks": [], "exclude": [f"**/{s}/**" for s in skip]},
        "inference": {"confidence_threshold": 0.9}, "export": {"default_format": "openapi", "min_calls": 0, "info_title": "Discovered API", "info_version": "0.0.1", "output_dir": "", "outputs": {}},
        "output": {"no_color": False, "json_indent": 2}, "list": {"columns": ""}, "path_overrides": [],
    }


def overlay(base: Defaults, over: Defaults | None) -> Defaults:
    """Non-zero values win, maps by key; path overrides are appended."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        if k == "path_overrides":
            out[k] = [*out.get(k, []), *(v or [])]
        elif isinstance(v, dict):
            out[k] = overlay(out.get(k) or {}, v)
        elif v not in (None, "", 0, [], False):
            out[k] = v
    return out
