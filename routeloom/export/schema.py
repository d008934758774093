"""Nested schemas from flattened field statistics (N2-N5) and JSON samples."""

from __future__ import annotations

import json
from typing import Any

THRESHOLD = 0.9


def nest(fields: list[dict], location: str, threshold: float = THRESHOLD) -> dict | None:
    """An object tree from the dotted paths of one location; a leaf is required from the threshold on."""
    root: dict[str, Any] = {"type": "object", "properties": {}}
    for f in sorted((f for f in fields if f["location"] == location), key=lambda f: f["field_path"]):
        node = root
        *parents, leaf = f["field_path"].split(".")
        for name in parents:
            node = node.setdefault("properties", {}).setdefault(name, {"type": "object", "properties": {}})
        try:
            own = json.loads(f["type_json"])
        except (TypeError, ValueError):
            own = {"type": "string"}
        node.setdefault("properties", {})[leaf] = {k: v for k, v in own.items() if k != "xml_attr"}
        total = f["total_calls"] or 0
        if (f["seen_count"] / total if total else 0.0) >= threshold and leaf not in node.setdefault("required", []):
            node["required"].append(leaf)
        if not node.get("required", True):
            del node["required"]
    return root if root["properties"] else None


def annotate_required(schema: dict, fields: list[dict], location: str, threshold: float = THRESHOLD, prefix: str = "") -> dict:
    """The tree with required lists from confidence; a node without statistics keeps its own list."""
    share = {f["field_path"]: (f["seen_count"] / f["total_calls"] if f["total_calls"] else 0.0) for f in fields if f["location"] == location}

    def walk(node: dict, path: str) -> dict:
        out = dict(node)
        if "items" in node:
            out["items"] = walk(node["items"], f"{path}[]")
        props = node.get("properties")
        if props:
            full = {name: f"{path}.{name}" if path else name for name in props}
            out["properties"] = {name: walk(child, full[name]) for name, child in sorted(props.items())}
            if any(p in share for p in full.values()):
                need = [name for name in sorted(props) if share.get(full[name], 0.0) >= threshold]
                out.pop("required", None)
                if need:
                    out["required"] = need
        return out

    return walk(schema, prefix)


def sample(schema: dict | None) -> Any:
    """A value of the schema's shape with empty leaves."""
    if schema is None:
        return None
    kind = schema.get("type", "")
    if kind == "object":
        return {k: sample(v) for k, v in sorted(schema.get("properties", {}).items())}
    return {"array": [], "integer": 0, "number": 0, "boolean": False}.get(kind, "")


def sample_text(schema: dict, prefix: str = "") -> str:
    """The sample as JSON indented by two, later lines behind a prefix."""
    return json.dumps(sample(schema), indent=2, ensure_ascii=False).replace("\n", f"\n{prefix}")
