"""Column specs (SRC-13): a spec is ``{column: type}``.  Spec files in the
scaffold layout (``table:``, ``columns: {name: {type: t}}``,
``validations:``) are loaded on the driver with a YAML parser; a file
without ``table:`` is rejected."""

from __future__ import annotations

try:
    import yaml
except ImportError:  # pragma: no cover - gated optional dependency
    yaml = None


def load_spec_text(text: str) -> tuple[str, dict[str, str]]:
    """(table filename, {column: type}) from spec text."""
    if yaml is None:
        raise RuntimeError("spec files need a YAML parser (PyYAML)")
    doc = yaml.safe_load(text) or {}
    if not isinstance(doc, dict) or not doc.get("table"):
        raise ValueError("spec has no 'table:' entry")
    cols = doc.get("columns") or {}
    out = {}
    if isinstance(cols, dict):
        for name, body in cols.items():
            t = body.get("type", "raw") if isinstance(body, dict) else "raw"
            out[str(name)] = str(t)
    return str(doc["table"]), out


def load_spec(path: str) -> tuple[str, dict[str, str]]:
    with open(path, encoding="utf-8") as f:
        return load_spec_text(f.read())
