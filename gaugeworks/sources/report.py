"""JSON and HTML reports of bounded results."""

from __future__ import annotations

import datetime as dt
import html
import json
from collections.abc import Mapping
from pathlib import Path

LIST_ITEMS, TABLE_ROWS, OTHER_ITEMS = 50, 200, 10


def plain(value):
    """Python scalars and lists for NumPy and Spark values; TypeError for anything else."""
    if hasattr(value, "asDict"):
        return value.asDict(recursive=True)
    if type(value).__module__ == "numpy":
        kind = getattr(value, "dtype", None)
        if kind is not None and kind.kind in "iuf":
            return value.tolist()
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def escape(text: str) -> str:
    """HTML text; apostrophes stay."""
    return html.escape(str(text), quote=False).replace('"', "&quot;")


def _number(v) -> str:
    return escape(f"{v:.6g}" if isinstance(v, float) else v)


def _rows(cells) -> str:
    return "".join("<tr>" + "".join(cells_of) + "</tr>" for cells_of in cells)


def render(value, depth: int = 0) -> str:
    """A value as HTML: mappings and lists of mappings as tables, long lists cut with a note of their size."""
    if isinstance(value, Mapping):
        return "<table>" + _rows([f"<th>{escape(k)}</th>", f"<td>{render(v, depth + 1)}</td>"] for k, v in value.items()) + "</table>"
    if not isinstance(value, (list, tuple)):
        return _number(value)
    if not value:
        return "<em>none</em>"
    note = lambda shown: f"<p>{shown} of {len(value)}</p>" if len(value) > shown else ""
    if isinstance(value[0], Mapping):
        names = list(value[0])
        head = [f"<th>{escape(n)}</th>" for n in names]
        body = ([f"<td>{render(r.get(n), depth + 1)}</td>" for n in names] for r in value[:TABLE_ROWS])
        return "<table>" + _rows([head]) + _rows(body) + "</table>" + note(TABLE_ROWS)
    scalars = all(not isinstance(v, (Mapping, list, tuple)) for v in value[:5])
    shown = LIST_ITEMS if scalars else OTHER_ITEMS
    return "<ul>" + "".join(f"<li>{render(v, depth + 1)}</li>" for v in value[:shown]) + "</ul>" + note(shown)


class Report:
    """Named sections in order; a name used again replaces its section."""

    def __init__(self, dataset_name: str):
        self.dataset_name = dataset_name
        self.created_at = dt.datetime.now(dt.timezone.utc).isoformat()
        self.sections: dict = {}

    def add(self, name: str, content) -> Report:
        self.sections[name] = content
        return self

    def to_dict(self) -> dict:
        return {"dataset": self.dataset_name, "created_at": self.created_at, "sections": dict(self.sections)}

    def save_json(self, path) -> Path:
        return _write(path, json.dumps(self.to_dict(), indent=2, default=plain))

    def save_html(self, path) -> Path:
        body = "".join(f"<h2>{escape(n)}</h2>{render(json.loads(json.dumps(v, default=plain)))}" for n, v in self.sections.items())
        style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.25em .6em;text-align:left;vertical-align:top}"
        title = escape(self.dataset_name)
        return _write(path, f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1><p>{escape(self.created_at)}</p>{body}</body></html>')


def _write(path, text: str) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path
