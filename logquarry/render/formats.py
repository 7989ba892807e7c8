"""A report tree as text, JSON, YAML, Markdown or HTML."""

from __future__ import annotations

import base64
import html
import json
import zlib
from pathlib import Path

from .units import bar

TITLES = {
    "summary": "SUMMARY", "sql_performance": "SQL PERFORMANCE", "events": "EVENTS", "errors": "ERROR CLASSES", "sql_summary": "SQL SUMMARY", "tempfiles": "TEMP FILES",
    "locks": "LOCKS", "maintenance": "MAINTENANCE", "checkpoints": "CHECKPOINTS", "connections": "CONNECTIONS & SESSIONS", "clients": "CLIENTS", "sql_overview": "SQL OVERVIEW", "sql_detail": "SQL DETAIL",
}


def _label(key: str) -> str:
    return key.replace("_", " ").capitalize()


def _parts(section) -> tuple[list[tuple[str, object]], list[tuple[str, list[dict]]]]:
    """Single values, and tables (lists of rows, or maps)."""
    section = {"rows": section} if isinstance(section, list) else section
    single = [(k, v) for k, v in section.items() if not isinstance(v, (list, dict))]
    tables = []
    for k, v in section.items():
        if isinstance(v, dict) and v:
            tables.append((k, [{"name": a, **(b if isinstance(b, dict) else {"value": b})} for a, b in v.items()]))
        elif isinstance(v, list) and v:
            tables.append((k, [r if isinstance(r, dict) else {"value": r} for r in v]))
    return single, tables


def _cell(v, most: int | None = None) -> str:
    if isinstance(v, list):
        v = ", ".join(" ".join(str(y) for y in x.values()) if isinstance(x, dict) else str(x) for x in v)
    elif isinstance(v, dict):
        v = ", ".join(f"{a} {b}" for a, b in v.items())
    text = " ".join(str("" if v is None else v).split())
    return text[: most - 3] + "..." if most and len(text) > most else text


def _columns(rows: list[dict]) -> list[str]:
    return list(dict.fromkeys(k for r in rows for k in r))


def to_text(report: dict) -> str:
    out = []
    for name, section in report.items():
        out.append(f"\n{TITLES.get(name, name.upper())}\n")
        single, tables = _parts(section)
        wide = max((len(_label(k)) for k, _ in single), default=0)
        out += [f"  {_label(k):<{wide}} : {v}" for k, v in single]
        for key, rows in tables:
            out.append(f"\n  {_label(key)}:")
            cols = _columns(rows)
            if set(cols) & {"bucket", "bucket_index"} and "count" in cols:
                peak = max(r["count"] for r in rows)
                out += [f"    {str(r.get('bucket', r.get('bucket_index'))):<14} | {bar(r['count'], peak)} {r['count']}" for r in rows]
                continue
            cells = [[_cell(r.get(c), 80) for c in cols] for r in rows]
            widths = [max(len(_label(c)), *(len(x[i]) for x in cells)) for i, c in enumerate(cols)]
            out.append("    " + "  ".join(_label(c).ljust(w) for c, w in zip(cols, widths, strict=True)).rstrip())
            out += ["    " + "  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    return "\n".join(out).lstrip("\n") + "\n"


def to_markdown(report: dict) -> str:
    out = []
    for name, section in report.items():
        out.append(f"## {TITLES.get(name, name.upper())}\n")
        single, tables = _parts(section)
        out += [f"- **{_label(k)}**: {v}" for k, v in single] + [""] * bool(single)
        for key, rows in tables:
            cols = _columns(rows)
            out += [f"### {_label(key)}\n", "| " + " | ".join(map(_label, cols)) + " |", "|" + "---|" * len(cols)]
            out += ["| " + " | ".join(_cell(r.get(c)).replace("|", "\\|") for c in cols) + " |" for r in rows] + [""]
    return "\n".join(out) + "\n"


def to_json(report: dict, compact: bool = False) -> str:
    return json.dumps(report, ensure_ascii=False, separators=(",", ":")) if compact else json.dumps(report, ensure_ascii=False, indent=2)


def to_yaml(report: dict) -> str:
    import yaml

    return yaml.safe_dump(json.loads(to_json(report)), sort_keys=False, allow_unicode=True)


def to_html(report: dict, title: str = "Log report") -> str:
    """One page without outside resources; the whole tree is kept in it, compressed, for tools."""
    body = []
    for name, section in report.items():
        body.append(f"<section><h2>{html.escape(TITLES.get(name, name.upper()))}</h2>")
        single, tables = _parts(section)
        body.append("<dl>" + "".join(f"<dt>{html.escape(_label(k))}</dt><dd>{html.escape(str(v))}</dd>" for k, v in single) + "</dl>")
        for key, rows in tables:
            cols = _columns(rows)
            head = "".join(f"<th>{html.escape(_label(c))}</th>" for c in cols)
            lines = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r.get(c)))}</td>" for c in cols) + "</tr>" for r in rows)
            body.append(f"<h3>{html.escape(_label(key))}</h3><table><tr>{head}</tr>{lines}</table>")
        body.append("</section>")
    data = base64.b64encode(zlib.compress(to_json(report, True).encode())).decode()
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}dt{float:left;clear:left;width:16em}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(body)}<script type="application/octet-stream" id="data">{data}</script></body></html>\n'


FORMATS = {"text": to_text, "json": to_json, "json-compact": lambda r: to_json(r, True), "yaml": to_yaml, "md": to_markdown, "html": to_html}


def html_name(inputs: list[str]) -> str:
    """The file an HTML report is written to: named after the one input, or after their number."""
    return f"{Path(inputs[0]).name}.html" if len(inputs) == 1 else f"report_{len(inputs)}_files.html"
