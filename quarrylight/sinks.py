"""Reports: JSON, SARIF, HTML, text, graph pictures; and patches."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import sarif_level
from .operators import findings as ops
from .schema import SEVERITIES

#: Rows that one document on the driver may hold; larger results are written as tables.
DOCUMENT_ROWS = 100_000
COLOURS = {"critical": "#b00020", "high": "#d9480f", "medium": "#e67700", "low": "#2b8a3e", "info": "#1864ab"}


def write_json(found: DataFrame, path: str) -> None:
    """Findings as JSON lines, written by the executors."""
    found.write.mode("overwrite").json(path)


def _bounded(rows: DataFrame) -> list[dict]:
    """Rows for one document; more than it may hold raise, nothing is cut."""
    out = [r.asDict(recursive=True) for r in rows.limit(DOCUMENT_ROWS + 1).collect()]
    if len(out) > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows; write them as a table")
    return out


def _rows(found: DataFrame) -> list[dict]:
    return _bounded(ops.report_order(found))


def counts(found: DataFrame) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in ops.summary(found).collect():
        out.setdefault(r["dimension"], {})[r["value"]] = r["n"]
    return out


def to_json(found: DataFrame) -> str:
    return json.dumps({"findings": _rows(found), "summary": counts(found)}, indent=2, default=str)


def sarif_rows(found: DataFrame, root: str = "") -> DataFrame:
    """Findings with rule index, level, clamped positions, address and occurrence, as SARIF has them."""
    from .functions.scalar import relative_path

    f = ops.rule_index(found)
    return f.withColumns(
        {
            "level": sarif_level(F.col("severity")),
            "start_line": F.greatest(F.lit(1), F.coalesce("line", F.lit(1))),
            "start_col": F.greatest(F.lit(1), F.coalesce("col", F.lit(1))),
            "uri": relative_path(F.col("file"), root),
        }
    )


def to_sarif(found: DataFrame, root: str = "") -> str:
    rows = _rows(sarif_rows(found, root))
    rules = sorted({r["rule_index"]: r for r in reversed(rows)}.items())
    precision = {"certain": "very-high"}
    return json.dumps(
        {
            "$schema": "https://json.schemastore.org/sarif-2.1.0.json",
            "version": "2.1.0",
            "runs": [
                {
                    "tool": {"driver": {"name": "quarrylight", "version": "0.1.0", "rules": [
                        {
                            "id": r["rule_id"], "shortDescription": {"text": r["title"] or r["rule_id"]}, "defaultConfiguration": {"level": r["level"]},
                            "properties": {"security-severity": f"{(r['cvss'] or {}).get('base') or 0.0:.1f}", "precision": precision.get(r["confidence"], r["confidence"]), "tags": [t for t in (r["cwe"], r["owasp"]) if t]},
                        }
                        for _, r in rules
                    ]}},
                    "results": [
                        {
                            "ruleId": r["rule_id"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": r["message"] or r["rule_id"]},
                            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["start_line"], "startColumn": r["start_col"]}}}],
                            "partialFingerprints": {"primary": f"{r['rule_id']}:{r['uri']}:{r['print']}:{r['occurrence']}"},
                        }
                        for r in rows
                    ],
                }
            ],
        },
        indent=2,
    )


def to_html(found: DataFrame) -> str:
    n, rows = counts(found), _rows(found)
    total = max(1, n["total"]["all"])
    bars = "".join(f'<div class="bar"><b>{s}</b><span style="width:{100 * n["severity"][s] / total:.1f}%;background:{COLOURS[s]}"></span>{n["severity"][s]}</div>' for s in reversed(SEVERITIES))
    owasp = "".join(f"<tr><td>{html.escape(k)}</td><td>{v}</td></tr>" for k, v in sorted(n.get("owasp", {}).items(), key=lambda x: (-x[1], x[0])))
    body = "".join(
        f"<tr><td>{r['severity']}</td><td>{html.escape(r['rule_id'])}</td><td>{html.escape(r['file'] or '')}:{r['line']}</td><td>{html.escape(r['message'] or '')}</td><td><code>{html.escape(r['snippet'] or '')}</code></td></tr>" for r in rows
    )
    style = "body{font:14px sans-serif}.bar span{display:inline-block;height:10px;margin:0 8px}td,th{padding:2px 8px;text-align:left}"
    return f"<!doctype html><meta charset=utf-8><title>Findings</title><style>{style}</style><h1>{n['total']['all']} findings</h1>{bars}<table>{owasp}</table><table><tr><th>Severity<th>Rule<th>Place<th>Message<th>Code</tr>{body}</table>"


def to_text(found: DataFrame, counters: DataFrame | None = None) -> str:
    n, out, file = counts(found), [], None
    for r in sorted(_rows(found), key=lambda r: (r["file"] or "", r["line"] or 0)):
        if r["file"] != file:
            file = r["file"]
            out.append(f"\n{file}")
        score = f" {r['cvss']['base']:.1f}" if r["cvss"] else ""
        out.append(f"  {r['line']}: [{r['severity']}{score}] {r['rule_id']}: {r['message']}")
    total = max(1, n["total"]["all"])
    out.append(f"\n{n['total']['all']} findings")
    out += [f"  {s:<9}{n['severity'][s]:>6} {'#' * round(40 * n['severity'][s] / total)}" for s in reversed(SEVERITIES)]
    if counters is not None:
        out.append("triage: " + ", ".join(f"{r['n']} {r['triage_state']}" for r in counters.orderBy("triage_state").collect()))
    return "\n".join(out)


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph as text for Graphviz."""
    fill = {"FILE": "lightgrey", "FUNCTION": "lightblue", "CALL_SITE": "lightyellow", "ASSIGNMENT": "lightgreen", "PARAMETER": "lavender"}
    line = {"DATA_FLOW": "bold", "CONTROL_FLOW": "dashed", "CALLS": "dotted"}
    quote = lambda s: json.dumps((s or "")[:40])
    out = [f"  {r['id']} [label={quote(r['type'] + ' ' + (r['label'] or ''))}, style=filled, fillcolor={fill.get(r['type'], 'white')}];" for r in _bounded(nodes.select("id", "type", "label").orderBy("id"))]
    out += [f"  {r['src']} -> {r['dst']} [label={quote(r['type'])}, style={line.get(r['type'], 'solid')}];" for r in _bounded(edges.select("src", "dst", "type").orderBy("src", "dst", "type"))]
    return "digraph code {\n" + "\n".join(out) + "\n}\n"


FORMATS = {"json": to_json, "sarif": to_sarif, "html": to_html, "text": to_text}


def export(found: DataFrame, fmt: str, path: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(FORMATS[fmt](found))
    return path


def apply_fix(path: str, old: str, new: str, line: int | None = None) -> int:
    """Replace a text that stands in the file exactly once, near the expected line; returns its line."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    n = content.count(old)
    if n != 1:
        raise ValueError(f"the text stands there {n} times")
    at = content[: content.index(old)].count("\n") + 1
    if line is not None and abs(at - line) > 3:
        raise ValueError(f"the text is at line {at}, not near {line}")
    with open(path, "w", encoding="utf-8") as f:
        f.write(content.replace(old, new))
    return at


def exit_code(found: DataFrame) -> int:
    return int(found.limit(1).count() > 0)
