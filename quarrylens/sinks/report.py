"""A self-contained HTML report over small results: verdict, panels, findings, inventory."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pipeline import report_order
from . import panels, timeline

#: Findings and inventory rows that the page lists; the full tables are in the other outputs.
LISTED = 2_000

_PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>
body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:3px 6px;text-align:left;vertical-align:top}}
.critical,.high{{background:#fdd}}.medium{{background:#ffd}}</style></head><body><h1>{title}</h1><p class="{cls}">{verdict}</p>
<label>Artifact <select onchange="for(const r of document.querySelectorAll('#f tr[data-a]'))r.hidden=this.value&&r.dataset.a!==this.value"><option></option>{options}</select></label>
{panels}<h2>Findings</h2>{note}<table id="f"><tr><th>Time</th><th>Severity</th><th>Title</th><th>MITRE</th><th>Entity</th><th>Reason</th></tr>{findings}</table><h2>Inventory</h2>{inventory}</body></html>
"""


def _table(title: str, rows: DataFrame, where: str = "records.jsonl") -> str:
    got = rows.limit(LISTED + 1).collect()
    if not got:
        return ""
    if len(got) > LISTED:
        title, got = f"{title}: {LISTED} of {rows.count()} shown, all are in {where}", got[:LISTED]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x if x is not None else ''))}</td>" for x in r) + "</tr>" for r in got)
    return f"<details><summary>{html.escape(title)}</summary><table><tr>{head}</tr>{body}</table></details>"


def render(findings: DataFrame, observations: DataFrame, tables: dict[str, DataFrame], title: str = "Triage report") -> str:
    counts = {r[0]: r[1] for r in panels.by_severity(findings).select("severity", "n").collect()}
    bad = counts.get("critical", 0) + counts.get("high", 0)
    verdict = f"{bad} critical or high findings" if bad else "no critical or high findings"
    artifacts = [r[0] for r in findings.select("artifact").distinct().orderBy("artifact").collect()]
    shown = report_order(findings).limit(LISTED).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "severity", "title", F.array_join("mitre", ", "), timeline.entity_summary(), "reason", "artifact").collect()
    total = sum(counts.values())
    note = f"<p>{len(shown)} of {total} shown, all are in findings.jsonl</p>" if total > len(shown) else ""
    rows = "".join(f'<tr class="{r[1]}" data-a="{html.escape(r[6])}">' + "".join(f"<td>{html.escape(str(x or ''))}</td>" for x in r[:6]) + "</tr>" for r in shown)
    parts = [_table("Findings by severity", panels.by_severity(findings)), _table("Repeated sources", panels.repeated_names(findings))]
    for kind, label, f, columns in (
        ("net_conn", "Connections", panels.net_panel, ("proto", "laddr", "lport", "raddr", "rport", "state", "pid")), ("process", "Processes", panels.process_panel, ("pid", "ppid", "image", "signed", "integrity")),
        ("execution", "Executions", panels.execution_panel, ("source", "path", "last_run", "run_count")), ("usn_event", "File changes", panels.usn_panel, ("ts", "path", "reason")),
        ("logon_session", "Logon sessions", panels.logon_panel, ("user", "logon_type", "logon_time")), ("file_meta", "Downloaded files", panels.downloads_panel, ("path", "zone_identifier")),
    ):
        if kind in tables:
            parts.append(_table(label, f(tables[kind]).select(*columns)))
    inventory = "".join(_table(f"{r['category']} ({r['n']})", observations.filter(F.col("category") == r["category"]).select("title", "path", "details").orderBy("title"), "observations.jsonl") for r in panels.by_category(observations).collect())
    options = "".join(f"<option>{html.escape(x)}</option>" for x in artifacts)
    return _PAGE.format(title=html.escape(title), cls="high" if bad else "", verdict=verdict, options=options, panels="".join(parts), note=note, findings=rows, inventory=inventory)


def write_report(path: str, *args, **kwargs) -> None:
    Path(path).write_text(render(*args, **kwargs), encoding="utf-8")
