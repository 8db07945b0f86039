"""Reports as JSON, plain text, HTML and a summary. Findings are aggregated by Spark; the driver only writes what is shown."""

from __future__ import annotations

import html
import json
from collections import defaultdict
from datetime import UTC, datetime
from itertools import groupby
from pathlib import Path

from pyspark.sql import functions as F

from lintel.functions.messages import shortened, subject_key, title
from lintel.operators import report
from lintel.plans.scan import ScanResult


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _plain(row) -> dict:  # noqa: ANN001
    out = {}
    for k, v in row.asDict(recursive=True).items():
        out[k] = [{a: b for a, b in x.items() if b is not None} for x in v] if isinstance(v, list) else v
    return {k: v for k, v in out.items() if v is not None}


def _without(row, key: str) -> dict:  # noqa: ANN001
    return {k: v for k, v in row.asDict().items() if k != key and v is not None}


def as_dict(result: ScanResult) -> dict:
    """The report, in a fixed order."""
    messages, log = result.messages.cache(), result.log.cache()  # skipped, warnings and errors are parts of the log
    try:
        scanned: dict[str, list] = defaultdict(list)
        for r in report.scanned(messages).orderBy("filename", "checkname").collect():
            scanned[r["filename"]].append({"checkname": r["checkname"], "issue_count": r["issue_count"]})
        return {
            "timestamp": now(),
            "scanned": [{"filename": k, "issues": v} for k, v in scanned.items()],
            "skipped": [r.asDict() for r in result.skipped.orderBy("path", "reason").collect()],
            "details_subject_focused": [_plain(r) for r in report.by_subject(messages).orderBy("subject", "archive_name").collect()],
            "details_check_focused": [{"checkname": k, "issues": [_without(r, "checkname") for r in rows]} for k, rows in groupby(report.issue_rows(messages).toLocalIterator(), key=lambda r: r["checkname"])],
            "pdf_files": [r["entry"] for r in result.pdf_files.orderBy("entry").collect()],
            "errors": [{"level": "error", "message": r["message"]} for r in result.errors.orderBy("message").collect()],
            "warnings": [{"level": "warning", "message": r["message"]} for r in result.warnings.orderBy("message").collect()],
        }
    finally:
        messages.unpersist()
        log.unpersist()


def as_json(result: ScanResult) -> str:
    return json.dumps(as_dict(result), indent=2, ensure_ascii=False)


def as_plain(result: ScanResult, location: str) -> str:
    """Sections by package, file and check; more than one finding of a check in a file are cut to 80 bytes. Findings come sorted, a file's at a time."""
    total = result.files.count()
    out = ["=== Scan Results ===", f"Location: {location}", f"Files scanned: {total}", ""]
    messages = result.messages.cache()
    try:
        numbers = report.totals(messages).first()
        if not numbers["total_issues"]:
            return "\n".join([*out, "✅ No issues found!", ""])
        counts = {r["test_name"]: r["count"] for r in messages.groupBy("test_name").count().collect()}
        out += [f"❌ Found {numbers['total_issues']} issues in {numbers['files_with_issues']} files:", ""]
        is_file = F.col("source_kind") == "file"
        rows = messages.select(is_file.alias("is_file"), subject_key().alias("subject"), "test_name", "content", shortened(F.col("content")).alias("short"), "ord")
        rows = rows.orderBy("is_file", "subject", F.when(F.col("is_file"), F.col("test_name")), "ord")
        for (of_file, subject), own in groupby(rows.toLocalIterator(), key=lambda r: (r["is_file"], r["subject"])):
            if not of_file:
                out += ["📁 Repository Issues:", *(f"  • {r['content']}" for r in own), ""]
                continue
            found = list(own)
            out.append(f"📄 {subject} ({len(found)} issues):")
            for check, some in groupby(found, key=lambda r: r["test_name"]):
                got = list(some)
                if len(got) == 1:
                    out.append(f"  • {got[0]['content']}")
                else:
                    out += [f"  • {check} ({len(got)} occurrences):", *(f"    - {r['short']}" for r in got)]
            out.append("")
    finally:
        messages.unpersist()
    out += ["=== Summary ===", f"Total issues: {numbers['total_issues']}", f"Files with issues: {numbers['files_with_issues']}/{total}", "", "Issue types:"]
    return "\n".join([*out, *(f"  • {k}: {counts[k]}" for k in sorted(counts)), ""])


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Scan report</title>
<style>body{{font:15px/1.5 sans-serif;margin:2em auto;max-width:70em}}table{{border-collapse:collapse;width:100%}}
td,th{{border-bottom:1px solid #ccc;padding:.3em .6em;text-align:left;vertical-align:top}}.n{{display:inline-block;margin-right:2em}}
input{{width:100%;padding:.5em;margin:1em 0}}</style></head>
<body><h1>Scan report</h1><p>{generated}</p><p>{numbers}</p>
<input id="q" placeholder="Filter"><table id="t"><thead><tr><th>Subject</th><th>Check</th><th>Finding</th></tr></thead><tbody></tbody></table>
<script>const data={data};
const body=document.querySelector("#t tbody");
function show(q){{body.replaceChildren();for(const s of data.details_subject_focused)for(const i of s.issues){{
const name=(s.archive_name?s.archive_name+" > ":"")+s.subject,cells=[name,i.checkname,i.message];
if(!cells.join(" ").toLowerCase().includes(q.toLowerCase()))continue;
const tr=document.createElement("tr");for(const c of cells){{const td=document.createElement("td");td.textContent=c;tr.append(td)}}body.append(tr)}}}}
document.querySelector("#q").addEventListener("input",e=>show(e.target.value));show("");</script></body></html>
"""


def as_html(report_json: str, path: str | Path) -> None:
    """A page that holds the report and filters it by what is typed; folders on the way are made. Text that is no JSON raises."""
    data = json.loads(report_json)
    issues = sum(len(s["issues"]) for s in data.get("details_subject_focused") or ())
    counts = {"Scanned": len(data.get("scanned") or ()), "Issues": issues, **{k.title(): len(data.get(k) or ()) for k in ("skipped", "warnings", "errors")}}
    numbers = "".join(f'<span class="n">{html.escape(k)}: {v}</span>' for k, v in counts.items())
    safe = json.dumps(data, ensure_ascii=False).replace("</", "<\\/").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(_PAGE.format(generated=datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), numbers=numbers, data=safe), encoding="utf-8")


def _plural(n: int, what: str) -> str:
    return f"{n} {what}" + "s" * (n != 1)


def as_summary(result: ScanResult, location: str = "") -> str:
    """Findings by check, long groups cut, as a letter to who delivered the package."""
    messages = result.messages.cache()
    try:
        lines = report.summary_lines(messages).withColumn("title", title(F.col("checkname"))).orderBy("checkname", "place").collect()
        counts = {r["checkname"]: r["issue_count"] for r in report.check_counts(messages).collect()}
        number = report.summary_totals(messages).first()
    finally:
        messages.unpersist()
    out = ["We looked through your data package and found what is listed below. Please mend it and tell us, or ask us where something is unclear.", ""]
    out += ["=== Scan Summary ===", *([f"Location: {location}"] if location else []), f"Timestamp: {now()}", ""]
    if not lines:
        return "\n".join([*out, "No issues found.", ""])
    out += ["## Issues by Type", ""]
    last = None
    for r in lines:
        if r["checkname"] != last:
            out += [""] * (last is not None) + [f"### {r['title']} ({_plural(counts[r['checkname']], 'issue')})"]
            last = r["checkname"]
        out.append(r["line"])
    return "\n".join([*out, "", "---", f"Total: {_plural(number['total_issues'], 'issue')} in {_plural(number['subjects'], 'file')}", ""])


def pdf_list(result: ScanResult, header: str) -> str:
    """The PDF files under a header."""
    found = [r["entry"] for r in result.pdf_files.orderBy("entry").collect()]
    return "\n".join([header, *(found or ["No files found."]), ""])


def error_envelope(kind: str, message: str) -> str:
    return json.dumps({"timestamp": now(), "error": {"type": kind, "message": message}}, indent=2, ensure_ascii=False)
