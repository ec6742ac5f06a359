"""Reports, exit codes and the review state's file.

Reports are of one repository and are put together on the driver from rows that are already ordered and cut.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import drift, session, triage
from driftloom.plans.check import Session

SCHEMA_VERSION = 4


def to_dict(found: Session, head: dict) -> dict:
    """The session as one document; head: project, branch, baseline and the like."""
    totals = [r.asDict() for r in found.totals.collect()]
    flags = [r.asDict(recursive=True) for r in found.flags.orderBy(*session.flag_order()).collect()]
    files = [r.asDict(recursive=True) for r in found.files.orderBy(*session.file_order()).collect()]
    others = [r["path"] for r in found.other_files.orderBy("path").collect()]
    zero = {"risk_count": 0, "file_count": 0, "changed_files": 0, "changed_nodes": 0, "reviewed_nodes": 0, "pending_review": 0, "skipped_files": 0, "exit_code": 0}
    return {"schema_version": SCHEMA_VERSION, "session": head | (totals[0] if totals else zero), "flags": flags, "files": files, "other_files": others}


def json_report(found: Session, head: dict) -> str:
    return json.dumps(to_dict(found, head), indent=2, ensure_ascii=False)


def _count(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def markdown_report(found: Session, head: dict, generated_at: str, cap: int = 80) -> str:
    """Active flags by severity with their changes, dismissed ones, files, and what was not parsed."""
    doc = to_dict(found, head)
    s = doc["session"]
    lines = [f"# Changes in {s.get('project', '')}", ""]
    lines += [f"- {k}: {s[k]}" for k in ("branch", "baseline", "path") if k in s]
    lines += [f"- generated: {generated_at}", f"- {_count(s['changed_files'], 'changed file')}, {_count(s['risk_count'], 'active flag')}", f"- {'reviewed' if s.get('approved') else 'not reviewed'}", ""]
    flagged = found.flags.select(F.col("node_id").alias("__id")).distinct()
    blocks = found.nodes.join(flagged, F.col("node_id") == F.col("__id")).select("node_id", drift.diff_block(F.col("before"), F.col("after"), F.col("state"), cap).alias("block"))
    block_of = {r["node_id"]: r["block"] for r in blocks.collect()}
    active = [f for f in doc["flags"] if not f["dismissed"]]
    lines += ["## Flags", ""] + ([] if active else ["None is active.", ""])
    for level in ("high", "medium", "low"):
        some = [f for f in active if f["severity"] == level]
        lines += [f"### {level.capitalize()}", ""] if some else []
        for f in some:
            lines += [f"#### {f['type']}: `{f['path']}`", "", f"- at {f['node_path']}", f"- {f['desc']}"]
            lines += [f"- line: `{f['evidence']}`"] if f["evidence"] else []
            lines += ["", "```diff", block_of.get(f["node_id"]) or "", "```", ""]
    gone = [f for f in doc["flags"] if f["dismissed"]]
    if gone:
        lines += [f"## Dismissed ({len(gone)})", ""] + [f"- ~~{f['type']}~~ `{f['path']}`, {f['node_path']}" for f in gone] + [""]
    lines += ["## Files", ""] + [f"- `{f['dir']}{f['name']}`: {f['summary']}, {_count(f['risks'], 'active flag')}" for f in doc["files"]] + [""]
    if doc["other_files"]:
        lines += ["## Other files", ""] + [f"- `{p}`" for p in doc["other_files"]] + [""]
    return "\n".join(lines)


def html_report(markdown: str, title: str) -> str:
    """A report as a page of its own: the text as it stands, escaped."""
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><pre>{html.escape(markdown)}</pre></body></html>\n'


def write_results(folder: str, doc: dict, markdown: str, name: str = "latest") -> list[str]:
    """Writes a result as JSON, Markdown and HTML, each put in place whole; returns the paths."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    texts = {"json": json.dumps(doc, indent=2, ensure_ascii=False), "md": markdown, "html": html_report(markdown, name)}
    for kind, text in texts.items():
        part = at / f"{name}.{kind}.part"
        part.write_text(text, encoding="utf-8")
        part.replace(at / f"{name}.{kind}")
    return [str(at / f"{name}.{kind}") for kind in texts]


def load_state(path: str, repo: str) -> tuple[list[tuple[str, str, str, str]], dict]:
    """(rows as triage.SCHEMA, approval and baseline) of a repository from the state file.

    Three forms are read: versioned, a map of repositories without a version, and lists of ids without hashes, which
    dismiss nothing until they are adopted. A file that is missing or broken is an empty state.
    """
    try:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return [], {}
    repos = doc.get("repos", {}) if isinstance(doc, dict) and "version" in doc else doc
    own = repos.get(repo) if isinstance(repos, dict) else None
    if isinstance(own, list):
        own = {"dismissed": own}
    if not isinstance(own, dict):
        return [], {}
    rows = []
    for kind in ("dismissed", "reviewed"):
        marks = own.get(kind) or own.get(f"{kind}Nodes") or {}
        pairs = [(x, "") for x in marks if isinstance(x, str)] if isinstance(marks, list) else [(k, v) for k, v in marks.items() if isinstance(v, str)]
        rows += [(repo, kind, i, h) for i, h in pairs]
    return rows, {k: own[k] for k in ("approvedFingerprint", "approvedAt", "baseline", "trustPoint") if own.get(k)}


def save_state(path: str, repo: str, rows: list[tuple[str, str, str, str]], extra: dict) -> None:
    """Writes a repository's state beside others'. A time of approval alone keeps no entry."""
    try:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        doc = {}
    repos = doc.get("repos", {}) if isinstance(doc, dict) and "version" in doc else {}
    own = {kind: {i: h for r, k, i, h in rows if r == repo and k == kind} for kind in ("dismissed", "reviewed")} | extra
    repos.pop(repo, None)
    if any(v for k, v in own.items() if k != "approvedAt"):
        repos[repo] = {k: v for k, v in own.items() if v}
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_suffix(".part")
    part.write_text(json.dumps({"version": 1, "repos": repos}, indent=2, sort_keys=True), encoding="utf-8")
    part.replace(at)


def state_frame(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, triage.SCHEMA)
