"""Sinks: text, JSON, exit status, and files that commands write."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Corpus, Namespace


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line", "col", "code", "message")


def summary(found: DataFrame, undeclared: int = 0) -> dict:
    """Totals by severity, kernel messages included, and the number of files with a finding."""
    r = found.agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"), F.count_distinct("path").alias("files"),
    ).first()
    return r.asDict() | {"namespaces_undeclared": undeclared}


def exit_status(totals: dict) -> int:
    return int(totals["errors"] > 0)


def text_report(found: DataFrame, n_docs: int, n_rules: int) -> str:
    lines = []
    for d in ordered(found).collect():
        note = f" ({d.note})" if d.note else ""
        lines.append(f"{d.path}:{d.line}:{d.col}: {d.severity} {d.code}: {d.message}{note}")
    totals = summary(found)
    bad = totals["errors"] + totals["warnings"]
    counts = f"{totals['errors']} errors, {totals['warnings']} warnings in {n_docs} documents under {n_rules} rules"
    return "\n".join([*lines, ("found: " if bad else "ok: ") + counts])


def json_report(found: DataFrame, undeclared: int = 0) -> str:
    rows = [{k: v for k, v in d.asDict().items() if v is not None} for d in ordered(found).collect()]
    return canonical({"summary": summary(found, undeclared), "diagnostics": rows})


def canonical(value) -> str:
    """JSON with sorted keys: the same bytes for the same value."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2)


def recursive(runs: dict[str, dict]) -> dict:
    """Summaries of several roots; the worst status wins."""
    roots = [{"root": r, **v, "exit_code": exit_status(v)} for r, v in sorted(runs.items())]
    return {"recursive": True, "exit_code": max((r["exit_code"] for r in roots), default=0), "roots": roots}


def refs_text(rows: DataFrame) -> str:
    label = lambda r: r["kind"] + (f" from {r['from']}" if r["from"] else "")
    return "\n".join(f"{r['file']}:{r['line']}:{r['col']}: ({label(r)})" for r in rows.collect())


def refs_json(rows: DataFrame) -> str:
    return canonical([{k: v for k, v in r.asDict().items() if v is not None} for r in rows.collect()])


def table(rows: DataFrame, form: str = "text") -> str:
    data = rows.collect()
    if form == "json":
        return canonical([r.asDict() for r in data])
    cell = lambda v: "" if v is None else str(v)
    if form == "markdown":
        return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in data)])
    return "\n".join("  ".join(map(cell, r)).rstrip() for r in data)


def scaffold(c: Corpus, n: Namespace, title: str, number: int | None = None) -> tuple[str, str]:
    """(path, content) of a new document: the next number, the slug, every required key and section."""
    if number is None:
        last = c.of(n.name).agg(F.max("number")).first()[0]
        number = (last or 0) + 1
    ident = f"{n.name}-{number:03d}"
    lines = ["---", f"id: {ident}", f"title: {title}"]
    for key in n.params.get("core.required-metadata", {}).get("keys", []):
        if key not in ("id", "title"):
            allowed = n.params.get("core.allowed-values", {}).get(key)
            lines.append(f"{key}: {allowed[0] if allowed else 'TODO'}")
    lines += ["---", "", f"# {title}", ""]
    for heading in n.params.get("core.required-headings", {}).get("headings", []):
        lines += [f"## {heading}", ""]
    folder = (n.paths[0].split("*")[0].rstrip("/") if n.paths else "docs") or "."
    return f"{folder}/{ident}-{tx.slugify(title)}.md", "\n".join(lines)


def changelog_text(rows: DataFrame) -> str:
    out, tag = ["# Changelog", ""], None
    for r in rows.collect():
        if r.tag != tag:
            tag = r.tag
            out += [f"## {tag}", ""]
        out.append(f"- {r.id}: {r.text}")
    return "\n".join([*out, ""])


def write(path: str, content: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def bless(text: str, commit: str) -> str:
    """A document with its pin.commit set anew, all else as it was."""
    lines, inside = text.split("\n"), False
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            break
        if not line.startswith((" ", "\t")):
            inside = line.startswith("pin:")
        elif inside and line.strip().startswith("commit:"):
            lines[i] = line[: line.index("commit:")] + f"commit: {commit}"
            return "\n".join(lines)
    raise ValueError("no pin.commit")
