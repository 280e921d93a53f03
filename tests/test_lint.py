"""The rebuilt example tree: eight findings, six pointers; and what changes around it."""

import json
import os
import stat

import pytest

from docweave import cli
from docweave.operators import navigation as nav
from docweave.plans import lint as plan, report
from docweave.sources import config as cfg

CONFIG = """
[ADR]
summary = "a decision"
owner = "dev"
paths = ["adrs/**"]
rules = ["core.frontmatter", "core.id", "core.id-unique", "core.dep-resolved", "core.dep-cycle", "core.cross-ref",
         "core.required-headings", "core.allowed-values", "adr.consequences-non-empty"]
[ADR."core.required-headings"]
headings = ["Status", "Context", "Decision", "Consequences"]
[ADR."core.allowed-values"]
status = ["draft", "accepted", "superseded"]
[PRD]
summary = "a requirement"
owner = "dev"
paths = ["prds/**"]
rules = ["core.frontmatter", "core.id", "core.dep-resolved", "core.cross-ref"]
[PMR]
summary = "an incident"
owner = "dev"
paths = ["pmrs/**"]
rules = ["core.frontmatter", "core.id", "core.dep-resolved", "core.cross-ref"]
[references]
scan = ["refs/**"]
"""

GOOD = """---
id: ADR-001
title: Use event sourcing
status: accepted
---

## 1. Status
## Context
# ADR-001: event sourcing
## Decision
## CONSEQUENCES:
more
"""

BROKEN = """---
id: ADR-099
title: Broken
status: wishful
depends_on: [PRD-999]
---

# Broken

## Status

Open.

## Context

Context.

See ADR-042, and ADR-042 once more.
`ADR-500` and ~~ADR-501~~ do not count.



## Consequences


"""

RULE = """#!/usr/bin/env python3
import json, sys
for line in sys.stdin:
    d = json.loads(line)
    text = open(d["path"]).read()
    if not text.partition("## Consequences")[2].strip() and "## Consequences" in text:
        at = text[: text.index("## Consequences")].count("\\n") + 1
        print(json.dumps({"path": d["path"], "severity": "error", "message": "Consequences is empty", "line": at, "col": 0}))
"""


@pytest.fixture()
def tree(tmp_path):
    files = {
        cfg.CONFIG_NAME: CONFIG,
        "adrs/ADR-001-use-event-sourcing.md": GOOD,
        "adrs/ADR-099-broken-demo.md": BROKEN,
        "prds/PRD-001.md": "---\nid: PRD-001\nstatus: done\n---\n",
        "pmrs/PMR-001.md": "---\nid: PMR-001\ntitle: Lost\nstatus: open\nextra: x\ndepends_on: [ADR-1]\n---\n" + "\n" * 40 + " " * 26 + "ADR-001 was it\n",
        "refs/Cargo.toml": "\n" * 11 + " " * 14 + "ADR-7777\n",
        "refs/lib.rs": "\n" * 6 + " " * 45 + "ADR-001\n\n\n" + " " * 37 + "ADR-8888\n// docweave: ignore-next\nADR-6666\nADR-5555 // docweave: ignore-line\nHTTP-2\n",
        "refs/main.go": "\n" * 9 + " " * 21 + "ADR-9999\n\n" + " " * 31 + "ADR-001\n",
        "README.md": "no document\n",
        "node_modules/x/adrs/ADR-7.md": "---\nid: ADR-7\n---\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    run = tmp_path / "rules/adr/consequences-non-empty/run"
    run.parent.mkdir(parents=True)
    run.write_text(RULE)
    run.chmod(run.stat().st_mode | stat.S_IEXEC)
    return tmp_path


def _found(spark, root):
    return [(r.code, r.path, r.line, r.col) for r in report.ordered(plan.lint(spark, str(root)).found).collect()]


EXPECTED = [
    ("core.required-headings", "adrs/ADR-099-broken-demo.md", 0, 0),
    ("core.allowed-values", "adrs/ADR-099-broken-demo.md", 4, 0),
    ("core.dep-resolved", "adrs/ADR-099-broken-demo.md", 5, 0),
    ("core.cross-ref", "adrs/ADR-099-broken-demo.md", 18, 5),
    ("adr.consequences-non-empty", "adrs/ADR-099-broken-demo.md", 23, 0),
    ("core.cross-ref", "refs/Cargo.toml", 12, 15),
    ("core.cross-ref", "refs/lib.rs", 10, 38),
    ("core.cross-ref", "refs/main.go", 10, 22),
]


def test_golden_lint(spark, tree):
    run = plan.lint(spark, str(tree))
    assert _found(spark, tree) == EXPECTED
    note = run.found.where("line = 18").first().note
    assert note == "2 mentions"
    totals = report.summary(run.found)
    assert (totals["errors"], totals["warnings"]) == (8, 0) and report.exit_status(totals) == 1
    assert "found: 8 errors" in report.text_report(run.found, 4, 9)
    assert json.loads(report.json_report(run.found))["summary"]["errors"] == 8


def test_golden_refs(spark, tree):
    _, corpus, _ = plan.load(spark, str(tree))
    got = [(r.file, r.line, r.col, r.kind) for r in nav.refs(corpus, "ADR", 1).collect()]
    assert got == [
        ("adrs/ADR-001-use-event-sourcing.md", 0, 0, "self"),
        ("adrs/ADR-001-use-event-sourcing.md", 9, 3, "body"),
        ("pmrs/PMR-001.md", 6, 0, "depends_on"),
        ("pmrs/PMR-001.md", 48, 27, "body"),
        ("refs/lib.rs", 7, 46, "scanner"),
        ("refs/main.go", 12, 32, "scanner"),
    ]


def test_deleting_a_target_adds_its_pointers(spark, tree):
    os.remove(tree / "adrs/ADR-001-use-event-sourcing.md")
    new = set(_found(spark, tree)) - set(EXPECTED)
    assert new == {("core.dep-resolved", "pmrs/PMR-001.md", 6, 0), ("core.cross-ref", "pmrs/PMR-001.md", 48, 27), ("core.cross-ref", "refs/lib.rs", 7, 46), ("core.cross-ref", "refs/main.go", 12, 32)}


def test_padding_changes_nothing(spark, tree):
    path = tree / "adrs/ADR-001-use-event-sourcing.md"
    path.write_text(path.read_text().replace("id: ADR-001", "id: ADR-00001"))
    assert _found(spark, tree) == EXPECTED


def test_status_and_lineage(spark, tree):
    _, corpus, _ = plan.load(spark, str(tree))
    states = {r.id: r.state for r in nav.status(corpus, ["accepted", "done"]).collect()}
    assert states == {"ADR-001": "settled", "ADR-099": "ready", "PRD-001": "settled", "PMR-001": "ready"}
    roots = nav.definition(corpus, "ADR", 1).selectExpr("location AS node")
    assert {(r.node, r.depth) for r in nav.lineage(corpus, roots).collect()} == {("adrs/ADR-001-use-event-sourcing.md", 0), ("pmrs/PMR-001.md", 1)}


def test_commands(spark, tree, capsys):
    root = ["--root", str(tree)]
    assert cli.main([*root, "lint"], spark) == 1
    assert cli.main([*root, "refs", "ADR-1"], spark) == 0
    assert "(depends_on from PMR-001)" in capsys.readouterr().out
    assert cli.main([*root, "list", "--format", "markdown"], spark) == 0
    assert cli.main([*root, "rules", "--namespace", "ADR"], spark) == 0
    assert cli.main([*root, "namespaces", "--for", "adrs/x.md"], spark) == 0
    assert capsys.readouterr().out.strip().split("\n")[-1].startswith("ADR")
    assert cli.main([*root, "new", "ADR", "Use More Tests!", "--stdout"], spark) == 0
    assert "id: ADR-100" in capsys.readouterr().out
    assert cli.main([*root, "status", "--exit-code"], spark) == 1
    assert cli.main([*root, "refs", "nothing"], spark) == 2
    assert cli.main([*root, "pack", "add", "guide"], spark) == 0
    assert cli.main([*root, "pack", "outdated"], spark) == 0
    assert "GUIDE  current" in capsys.readouterr().out
    assert cli.main(["--root", str(tree / "nowhere"), "lint"], spark) == 2


def test_kernel_checks(spark, tree):
    config = tree / cfg.CONFIG_NAME
    config.write_text(CONFIG.replace('summary = "a requirement"\n', "").replace('[PRD]\n', '[PRD]\nodd = 1\n').replace('"prds/**"', '"prds/**", "adrs/**", "/abs"').replace('owner = "dev"\npaths = ["pmrs', 'paths = ["pmrs'))
    (tree / "adrs/none.md").write_text("no id\n")
    (tree / "x.md").write_text("---\nid: NEW-3\n---\n")
    (tree / "prds/bad.md").write_bytes(b"\xff\xfe\xff")
    codes = {c for c, *_ in _found(spark, tree)} - {c for c, *_ in EXPECTED}
    assert codes == {"cfg.namespace-undescribed", "cfg.key-unknown", "cfg.paths-invalid", "cfg.path-conflict", "cfg.namespace-unowned", "cfg.namespace-undeclared", "src.markdown-read"}
    config.write_text(CONFIG.replace('[ADR."core.allowed-values"]\nstatus = ["draft", "accepted", "superseded"]\n', ""))
    with pytest.raises(cfg.ConfigError):
        plan.lint(spark, str(tree))
