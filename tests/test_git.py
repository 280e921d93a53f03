"""Rules and commands that ask git, the run's own messages, and commands over several roots."""

import json
import os
import subprocess

import pytest

from docweave import cli
from docweave.plans import lint as plan, packs, report
from docweave.sources import config as cfg
from docweave.sources.git import Git

CONFIG = """
[ADR]
summary = "a decision"
owner = "dev"
paths = ["adrs/**"]
rules = ["core.commit-freshness", "core.link-resolved"]
[ADR."core.commit-freshness"]
require-pin = true
[LIST]
summary = "a list"
owner = "dev"
paths = ["lists/**"]
rules = ["checklist.pinned", "checklist.complete"]
[AGENTS]
summary = "instructions"
owner = "dev"
paths = ["AGENTS.md"]
rules = ["agents.context-cache"]
"""


def git(root, *args, at=None):
    env = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b.c", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b.c"}
    if at:
        env |= {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def commit(root, at, message="m"):
    git(root, "add", "-A")
    git(root, "commit", "-qm", message, at=at)
    return git(root, "rev-parse", "HEAD")


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def pinned(n, sha, scope, status="done"):
    return f"---\nid: ADR-{n}\ntitle: T{n}\nstatus: {status}\npin:\n  commit: {sha}\n  scope: [{scope}]\n---\n# T\n"


@pytest.fixture()
def repo(tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    put(tmp_path, cfg.CONFIG_NAME, CONFIG)
    put(tmp_path, "src/a.py", "1")
    put(tmp_path, "src/b/c.py", "1")
    put(tmp_path, "AGENTS.md", "# A\n")
    first = commit(tmp_path, "2024-01-01T00:00:00Z")
    put(tmp_path, "src/a.py", "2")
    put(tmp_path, "AGENTS.md", "# B\n")
    second = commit(tmp_path, "2024-01-01T05:00:00Z")
    put(tmp_path, "AGENTS.md", "# C\n")
    third = commit(tmp_path, "2024-03-01T00:00:00Z")
    return tmp_path, first, second, third


def found(spark, root, code):
    rows = plan.lint(spark, str(root)).found.where(f"code = '{code}'").collect()
    return sorted((r.path, r.note or "", r.severity) for r in rows)


def test_commit_freshness(spark, repo):
    root, first, second, third = repo
    put(root, "adrs/ADR-1.md", pinned(1, first, "src/a.py"))  # changed since
    put(root, "adrs/ADR-2.md", pinned(2, second, "src/**"))  # as it was
    put(root, "adrs/ADR-3.md", pinned(3, "0" * 40, "src/**"))  # no such commit
    put(root, "adrs/ADR-4.md", "---\nid: ADR-4\n---\n")  # no pin
    put(root, "adrs/ADR-5.md", pinned(5, third, "src/b/*"))  # changed in the working tree
    put(root, "src/b/c.py", "9")
    got = found(spark, root, "core.commit-freshness")
    assert [(p, n.split(",")[0], s) for p, n, s in got] == [
        ("adrs/ADR-1.md", "src/a.py and others", "error"), ("adrs/ADR-2.md", "src/b/c.py and others", "error"),
        ("adrs/ADR-3.md", "not an ancestor of HEAD", "error"), ("adrs/ADR-4.md", "", "error"), ("adrs/ADR-5.md", "src/b/c.py and others", "error"),
    ]


def test_without_git_the_pin_is_only_warned_about(spark, tmp_path):
    put(tmp_path, cfg.CONFIG_NAME, CONFIG)
    put(tmp_path, "adrs/ADR-1.md", pinned(1, "abc", "src/**"))
    if Git(str(tmp_path)).available():
        pytest.skip("the folder lies in a repository")
    assert [s for _, _, s in found(spark, tmp_path, "core.commit-freshness")] == ["warning"]


def test_pin_command(spark, repo):
    root, first, _, third = repo
    put(root, "adrs/ADR-1.md", pinned(1, first, "src/a.py"))
    put(root, "src/a.py", "dirty")
    assert cli.main(["--root", str(root), "pin", "ADR-1"], spark) == 1
    git(root, "checkout", "-q", "--", "src/a.py")
    assert cli.main(["--root", str(root), "pin", "ADR-1"], spark) == 0
    assert (root / "adrs/ADR-1.md").read_text() == pinned(1, third, "src/a.py")
    assert found(spark, root, "core.commit-freshness") == []


def test_checklist_pinned_with_history(spark, repo):
    root, first, *_ = repo
    for n, sha in ((1, first), (2, "f" * 40), (3, "main")):
        put(root, f"lists/{n}.md", f"---\ntitle: T\nstatus: sealed\npinned_commit: {sha}\n---\n- [x] done\n")
    assert found(spark, root, "checklist.pinned") == [("lists/2.md", "does not resolve", "error"), ("lists/3.md", "no commit", "error")]


def test_context_cache(spark, repo):
    root, *_ = repo
    rows = plan.lint(spark, str(root)).found.where("code = 'agents.context-cache'").collect()
    assert [(r.path, r.message) for r in rows] == [("AGENTS.md", "1 commits in quick succession")]


def test_changelog(spark, repo, capsys):
    root, *_ = repo
    put(root, "adrs/ADR-1.md", pinned(1, "x", "a", "open"))
    put(root, "adrs/ADR-2.md", pinned(2, "x", "a"))
    commit(root, "2024-04-01T00:00:00Z")
    git(root, "tag", "v1", at="2024-04-01T00:00:00Z")
    put(root, "adrs/ADR-1.md", pinned(1, "x", "a"))
    put(root, "adrs/ADR-2.md", pinned(2, "x", "a").replace("title: T2", "title: T2\nchangelog: a line of its own"))
    commit(root, "2024-05-01T00:00:00Z")
    git(root, "tag", "v2", at="2024-05-01T00:00:00Z")
    args = ["--root", str(root), "changelog"]
    assert cli.main([*args, "--check"], spark) == 1
    assert cli.main(args, spark) == 0
    assert (root / "CHANGELOG.md").read_text() == "# Changelog\n\n## v2\n\n- ADR-1: T1\n## v1\n\n- ADR-2: T2\n"
    assert cli.main([*args, "--check"], spark) == 0
    assert cli.main([*args, "--format", "json"], spark) == 0
    assert [r["id"] for r in json.loads(capsys.readouterr().out)] == ["ADR-1", "ADR-2"]


def test_links(spark, tmp_path):
    put(tmp_path, cfg.CONFIG_NAME, CONFIG.replace('"core.commit-freshness", ', "").replace('[ADR."core.commit-freshness"]\nrequire-pin = true\n', ""))
    put(tmp_path, "adrs/x.png", "")
    body = "[a](ADR-2.md#part) [b](gone.md) [c](https://x.y/z.md) [d](#here) [e](/abs.md) ![f](x.png) ![g](lost.png)\n[h](../adrs/./ADR-1.md)\n"
    put(tmp_path, "adrs/ADR-1.md", "---\nid: ADR-1\n---\n" + body)
    put(tmp_path, "adrs/ADR-2.md", "---\nid: ADR-2\n---\n")
    rows = plan.lint(spark, str(tmp_path)).found.where("code = 'core.link-resolved'").collect()
    assert sorted((r.line, r.message.split()[0], r.severity) for r in rows) == [(4, "gone.md", "warning"), (4, "lost.png", "warning")]


def test_missing_configuration(spark, tmp_path, capsys):
    if cfg.find(str(tmp_path)):
        pytest.skip("there is one above")
    assert cli.main(["--root", str(tmp_path), "lint"], spark) == 2
    assert "cfg.missing" in capsys.readouterr().err


def test_recursive(spark, tmp_path, capsys):
    for name, path in (("a", "x/*.md"), ("b", "y/*.md")):
        put(tmp_path, f"{name}/{cfg.CONFIG_NAME}", f'[DOC]\nsummary = "s"\nowner = "o"\npaths = ["{path}"]\nrules = ["core.dep-resolved"]\n')
    put(tmp_path, "a/x/1.md", "---\nid: DOC-1\n---\n")
    put(tmp_path, "b/y/1.md", "---\nid: DOC-1\ndepends_on: [DOC-9]\n---\n")
    assert cli.main(["--root", str(tmp_path), "lint", "-r"], spark) == 1
    out = json.loads(capsys.readouterr().out)
    assert out["recursive"] and [(r["root"], r["exit_code"]) for r in out["roots"]] == [("a", 0), ("b", 1)]
    assert report.recursive({})["exit_code"] == 0


def test_user_override(tmp_path):
    put(tmp_path, cfg.CONFIG_NAME, CONFIG)
    put(tmp_path, "user/ADR.toml", '[ADR]\nsummary = "mine"\npaths = ["z/**"]\n')
    config = cfg.load(str(tmp_path), str(tmp_path / "user"))
    adr = next(n for n in config.namespaces if n.name == "ADR")
    assert (adr.summary, adr.paths, adr.rules) == ("mine", ["z/**"], []) and len(config.namespaces) == 3


def test_messages_of_the_run(spark, tmp_path):
    put(tmp_path, cfg.CONFIG_NAME, """
[DOC]
summary = "s"
owner = "o"
paths = ["docs/*.md"]
rules = ["core.id", "soul.sectionz", "core.min-docs", "core.required-anchors"]
briefing = {statuses = ["open"], findings = ["core.id", "core.nothing"], odd = ["x"]}
[DOC."core.min-docs"]
count = 3
[DOC."core.required-anchors"]
anchors = []
[DATA]
summary = "s"
owner = "o"
paths = ["data/*"]
rules = []
[FED]
summary = "s"
owner = "o"
rules = ["todo.freshness"]
""")
    put(tmp_path, "docs/1.md", "---\nid: DOC-1\n---\n")
    put(tmp_path, "data/a.csv", "1\n")
    codes = {(r.code, r.message) for r in plan.lint(spark, str(tmp_path)).found.collect()}
    assert ("cfg.reserved-param", "DOC: core.min-docs.count") in codes
    assert ("cfg.rule-unknown", "DOC: soul.sectionz") in codes
    assert ("cfg.rule-inert", "DOC: core.required-anchors") in codes and ("cfg.rule-inert", "FED: todo.freshness") in codes
    assert {m for c, m in codes if c == "cfg.briefing-invalid"} == {"DOC.briefing.findings: core.nothing", "DOC.briefing.odd"}
    assert ("cfg.paths-skipped", "the patterns of DATA match no markdown") in codes


def test_unknown_rules_name_a_pack():
    config = cfg.parse('[A]\nrules = ["guide.frontmatter"]\n')
    cfg.validate(config, {}, packs.providers)
    assert config.messages == [("warning", "cfg.rule-unknown", "A: guide.frontmatter, the pack guide has it")]


@pytest.mark.parametrize("name", sorted(packs.BUILT_IN))
def test_every_pack_can_be_added(name):
    text, added, left = packs.add(name, "")
    config = cfg.parse(text)
    assert {n.name for n in config.namespaces} == set(added) and left == []
    from docweave.plans.registry import RULES

    cfg.validate(config, RULES)
    assert [m for m in config.messages if m[1] != "cfg.rule-inert"] == []
    assert json.loads(packs.show(name))["scope"] == "pack-definition"
