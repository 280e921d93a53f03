import json
import stat

from docweave.model import Namespace
from docweave.plans import lint as plan
from docweave.sources import config as cfg, external
from docweave.streaming import relint

LINES = [
    {"id": "GH-1", "body": "---\nstatus: done\n---\n## Why\nSee GH-2 and GH-9", "location": "issues/1", "extra": {"status": "open", "n": 3}},
    {"id": "GH-2", "body": "", "location": "issues/2", "depends_on": ["GH-1", "GH-7"]},
    {"warning": "the cache is old"},
    {"id": "GH-3", "body": "x"},
]


def _source(tmp_path, name, lines, code=0):
    run = tmp_path / "sources" / name / "run"
    run.parent.mkdir(parents=True)
    run.write_text("#!/bin/sh\ncat <<'E'\n" + "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + f"\nE\nexit {code}\n")
    run.chmod(run.stat().st_mode | stat.S_IEXEC)


def test_sources(spark, tmp_path):
    _source(tmp_path, "gh", [*LINES, "no json"])
    _source(tmp_path, "none", [], 3)
    (tmp_path / cfg.CONFIG_NAME).write_text(
        '[GH]\nsummary = "s"\nowner = "o"\nrules = ["core.dep-resolved", "core.cross-ref", "core.required-metadata"]\n'
        '[GH."core.required-metadata"]\nkeys = ["status"]\n[sources.gh]\nexpect_min = 5\n[sources.none]\n'
    )
    (tmp_path / "README.md").write_text("x")
    run = plan.lint(spark, str(tmp_path))
    got = sorted((r.code, r.path) for r in run.found.collect())
    assert got == [
        ("core.cross-ref", "issues/1"), ("core.dep-resolved", "issues/2"), ("core.required-metadata", "issues/2"), ("src.envelope", "gh"), ("src.envelope", "gh"),
        ("src.runtime-error", "none"), ("src.too-few-documents", "gh"), ("src.too-few-documents", "none"), ("src.warning", "gh"),
    ]
    doc = run.corpus.docs.where("id = 'GH-1'").first()
    assert doc.status == "done" and doc.metadata["n"] == "3"  # frontmatter wins over extra


def test_external_rule_fails_and_times_out(spark, tmp_path):
    _source(tmp_path, "gh", LINES)
    corpus, _ = external.source_corpus(spark, cfg.Config(sources={"gh": {}}, namespaces=[Namespace("GH")]), str(tmp_path))
    corpus.root = str(tmp_path)
    for body, said in (("exit 4", "exit status 4"), ("sleep 5", "no answer"), ('echo \'{"path": "?", "message": "m"}\'', "unknown path"), ("cat >/dev/null", None)):
        rule = tmp_path / "rule"
        rule.write_text(f"#!/bin/sh\n{body}\n")
        rule.chmod(0o755)
        rows = external.run_rule(corpus, "GH", "gh.x", str(rule), {"timeout_sec": 1}).collect()
        assert ([r.code for r in rows] == ["ext.runtime-error"] and said in rows[0].message) if said else rows == []


def test_streaming_relint(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(x) for x in LINES))
    ns = [Namespace("GH", rules=["core.dep-resolved", "core.cross-ref"])]
    run = lambda known=None: relint.relint(spark, str(folder), ns, known, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.code for r in first.collect()) == ["core.cross-ref", "core.dep-resolved", "src.envelope", "src.warning"]
    (folder / "b.json").write_text(json.dumps({"id": "GH-4", "body": "see GH-1 and GH-8", "location": "issues/4"}))
    from docweave.sources.relational import shaped
    from docweave.model import DOCS

    run(shaped(spark.createDataFrame([("issues/1", "GH-1", "GH", 1)], "doc_key string, id string, ns string, number long"), DOCS))
    rows = spark.read.parquet(str(tmp_path / "out")).where("batch = 1").collect()
    assert [(r.code, r.path) for r in rows] == [("core.cross-ref", "issues/4")]


def test_issue_cache(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({"number": 7, "title": "t", "state": "OPEN", "body": None, "fetched_at": "2026-01-01T00:00:00Z", "labels": []}))
    docs, stale = external.cached_issues(spark, str(path), "2026-01-03T00:00:00Z")
    env = external.envelopes(docs.unionByName(stale)).collect()
    assert [(r.id, r.problem, r.warning) for r in env] == [("GH-7", None, None), (None, None, "the cache is 48 hours old")]
