"""Core and pack rules on one small corpus: every rule must fire where it should and nowhere else."""

import pytest

from docweave.model import Namespace
from docweave.plans import packs
from docweave.plans.lint import check
from docweave.plans.registry import RULES
from docweave.sources import markdown
from docweave.sources.config import Config

H = "a" * 40

FILES = {
    "prd/1.md": "---\nid: PRD-1\nstatus: accepted\nreviewed_date: 2026-01-01\nsupersedes: [PRD-2, PRD-3]\n---\n## Requirements\n- EARS-1: The system shall stop\n- EARS-2: When late the system shall beep\n- EARS-3: It beeps\n### REQ-1 x\nStatus: covered\n### REQ-2 y\n",
    "prd/2.md": "---\nid: PRD-2\nstatus: superseded\n---\n## Satisfies\n- REQ-1 and REQ-9\n",
    "prd/3.md": "---\nid: PRD-3\nstatus: superseded\nsuperseded_by: PRD-1\n---\n## Acceptance\n- [ ] a\n- [x] b\n",
    "spec/1.md": "---\nid: SPEC-1\nstatus: open\n---\nthe usual buzzword salad\n",
    "spec/2-x.md": "---\nid: SPEC-3\nstatus: open\ndepends_on: [PRD-1]\nagents: [coder, codr]\n---\n## Files allowed\n- `prd/1.md`\n- `prd/none.md`\n- prd/\n- `*.rs`\n",
    "TODO.md": "Last updated: 2026-01-01\n## Next\n### TODO\n- [ ] SPEC-1\n## Now\n## Now\n",
    "AGENTS.md": "# A\n## Current State\n@TODO.md\n@lost.md\nmany words here\n",
    "agents/coder.md": "---\nname: coder\ndescription: short\nmodel: big\n---\n",
    "agents/x.md": "---\nname: y\n---\n",
    "skills/SKILL.md": "---\nname: s\ndescription: ''\n---\n",
    "guides/a.md": "---\ntitle: A\ndiataxis:\n  type: tutorial\n---\n",
    "guides/b.md": "---\ntitle: ' '\ndiataxis:\n  type: essay\n---\n",
    "c4/a.md": "---\ntitle: A\nc4: {level: galaxy}\n---\n",
    "lists/a.md": f"---\nstatus: sealed\npinned_commit: {H}\n---\n- [ ] left\n",
    "lists/b.md": "---\nstatus: sealed\npinned_commit: abc\n---\n- [x] done\n",
    "lists/c.md": "---\nstatus: living\n---\n- [ ] left\n",
    "ddd/1.md": "---\nid: BOUNDEDCONTEXT-1\n---\n",
    "ddd/2.md": "---\nid: BOUNDEDCONTEXT-2\n---\n",
    "maps/1.md": "---\nid: CONTEXTMAP-1\ndepends_on: [BOUNDEDCONTEXT-1, BOUNDEDCONTEXT-2]\npattern: Conformist\nupstream: a\n---\n",
    "maps/2.md": "---\nid: CONTEXTMAP-2\ndepends_on: [BOUNDEDCONTEXT-1, BOUNDEDCONTEXT-9]\npattern: Partnership\nupstream: a\n---\n",
    "vuln/1.md": "---\nid: VULN-1\nstatus: open\nseverity: critical\ndiscovered: 2026-01-01\n---\n",
    "vuln/2.md": "---\nid: VULN-2\nstatus: mitigated\nseverity: high\n---\nSee VULN-2\n",
    "vuln/3.md": "---\nid: VULN-3\nstatus: mitigated\n---\nSee PRD-1\n",
    "risk/1.md": "---\nid: RISK-1\nstatus: accepted\napprover: me\nexpires: 2026-01-15\n---\n",
    "soc/1.md": "---\nid: SOC-1\nstatus: met\nevidence: a link\n---\n",
    "soc/2.md": "---\nid: SOC-2\nstatus: met\n---\n",
    "soc/3.md": "---\nid: SOC-3\nstatus: not-applicable\n---\n",
    "design/a.md": "---\ncolor:\n  base:\n    red: '#f00'\n---\n## Two\n## One\n## One\n{color.base.red} {color.base.blue} {color.base}\n",
    "soul/SOUL.md": "## Voice\n### Values\n",
    "loop/1.md": "---\nid: LOOP-1\nstatus: done\ndepends_on: [LOOP-2]\n---\n",
    "loop/2.md": "---\nid: LOOP-2\nstatus: open\ndepends_on: [LOOP-1]\n---\n",
}

DAY = {"as_of": "2026-02-10"}

BOUND = {
    "PRD": ("prd/**", {
        "core.calendar-freshness": DAY, "core.successor-link": {}, "core.supersedes-reciprocal": {}, "core.acceptance-complete": {"terminal": ["superseded"]},
        "core.requirement-ref": {}, "core.requirement-status": {"statuses": ["covered"]}, "ears.clause-syntax": {}, "core.required-anchors": {"anchors": ["##"]},
        "core.file-budget": {"max_chars": 100}, "core.metadata-format": {"reviewed_date": "datetime"},
    }),
    "SPEC": ("spec/**", {"spec.requires-prd": {}, "core.dep-shape": {"requires-any": ["PRD", "ADR"]}, "core.file-name": {}, "tasks.files-allowed": {}, "todo.listed": {"terminal": ["done"]},
                         "agent.assigned": {"builtin_agents": ["tester"]}, "writing.banned-prose": {"terms": ["buzzword", "sala"]}}),
    "TODO": ("TODO.md", {"todo.freshness": {**DAY, "stale_days": 60}, "todo.structure": {}, "todo.sections": {}}),
    "AGENTS": ("AGENTS.md", {"agents.context-headings": {}, "agents.context-budget": {"max_words": 5}}),
    "AGENT": ("agents/**", {"agent.frontmatter": {"models": ["small"]}}),
    "SKILLS": ("skills/**", {"skills.frontmatter": {}}),
    "GUIDE": ("guides/**", {"guide.frontmatter": {"types": ["tutorial"]}, "core.requires-link": {"targets": ["TODO.md", "gone.md"]}}),
    "C4": ("c4/**", {"c4.frontmatter": {"levels": ["context"]}}),
    "CHECKLIST": ("lists/**", {"checklist.complete": {}, "checklist.pinned": {}}),
    "BOUNDEDCONTEXT": ("ddd/**", {}),
    "CONTEXTMAP": ("maps/**", {"ddd.context-map-shape": {}}),
    "VULN": ("vuln/**", {"security.vuln-sla": DAY, "security.remediation-link": {}}),
    "RISK": ("risk/**", {"security.risk-expiry": DAY}),
    "SOC": ("soc/**", {"soc2.control-evidence": {}}),
    "DESIGN": ("design/**", {"design.section-order": {"sections": ["One", "Two"]}, "design.token-ref": {}}),
    "SOUL": ("soul/**", {"soul.sections": {"sections": ["Voice", "Values"]}, "style.soul-pair": {"sibling": "STYLE.md"}, "soul.referenced": {"target": "TODO.md"}}),
    "LOOP": ("loop/**", {"core.dep-cycle": {}, "core.dep-status": {"terminal": ["done"]}}),
    "NONE": ("none/**", {"core.min-docs": {}}),
}

EXPECTED = {
    ("core.calendar-freshness", "prd/1.md"), ("core.successor-link", "prd/2.md"), ("core.supersedes-reciprocal", "prd/1.md"), ("core.acceptance-complete", "prd/3.md"),
    ("core.requirement-ref", "prd/2.md"), ("core.requirement-status", "prd/1.md"), ("ears.clause-syntax", "prd/1.md"), ("core.file-budget", "prd/1.md"), ("core.metadata-format", "prd/1.md"),
    ("spec.requires-prd", "spec/1.md"), ("core.dep-shape", "spec/1.md"), ("core.file-name", "spec/2-x.md"), ("tasks.files-allowed", "spec/2-x.md"), ("todo.listed", "spec/2-x.md"),
    ("agent.assigned", "spec/2-x.md"), ("writing.banned-prose", "spec/1.md"), ("todo.structure", "TODO.md"), ("todo.sections", "TODO.md"),
    ("agents.context-headings", "AGENTS.md"), ("agents.context-budget", "AGENTS.md"), ("agent.frontmatter", "agents/coder.md"), ("agent.frontmatter", "agents/x.md"),
    ("skills.frontmatter", "skills/SKILL.md"), ("guide.frontmatter", "guides/b.md"), ("core.requires-link", "guides/a.md"), ("core.requires-link", "guides/b.md"), ("c4.frontmatter", "c4/a.md"),
    ("checklist.complete", "lists/a.md"), ("checklist.pinned", "lists/a.md"), ("checklist.pinned", "lists/b.md"), ("ddd.context-map-shape", "maps/1.md"), ("ddd.context-map-shape", "maps/2.md"),
    ("security.vuln-sla", "vuln/1.md"), ("security.remediation-link", "vuln/2.md"), ("security.risk-expiry", "risk/1.md"), ("soc2.control-evidence", "soc/2.md"),
    ("design.section-order", "design/a.md"), ("design.token-ref", "design/a.md"), ("soul.sections", "soul/SOUL.md"), ("style.soul-pair", "soul/SOUL.md"), ("soul.referenced", "soul/SOUL.md"),
    ("core.dep-cycle", "loop/1.md"), ("core.dep-cycle", "loop/2.md"), ("core.dep-status", "loop/1.md"), ("core.min-docs", "config"),
}

SUBJECTS = {
    "ears.clause-syntax": {"EARS-3"}, "core.requirement-ref": {"REQ-9"}, "core.requirement-status": {"REQ-2"}, "agent.assigned": {"codr"}, "tasks.files-allowed": {"prd/none.md"},
    "writing.banned-prose": {"buzzword"}, "design.token-ref": {"color.base.blue"}, "todo.listed": {"SPEC-3"}, "core.supersedes-reciprocal": {"PRD-2"},
}


@pytest.fixture(scope="module")
def found(spark):
    namespaces = [Namespace(ns, [path], list(rules), params=dict(rules)) for ns, (path, rules) in BOUND.items()]
    config = Config(namespaces=namespaces)
    rows = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "location string, content binary").coalesce(1)
    files = spark.createDataFrame([(p,) for p in FILES], "path string")
    corpus = markdown.build(spark, markdown.parse_files(rows), config, "file", files)
    for name in list(corpus.tables):
        corpus.tables[name] = corpus.tables[name].persist()
    out = []
    for n in namespaces:  # one plan for each namespace keeps the plans small
        out += check(corpus, [n]).collect()
    return out


def test_every_rule_fires_where_it_should(found):
    assert {(r.code, r.path) for r in found} == EXPECTED


def test_subjects(found):
    for code, subjects in SUBJECTS.items():
        message = RULES[code].message
        assert {r.message for r in found if r.code == code} == {message.replace("{}", s) for s in subjects}, code


def test_suggestion_and_order(found):
    assert [r.note for r in found if r.code == "agent.assigned"] == ["nearest: coder"]
    assert sorted(r.note for r in found if r.code == "design.section-order") == ["out of order", "repeated"]
    assert {r.severity for r in found if r.code == "checklist.pinned" and r.path == "lists/a.md"} == {"warning"}


def test_packs_round_trip(spark, tmp_path):
    text, added, _ = packs.add("guide", "[MINE]\nrules = []\n", str(tmp_path))
    assert added == ["GUIDE"] and text.startswith("[MINE]")
    assert packs.add("guide", text, str(tmp_path))[1:] == ([], ["GUIDE"])
    assert {r.ns: r.state for r in packs.outdated(spark, text, str(tmp_path)).collect()} == {"GUIDE": "current"}
    local = tmp_path / "packs/guide/pack.toml"
    local.parent.mkdir(parents=True)
    local.write_text('[GUIDE]\nsummary = "other"\nrules = []\n')
    assert packs.discover(str(tmp_path))["guide"][0] == "repo"
    assert {r.ns: r.state for r in packs.outdated(spark, text, str(tmp_path)).collect()} == {"GUIDE": "drift"}
    new, replaced = packs.migrate(text, str(tmp_path))
    assert replaced == ["GUIDE"] and 'summary = "other"' in new
    edited = text.replace("documentation for users", "mine")
    assert packs.migrate(edited, str(tmp_path)) == (edited, [])
