"""Packs: named bundles of namespace sections, built in, per user, or in a repository."""

from __future__ import annotations

import hashlib
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession

from ..operators import navigation
from .report import canonical

_CORE = ["core.frontmatter", "core.id", "core.id-unique", "core.dep-resolved", "core.dep-cycle", "core.cross-ref", "core.link-resolved"]
_PATH = ["core.frontmatter", "core.link-resolved", "core.cross-ref"]


def _ns(summary: str, paths: list[str], rules: list[str], params: dict | None = None, base: list[str] | None = None) -> dict:
    return {"summary": summary, "paths": paths, "rules": [*(_CORE if base is None else base), *rules], **(params or {})}


def _shape(headings: list[str], statuses: list[str] | None = None, keys: list[str] | None = None) -> dict:
    out: dict = {"core.required-headings": {"headings": headings}, "core.required-metadata": {"keys": keys or ["id", "title", "status"]}}
    return out | ({"core.allowed-values": {"status": statuses}} if statuses else {})


_CONTEXT = ["agents.context-headings", "agents.context-budget", "agents.context-cache"]
_PIN = {"core.commit-freshness": {"require-pin": True}}

#: The vocabularies that are documented for each kind of document.
BUILT_IN: dict[str, dict] = {
    "project-docs": {
        "namespaces": {
            "ADR": _ns("a technical decision is made", ["docs/adrs/**"], ["core.required-headings", "core.required-metadata", "core.allowed-values"],
                       _shape(["Status", "Context", "Decision", "Consequences"], ["draft", "accepted", "rejected", "superseded"])),
            "PRD": _ns("a product requirement is written down", ["docs/prds/**"], ["core.required-headings", "core.required-metadata", "ears.clause-syntax"],
                       _shape(["Context", "Goals", "Non-goals", "User stories", "Requirements", "Definition of Done", "Open Questions", "References", "Change log"])),
            "RFC": _ns("a change is proposed for comment", ["docs/rfcs/**"], ["core.required-metadata"], _shape([])),
            "BUG": _ns("something is broken", ["docs/bugs/**"], ["core.required-metadata"], _shape([])),
            "ROADMAP": {**_ns("what comes when", ["docs/roadmap/**"], ["core.required-metadata"], _shape([])), "linked_by": "part_of"},
            "TODO": _ns("the list of what is to be done", ["TODO.md"], ["todo.freshness", "todo.structure"], base=_PATH),
            "README": _ns("the front door of the project", ["README.md"], ["core.min-docs", "core.requires-link"],
                          {"core.requires-link": {"targets": ["docs/guides/getting-started.md"], "severity": "warning"}}, base=_PATH),
        }
    },
    "ops": {
        "namespaces": {
            "RUN": _ns("a procedure for operators", ["docs/runbooks/**"], ["core.required-headings", "core.required-metadata"],
                       _shape(["Trigger", "Prerequisites", "Steps", "Rollback", "Verification"])),
            "PMR": _ns("what an incident taught", ["docs/pmrs/**"], ["core.required-metadata"], {"core.required-metadata": {"keys": ["id", "title", "status", "incident_date"]}}),
        }
    },
    "agents": {"namespaces": {"AGENTS": _ns("instructions that any agent reads", ["AGENTS.md"], _CONTEXT, base=_PATH)}},
    "claude": {"namespaces": {
        "CLAUDE": _ns("instructions for one agent", ["CLAUDE.md"], _CONTEXT, base=_PATH),
        "SKILLS": _ns("a skill for an agent", [".claude/skills/**/SKILL.md"], ["skills.frontmatter"], base=_PATH),
        "SUBAGENT": _ns("an agent that another one calls", [".claude/agents/*.md"], ["agent.frontmatter"], base=_PATH)}},
    "codex": {"namespaces": {"CODEXSKILLS": _ns("a skill for an agent", [".codex/skills/**/SKILL.md"], ["skills.frontmatter"], base=_PATH)}},
    "gemini": {"namespaces": {"GEMINI": _ns("instructions for one agent", ["GEMINI.md"], _CONTEXT, base=_PATH)}},
    "opencode": {"namespaces": {"OPENCODE": _ns("an agent that another one calls", [".opencode/agent/*.md"], ["opencode.frontmatter"], base=_PATH)}},
    "workflow": {
        "base": "handoff",
        "namespaces": {
            "SPEC": _ns("the design of a piece of work", ["docs/specs/**"], ["core.dep-shape", "ears.clause-syntax"], {"core.dep-shape": {"requires": ["PRD"]}}),
            "TASK": _ns("a bounded slice of work", ["docs/tasks/**"], ["tasks.files-allowed"]),
            "PROMPT": _ns("a prompt that is used again", ["docs/prompts/**"], []),
        },
    },
    "handoff": {"namespaces": {"HANDOFF": _ns("a session hands over to the next", ["docs/handoffs/**"], ["core.required-headings", "core.file-budget"],
        {"core.required-headings": {"headings": ["Verification"], "statuses": ["pending", "in_progress"], "code_in": ["Verification"]}, "core.file-budget": {"max_chars": 20000, "severity": "warning"}}, base=_PATH)}},
    "guide": {"namespaces": {"GUIDE": _ns("documentation for users", ["docs/guides/**"], ["guide.frontmatter", "core.min-docs"], {"guide.frontmatter": {"types": ["tutorial", "how-to", "reference", "explanation"]}}, base=_PATH)}},
    "c4": {"namespaces": {"C4": _ns("a view of the architecture", ["docs/diagrams/**"], ["c4.frontmatter", "core.min-docs"], {"c4.frontmatter": {"levels": ["context", "container", "component", "code", "deployment", "dynamic", "landscape"]}}, base=_PATH)}},
    "checklist": {"namespaces": {"CHECKLIST": _ns("a list that is signed off", ["docs/checklists/**"], ["core.allowed-values", "checklist.complete", "checklist.pinned"], {"core.allowed-values": {"status": ["living", "sealed"]}}, base=_PATH)}},
    "ddd": {
        "namespaces": {
            "BOUNDEDCONTEXT": _ns("a boundary of model and language", ["docs/ddd/bounded-contexts/**"], ["core.required-headings", "core.required-metadata", "core.allowed-values"], {
                "core.required-headings": {"headings": ["Purpose", "Ubiquitous Language", "Aggregates", "Domain Events", "Boundaries", "Team / Ownership", "Open Questions", "References"]},
                "core.required-metadata": {"keys": ["status", "subdomain_type"]}, "core.allowed-values": {"status": ["draft", "active", "deprecated"], "subdomain_type": ["core", "supporting", "generic"]}}),
            "CONTEXTMAP": _ns("how two contexts relate", ["docs/ddd/context-maps/**"], ["core.required-metadata", "core.allowed-values", "ddd.context-map-shape"], {
                "core.required-metadata": {"keys": ["pattern"]},
                "core.allowed-values": {"pattern": ["Partnership", "Shared Kernel", "Customer-Supplier", "Conformist", "Anticorruption Layer", "Open Host Service", "Published Language", "Separate Ways"]}}),
        }
    },
    "governance": {"namespaces": {"DEC": _ns("a decision of the program", ["docs/decisions/[0-9]*.md"], ["core.required-headings", "core.required-metadata", "core.allowed-values", "core.successor-link"],
        _shape(["Decision", "Rationale", "Impact", "Approval"], ["proposed", "pending", "approved", "rejected", "deferred", "superseded"], ["id", "title", "status", "decision-maker", "date"]))}},
    "security": {
        "namespaces": {
            "VULN": _ns("a weakness was found", ["docs/security/vulns/**"], ["security.vuln-sla", "security.remediation-link"], {"security.vuln-sla": {"windows": {"critical": 7, "high": 30}}}),
            "RISK": _ns("a risk is accepted", ["docs/security/risks/**"], ["security.risk-expiry"]),
            "THREAT": _ns("what could go wrong with a part of the system", ["docs/security/threats/**"], ["core.commit-freshness"], _PIN),
            "SECREV": _ns("a release or a test of its security is signed off", ["docs/security/reviews/**"], ["core.calendar-freshness"]),
            "DEPAUDIT": _ns("dependencies were audited", ["docs/security/audits/**"], ["core.commit-freshness"], _PIN),
            "POLICY": _ns("a policy is in force", ["docs/security/policies/**"], ["core.calendar-freshness"]),
            "ASSET": _ns("something is worth protecting", ["docs/security/assets/**"], ["core.required-metadata"], {"core.required-metadata": {"keys": ["id", "title"]}}),
        }
    },
    "persona": {"namespaces": {
        "SOUL": _ns("who the persona is", ["SOUL.md"], ["soul.sections"], {"soul.sections": {"sections": ["Worldview", "Opinions", "Boundaries"]}}, base=_PATH),
        "STYLE": _ns("how the persona writes", ["STYLE.md"], ["style.soul-pair"], {"style.soul-pair": {"sibling": "SOUL.md"}}, base=_PATH)}},
    "soc2": {"base": "security", "namespaces": {"CONTROL": _ns("a control and what shows that it works", ["docs/soc2/**"], ["soc2.control-evidence"])}},
}


def text_of(pack: dict) -> str:
    """The TOML of a pack."""
    value = lambda v: "[" + ", ".join(map(value, v)) + "]" if isinstance(v, list) else str(v).lower() if isinstance(v, int) else '"' + str(v) + '"'
    out = []
    for name, section in pack["namespaces"].items():
        plain = {k: v for k, v in section.items() if not isinstance(v, dict)}
        out += [f"[{name}]", *(f"{k} = {value(v)}" for k, v in plain.items()), ""]
        for code, params in section.items():
            if isinstance(params, dict):
                flat = {k: v for k, v in params.items() if not isinstance(v, dict)}
                out += [f'[{name}."{code}"]', *(f'"{k}" = {value(v)}' for k, v in flat.items()), ""]
                for k, v in params.items():
                    if isinstance(v, dict):
                        out += [f'[{name}."{code}".{k}]', *(f'"{a}" = {value(b)}' for a, b in v.items()), ""]
    return "\n".join(out)


def fingerprint(section: dict) -> str:
    return hashlib.sha256(canonical(section).encode()).hexdigest()


def discover(root: str = ".", user: str = "~/.docweave/packs") -> dict[str, tuple[str, dict]]:
    """name -> (origin, pack): what is more local wins."""
    out = {name: ("built-in", pack) for name, pack in BUILT_IN.items()}
    for origin, base in (("user", os.path.expanduser(user)), ("repo", os.path.join(root, "packs"))):
        for name in sorted(os.listdir(base)) if os.path.isdir(base) else ():
            path = os.path.join(base, name, "pack.toml")
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    out[name] = (origin, {"namespaces": tomllib.loads(f.read())})
    return out


def show(name: str, root: str = ".") -> str:
    """The canonical contract of a pack and of the one it builds on."""
    packs = discover(root)
    origin, pack = packs[name]
    base = packs[pack["base"]][1] if "base" in pack else None
    return canonical({"name": name, "origin": origin, "scope": "pack-definition", "namespaces": pack["namespaces"], "base": {"name": pack["base"], **base} if base else None})


def providers(code: str, root: str = ".") -> list[str]:
    """Packs that bind a rule."""
    packs = discover(root)
    return sorted(name for name, (_, p) in packs.items() if any(code in s.get("rules", []) for s in p["namespaces"].values()))


def add(name: str, config_text: str, root: str = ".") -> tuple[str, list[str], list[str]]:
    """The configuration with the pack's missing sections appended; (text, added, left as they are)."""
    packs = discover(root)
    have = tomllib.loads(config_text)
    chain, at = [name], packs[name][1]
    while "base" in at:
        chain.append(at["base"])
        at = packs[at["base"]][1]
    added, left, parts = [], [], [config_text.rstrip("\n")]
    for pack in chain:
        for ns, section in packs[pack][1]["namespaces"].items():
            if ns in have:
                left.append(ns)
            else:
                parts.append(f"# pack: {pack} {fingerprint(section)}\n" + text_of({"namespaces": {ns: section}}).rstrip("\n"))
                added.append(ns)
    return "\n\n".join(p for p in parts if p) + "\n", added, left


def baselines(config_text: str) -> list[tuple[str, str, str]]:
    """(namespace, pack, fingerprint) as ``add`` left them in the configuration."""
    out, mark = [], None
    for line in config_text.split("\n"):
        if line.startswith("# pack: "):
            mark = line.split()[2:4]
        elif line.startswith("[") and mark:
            out.append((line.strip("[]"), *mark))
            mark = None
    return out


def outdated(spark: SparkSession, config_text: str, root: str = ".") -> DataFrame:
    """ns, state: drift, current, no baseline, or gone, of the configured sections against the packs of today."""
    stored = spark.createDataFrame([(ns, fp) for ns, _, fp in baselines(config_text)], "ns string, fp string")
    configured = tomllib.loads(config_text)
    today = [(ns, fingerprint(s)) for _, p in discover(root).values() for ns, s in p["namespaces"].items() if ns in configured]
    return navigation.drift(stored, spark.createDataFrame(today, "ns string, fp string"), "ns", "fp")


def migrate(config_text: str, root: str = ".") -> tuple[str, list[str]]:
    """The configuration with drifted, unedited sections replaced; edited ones stay."""
    configured, replaced, text = tomllib.loads(config_text), [], config_text
    packs = discover(root)
    for ns, pack, old in baselines(config_text):
        now = packs.get(pack, (None, {"namespaces": {}}))[1]["namespaces"].get(ns)
        if now and fingerprint(now) != old and fingerprint(configured[ns]) == old:
            start = text.index(f"# pack: {pack} {old}")
            end = text.find("\n# pack: ", start + 1)
            block = f"# pack: {pack} {fingerprint(now)}\n" + text_of({"namespaces": {ns: now}})
            text = text[:start] + block + (text[end:] if end >= 0 else "")
            replaced.append(ns)
    return text, replaced
