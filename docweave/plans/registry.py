"""Every built-in rule at one place: code, function, severity, parameters, message."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators import core, packs


@dataclass(frozen=True)
class Rule:
    code: str
    run: Callable
    severity: str
    message: str
    #: whether the rule cannot run without a table of parameters
    needs: bool = False
    #: (namespace, params) -> the rule can never fire
    inert: Callable | None = None
    hint: str | None = None


def _no_paths(n, p) -> bool:
    """A rule about files never sees one in a namespace without patterns."""
    return not n.paths


_ALL = [
    Rule("core.frontmatter", core.frontmatter, "error", "the metadata block does not parse: {}"),
    Rule("core.id", core.id_present, "error", "no well-formed id: {}"),
    Rule("core.id-unique", core.id_unique, "error", "{} is used more than once"),
    Rule("core.dep-resolved", core.dep_resolved, "error", "{} is no known document"),
    Rule("core.dep-cycle", core.dep_cycle, "error", "{} depends on itself"),
    Rule("core.dep-status", core.dep_status, "error", "depends on {}, which is still open", needs=True),
    Rule("core.cross-ref", core.cross_ref, "error", "{} is no known document"),
    Rule("core.link-resolved", core.link_resolved, "warning", "{} does not exist"),
    Rule("core.required-headings", core.required_headings, "error", "section {} is missing", needs=True),
    Rule("core.required-metadata", core.required_metadata, "error", "key {} is missing", needs=True),
    Rule("core.allowed-values", core.allowed_values, "error", "the value of {} is not allowed", needs=True),
    Rule("core.metadata-format", core.metadata_format, "error", "the value of {} has not its form", needs=True),
    Rule("core.min-docs", core.min_docs, "error", "namespace {} has no documents"),
    Rule("core.dep-shape", core.dep_shape, "error", "depends on no {}", needs=True),
    Rule("core.successor-link", core.successor_link, "error", "no successor in {}"),
    Rule("core.supersedes-reciprocal", core.supersedes_reciprocal, "warning", "{} does not say that it is superseded"),
    Rule("core.acceptance-complete", core.acceptance_complete, "error", "an open box under {}", needs=True),
    Rule("core.commit-freshness", core.commit_freshness, "error", "the pin {} is not fresh"),
    Rule("core.calendar-freshness", core.calendar_freshness, "warning", "{} is too long ago"),
    Rule("core.file-name", core.file_name, "error", "the file name does not fit {}"),
    Rule("core.file-budget", core.file_budget, "warning", "{} characters"),
    Rule("core.required-anchors", core.required_anchors, "error", "{} does not occur", inert=lambda n, p: not p.get("anchors")),
    Rule("core.requires-link", core.requires_link, "error", "no link to {}", needs=True),
    Rule("core.requirement-ref", core.requirement_ref, "warning", "{} is no known requirement"),
    Rule("core.requirement-status", core.requirement_status, "error", "requirement {} has no known status", needs=True),
    Rule("ears.clause-syntax", packs.clause_syntax, "error", "{} follows no clause form"),
    Rule("todo.freshness", packs.todo_freshness, "warning", "last updated: {}", inert=_no_paths),
    Rule("todo.structure", packs.todo_structure, "error", "{} is missing", inert=_no_paths),
    Rule("todo.sections", packs.todo_sections, "warning", "section {}", inert=_no_paths),
    Rule("todo.listed", packs.todo_listed, "warning", "{} is not in the to-do file", needs=True),
    Rule("agents.context-headings", packs.context_headings, "error", "{} does not belong here or is not linked", inert=_no_paths),
    Rule("agents.context-budget", packs.context_budget, "warning", "over budget or dangling: {}", inert=_no_paths),
    Rule("agents.context-cache", packs.context_cache, "warning", "{} commits in quick succession", inert=_no_paths),
    Rule("writing.banned-prose", packs.banned_prose, "error", "says {}", needs=True),
    Rule("skills.frontmatter", packs.skills_frontmatter, "error", "{} is empty", inert=_no_paths),
    Rule("agent.frontmatter", packs.agent_frontmatter, "error", "frontmatter: {}", inert=_no_paths),
    Rule("opencode.frontmatter", packs.plain_agent_frontmatter, "error", "frontmatter: {}", inert=_no_paths),
    Rule("agent.assigned", packs.agent_assigned, "error", "no agent {}"),
    Rule("spec.requires-prd", lambda c, ns, p: core.dep_shape(c, ns, {"requires": ["PRD"]}), "error", "depends on no {}"),
    Rule("tasks.files-allowed", packs.files_allowed, "warning", "{} does not exist"),
    Rule("guide.frontmatter", packs.guide_frontmatter, "error", "{} is missing or not allowed", needs=True),
    Rule("c4.frontmatter", packs.c4_frontmatter, "error", "{} is missing or not allowed", needs=True),
    Rule("checklist.complete", packs.checklist_complete, "error", "{} open boxes in a sealed list"),
    Rule("checklist.pinned", packs.checklist_pinned, "error", "pinned commit {}"),
    Rule("ddd.context-map-shape", packs.context_map_shape, "error", "shape of the map: {}"),
    Rule("security.vuln-sla", packs.vuln_sla, "error", "open for {} days"),
    Rule("security.risk-expiry", packs.risk_expiry, "error", "accepted risk without valid {}"),
    Rule("security.remediation-link", packs.remediation_link, "error", "{} names no remediation"),
    Rule("hipaa.safeguard-evidence", packs.control_evidence, "error", "{} has no evidence"),
    Rule("soc2.control-evidence", packs.control_evidence, "error", "{} has no evidence"),
    Rule("design.section-order", packs.section_order, "error", "section {}", needs=True),
    Rule("design.token-ref", packs.token_ref, "error", "{} is not defined"),
    Rule("soul.sections", packs.soul_sections, "warning", "section {}", needs=True, inert=_no_paths),
    Rule("soul.referenced", packs.file_referenced, "warning", "no link to {}", needs=True),
    Rule("style.referenced", packs.file_referenced, "warning", "no link to {}", needs=True),
    Rule("style.section-order", packs.section_order, "warning", "section {}", needs=True, inert=_no_paths),
    Rule("style.soul-pair", packs.pair, "warning", "{} is missing", needs=True, inert=_no_paths),
]

RULES: dict[str, Rule] = {r.code: r for r in _ALL}
