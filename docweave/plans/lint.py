"""The lint plan: configuration, corpus, one branch for each bound rule, one table of diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DIAGNOSTICS, TABLES, Corpus, Namespace, diagnostics, shaped
from ..operators import core, kernel
from ..sources import config as cfg, external, markdown, scan
from ..sources.git import Git
from . import packs
from .registry import RULES


@dataclass
class Run:
    config: cfg.Config
    corpus: Corpus
    found: DataFrame


def joined(a: Corpus, b: Corpus | None) -> Corpus:
    """Two corpora as one: sources and files resolve against each other."""
    if b is None:
        return a
    for name in TABLES:
        if name in b.tables:
            mine, theirs = shaped(getattr(a, name), TABLES[name]), shaped(b.tables[name], TABLES[name])
            a.tables[name] = mine.unionByName(theirs)
    return a


def load(spark: SparkSession, root: str, config: cfg.Config | None = None, as_of: str | None = None) -> tuple[cfg.Config, Corpus, DataFrame]:
    """Configuration, corpus with scanned files and sources, and kernel messages of reading."""
    config = cfg.load(root) if config is None else config
    config.external = external.discover_rules(root)
    if as_of:
        for n in config.namespaces:
            for code in n.rules:
                n.params.setdefault(code, {}) if code in ("core.calendar-freshness", "todo.freshness", "security.vuln-sla", "security.risk-expiry") else None
            for code in ("core.calendar-freshness", "todo.freshness", "security.vuln-sla", "security.risk-expiry"):
                if code in n.params:
                    n.params[code].setdefault("as_of", as_of)
    cfg.validate(config, RULES, lambda code: packs.providers(code, root))
    corpus = markdown.ingest(spark, root, config)
    messages = kernel.path_conflict(corpus).unionByName(kernel.unreadable(corpus))
    if config.sources:
        more, said = external.source_corpus(spark, config, root)
        corpus = joined(corpus, more)
        messages = messages.unionByName(said)
    prefixes = sorted({*config.names(), *(r.ns for r in corpus.docs.select("ns").distinct().collect())})
    if config.scan and any("core.cross-ref" in n.rules for n in corpus.namespaces):
        corpus.tables["scan_hits"] = scan.scan(spark, root, config.scan, prefixes)
    git = Git(root)
    corpus.git = git if git.available() else None
    corpus.root = root
    return config, corpus, messages.unionByName(kernel.messages(spark, config))


def check(c: Corpus, namespaces: list[Namespace] | None = None, external_rules: dict[str, str] | None = None) -> DataFrame:
    """Diagnostics of all bound rules, with the column ns; rules that nobody binds make no branch."""
    out = None
    for n in c.namespaces if namespaces is None else namespaces:
        for code in n.rules:
            rule = RULES.get(code)
            if rule is not None:
                part = diagnostics(rule.run(c, n.name, n.params.get(code, {})), code, rule.severity, rule.message, rule.hint)
            elif code in (external_rules or {}):
                part = external.run_rule(c, n.name, code, external_rules[code], n.params.get(code))
            else:
                continue
            part = part.withColumn("ns", F.lit(n.name))
            out = part if out is None else out.unionByName(part)
    if "scan_hits" in c.tables and any("core.cross-ref" in n.rules for n in c.namespaces):
        part = diagnostics(core.scanned_ref(c), "core.cross-ref", "error", RULES["core.cross-ref"].message).withColumn("ns", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    return c.spark.createDataFrame([], DIAGNOSTICS + ", ns string") if out is None else out


def lint(spark: SparkSession, root: str, config: cfg.Config | None = None, only: list[str] | None = None, as_of: str | None = None) -> Run:
    """All diagnostics of a root; ``only`` scopes the subjects, never the targets, and drops the coverage checks."""
    if config is None and cfg.find(root) is None:
        raise cfg.ConfigError(f"cfg.missing: there is no {cfg.CONFIG_NAME} at or above {root}")
    config, corpus, messages = load(spark, root, config, as_of)
    scoped = [n for n in corpus.namespaces if not only or n.name in only]
    found = check(corpus, scoped, config.external)
    if not only and not config.zero:
        for part in (kernel.undescribed(corpus), kernel.unowned(corpus, config.roles), kernel.undeclared(corpus, config.ignore_namespaces), kernel.paths_skipped(corpus)):
            messages = messages.unionByName(part)
    return Run(config, corpus, found.unionByName(messages.withColumn("ns", F.lit(None).cast("string"))))
