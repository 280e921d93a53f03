"""Checks of the run and its configuration; they belong to no namespace's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DIAGNOSTICS, Corpus, diagnostics, findings, shaped
from ..sources.config import Config


def _rows(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(severity, code, subject) as diagnostics."""
    df = spark.createDataFrame(rows, "severity string, code string, message string")
    return shaped(df.withColumns({"channel": F.lit("kernel"), "path": F.lit("config"), "line": F.lit(0), "col": F.lit(0)}), DIAGNOSTICS)


def messages(spark, config: Config) -> DataFrame:
    return _rows(spark, config.messages)


def undescribed(c: Corpus) -> DataFrame:
    bad = [("error", "cfg.namespace-undescribed", n.name) for n in c.namespaces if not n.summary or len(n.summary) > 100 or "\n" in n.summary]
    return _rows(c.spark, bad)


def unowned(c: Corpus, roles: list[str] | None) -> DataFrame:
    """Declared namespaces with documents whose owner is missing or unknown."""
    bad = [(n.name, n.owner) for n in c.namespaces if not n.owner or (roles is not None and n.owner not in roles)]
    df = c.spark.createDataFrame(bad, "ns string, owner string").join(c.docs.select("ns"), "ns", "left_semi").withColumn("location", F.lit("config"))
    return diagnostics(findings(df, F.col("ns"), note=F.col("owner")), "cfg.namespace-unowned", "warning", "namespace {} has no known owner", channel="kernel")


def undeclared(c: Corpus, quiet: list[str]) -> DataFrame:
    """Namespaces of documents that no section declares, at the lowest-numbered document."""
    names = c.spark.createDataFrame([(n.name,) for n in c.namespaces], "ns string")
    rows = c.docs.join(F.broadcast(names), "ns", "left_anti").groupBy("ns").agg(F.count("*").alias("n"), F.min_by("location", F.struct("number", "location")).alias("location"))
    shown = rows.where(~F.col("ns").isin(quiet)) if quiet else rows
    return diagnostics(findings(shown, F.col("ns"), note=F.concat(F.col("n"), F.lit(" documents"))), "cfg.namespace-undeclared", "warning", "namespace {} is not declared", channel="kernel")


def count_undeclared(c: Corpus) -> int:
    names = [n.name for n in c.namespaces]
    return c.docs.where(~F.col("ns").isin(names)).select("ns").distinct().count()


def paths_skipped(c: Corpus) -> DataFrame:
    """Namespaces without documents whose patterns match only files that are no markdown."""
    from ..functions import globs

    rows = c.spark.createDataFrame([(n.name, globs.any_of(n.paths)) for n in c.namespaces if n.paths], "ns string, rx string")
    empty = rows.join(c.docs.select("ns"), "ns", "left_anti")
    hits = c.files.join(F.broadcast(empty), F.expr("path RLIKE rx")).groupBy("ns").agg(F.bool_or(F.col("path").endswith(".md")).alias("md"), F.count("*").alias("n"))
    return diagnostics(findings(hits.where("NOT md").withColumn("location", F.lit("config")), F.col("ns"), note=F.concat(F.col("n"), F.lit(" files"))), "cfg.paths-skipped", "warning", "the patterns of {} match no markdown", channel="kernel")


def path_conflict(c: Corpus) -> DataFrame:
    """Files without an id that several namespaces claim."""
    bad = c.tables["_parsed"].where("conflict")
    return diagnostics(findings(bad, F.array_join("by_path", ", ")), "cfg.path-conflict", "error", "claimed by {}", channel="kernel")


def unreadable(c: Corpus) -> DataFrame:
    """Claimed files that cannot be decoded; unclaimed ones are skipped."""
    bad = c.tables["_parsed"].where("NOT readable AND size(by_path) > 0")
    return diagnostics(findings(bad, F.col("location")), "src.markdown-read", "error", "{} cannot be read", channel="kernel")
