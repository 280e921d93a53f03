"""Mentions of ids in files that are no markdown."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs, text as tx
from ..model import SCAN_HITS, shaped
from .markdown import read_files

IGNORE_LINE = "docweave: ignore-line"
IGNORE_NEXT = "docweave: ignore-next"


def vcs_ignored(root: str) -> list[str]:
    """Paths that version-control ignore files leave out (.gitignore, .ignore, .rgignore, by folder).

    git answers where it can, on the driver, for paths and not for contents;
    else the plain patterns of the files are read.
    """
    found = subprocess.run(
        ["git", "-C", root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "--exclude-per-directory=.ignore", "--exclude-per-directory=.rgignore"],
        capture_output=True, text=True, check=False,
    )
    if found.returncode == 0:
        return [x for x in found.stdout.split("\n") if x]
    out = []
    for folder, _, files in os.walk(root):
        at = os.path.relpath(folder, root)
        for name in {".gitignore", ".ignore", ".rgignore"} & set(files):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                for line in (x.strip() for x in f):
                    if line and not line.startswith(("#", "!")):
                        anchored = line.lstrip("/")
                        base = "" if at == "." else at + "/"
                        out.append(base + (anchored if "/" in line.rstrip("/") else "**/" + anchored))
    return out


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text) of decodable files, numbered from 1."""
    text = F.decode("content", "UTF-8")
    whole = files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("location").alias("file"), F.posexplode(F.split(text, "\r?\n")).alias("i", "text"))
    return whole.select("file", (F.col("i") + 1).alias("line"), "text")


def hits(lines_: DataFrame, prefixes: list[str], same: str = IGNORE_LINE, next_: str = IGNORE_NEXT) -> DataFrame:
    """Mentions of ids with known prefixes, but for lines that a marker suppresses."""
    if not prefixes:
        return shaped(lines_.limit(0), SCAN_HITS)
    # only lines with a mention or a marker go through the window
    pattern = tx.token_pattern(prefixes)
    relevant = lines_.where(F.col("text").contains("-") & (F.col("text").rlike(pattern) | F.col("text").contains(next_)))
    w = Window.partitionBy("file").orderBy("line")
    before = F.struct(F.lag("line").over(w).alias("line"), F.lag("text").over(w).alias("text"))
    df = relevant.withColumn("before", before)
    hushed = F.col("text").contains(same) | ((F.col("before.line") == F.col("line") - 1) & F.col("before.text").contains(next_))
    df = df.where(~F.coalesce(hushed, F.lit(False)))
    raw = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    found = df.select("file", "line", raw.alias("raws"), gaps.alias("gaps")).select("file", "line", "raws", "gaps", F.posexplode("raws").alias("i", "raw"))
    upto = lambda xs, n: F.aggregate(F.transform(F.slice(xs, F.lit(1), n), lambda x: F.length(x)), F.lit(0), lambda a, v: a + v)
    col = upto(F.col("gaps"), F.col("i") + 1) + upto(F.col("raws"), F.col("i")) + 1
    return found.select("file", tx.ns_of(F.col("raw")).alias("ns"), tx.number_of(F.col("raw")).alias("number"), "raw", "line", col.alias("col"))


def scan(spark: SparkSession, root: str, patterns: list[str], prefixes: list[str]) -> DataFrame:
    """Mentions in the files below a root that the patterns match and no ignore file leaves out."""
    if not patterns:
        return spark.createDataFrame([], SCAN_HITS)
    files = read_files(spark, root).where(F.col("location").rlike(globs.any_of(patterns)) & ~F.col("location").endswith(".md"))
    out = []
    for path in vcs_ignored(root):
        rx = globs.to_regex(path.rstrip("/"))[1:-1]
        out.append(f"(?:{rx})(?:/.*)?")
    if out:
        files = files.where(~F.col("location").rlike("^(?:" + "|".join(out) + ")$"))
    files = files.where(~F.col("location").rlike(r"(^|/)\.git/"))
    return hits(lines(files), prefixes)


