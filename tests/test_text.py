import re

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from docweave.functions import globs, text as tx
from docweave.operators.core import globs_col
from docweave.sources import markdown as md


@pytest.mark.parametrize(
    "given_, norm", [("1. Status", "status"), ("STATUS:", "status"), ("A) Plan :", "plan"), ("Run make check first", "run make check first"), ("2024 plan", "2024 plan")]
)
def test_norm_heading(spark, given_, norm):
    assert tx.norm_heading(given_) == norm
    assert spark.createDataFrame([(given_,)], "t string").select(tx.norm_heading_col(F.col("t"))).first()[0] == norm


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("docs/adrs/**", "docs/adrs/a/b.md", True), ("docs/*.md", "docs/a/b.md", True), ("docs/?.md", "docs/ab.md", False), ("TODO.md", "x/TODO.md", False),
        ("**/SKILL.md", "SKILL.md", True), ("a/**/b.md", "a/b.md", True), ("a/**/b.md", "a/x/y/b.md", True), ("d/[0-9]*.md", "d/1-x.md", True), ("d/{a,b}.md", "d/b.md", True), ("a.md", "aXmd", False),
    ],
)
def test_globs(spark, glob, path, hit):
    assert bool(re.match(globs.to_regex(glob), path)) == hit
    assert spark.createDataFrame([(path,)], "p string").where(F.col("p").rlike(globs.any_of([glob]))).count() == hit
    if "[" not in glob and "{" not in glob:
        assert spark.createDataFrame([(path, glob)], "p string, g string").withColumn("rx", globs_col(F.col("g"))).where("p RLIKE rx").count() == hit


def test_invalid_globs():
    assert not globs.valid("/abs") and not globs.valid("!no") and globs.valid("docs/**")


def test_dates(spark):
    df = spark.createDataFrame([("2026-02-30",), ("2026-02-28",), ("2026-2-8",), ("2026-02-28T10:00:00Z",), ("2026-02-28T10:00:00",), ("2026-02-30T10:00:00+01:00",), ("2026-02-28t10:00:00.5-05:30",)], "t string")
    got = [(r[0] is not None, r[1]) for r in df.select(tx.date_of(F.col("t")), tx.is_datetime(F.col("t"))).collect()]
    assert got == [(False, False), (True, False), (False, False), (False, True), (False, False), (False, False), (False, True)]


def test_tokens_take_the_longest_known_prefix():
    rx = re.compile(tx.token_pattern(["ADR", "SR-MAP", "MAP"]))
    assert [m[0] for m in rx.finditer("ADR-001 xADR-2 SR-MAP-3 PRE-ADR-4 ADR-5a HTTP-2 MAP-6")] == ["ADR-001", "SR-MAP-3", "ADR-4", "MAP-6"]


@pytest.mark.parametrize(
    "text, error",
    [("---\nid: A-1\n---  \nbody", None), ("---\nid: A-1\n...\nbody", "..."), ("---\nid: A-1\n", "not closed"), ("---\na: [b\n---\n", ""), (" ---\nid: A-1\n---\n", None)],
)
def test_fence(text, error):
    got = md.frontmatter(text)[4]
    assert (got is None) if error is None else (got is not None and error in got)


def test_plain_yaml_reads_like_the_full_parser():
    block = "id: ADR-1\ntags: [a, b]\nlist:\n  - x\n  - 'y z'\nn: 3\nmap:\n  k: v\ndate: 2026-02-30"
    assert md._plain_yaml(block) == md._load_yaml(block)


def test_code_and_strike_hide_tokens():
    body = "See ADR-1, `ADR-2`, ~~ADR-3~~ and ``a ` ADR-4``.\n```\nADR-5\n```\nmulti `line\ncode ADR-6` ADR-7"
    prose = md.scan_body(body, 0)["prose"]
    assert re.findall("ADR-[0-9]", prose) == ["ADR-1", "ADR-7"]


def test_links():
    assert md.link_path("docs/a.md", "b.md#x") == "docs/b.md"
    assert md.link_path("docs/a.md", "../c%20d.png") == "c d.png"
    assert [md.link_path("a.md", t) for t in ("#x", "/abs", "https://e.org/x", "mailto:x@y")] == [None] * 4


@given(st.text(max_size=200))
def test_any_text_parses(text):
    row = md.parse("x.md", text)
    assert row["readable"] and len(md.scan_body(text, 0)["prose"].split("\n")) == len(text.split("\n"))
