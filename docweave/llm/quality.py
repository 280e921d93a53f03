"""Quality rules as a short-circuit cascade.

Each rule asks for one or two figures of a text, which are computed when first
asked for and shared between rules.  On a bounded sample, taken from partitions
all over the table, every rule's cost (seconds a text, with the figures that it
needs) and selectivity (share of texts that it rejects) are measured; rules are
ordered by rejections per second, and a text leaves the cascade at its first
rejection, so what later rules would have asked for is never computed.  The
order changes the work, never the verdict, which is that of all rules.

``judge`` reports the base figures of every text and therefore computes those
always; ``keep_good`` computes only what the cascade asks for.

Defined results: a null or empty text has no words and fails the base rule;
very long texts are judged whole; repeated rows are judged each on their own;
other columns, whatever their names, are not looked at; of an empty table the
order of rules is that of their names, and there are no rows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, spread

#: Rows from which the order of rules is estimated; the verdict does not depend on it.
SAMPLE_ROWS = 256
#: Partitions over which the sample is spread at most.
SAMPLE_PARTITIONS = 64

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_rules_run bigint, rejected_by string"
)

_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_CAPS = re.compile("[A-Z]{2}")
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff][^\x20\x09-\x0d]*")
_BULLETS = re.compile(r"^[ \t]*[-*\u2022]", re.MULTILINE)
_ELLIPSES = re.compile(r"(?:\.\.\.|\u2026)[ \t\r]*$", re.MULTILINE)


class Figures:
    """What is known of one text; each figure is counted over the whole text when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at 20 and 09-0D alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(_SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_capitals(self) -> int:
        return len(_CAPS.findall(self.text))

    @cached_property
    def n_letter_words(self) -> int:
        return len(_LETTERS.findall(self.raw))

    @cached_property
    def n_bullets(self) -> int:
        return len(_BULLETS.findall(self.text))

    @cached_property
    def n_ellipses(self) -> int:
        return len(_ELLIPSES.findall(self.text))

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v < 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


#: name -> (text figures) -> rejected?  Integer arithmetic, so that SQL can say the same.
RULES: dict[str, Callable[[Figures], bool]] = {
    # more than one symbol of markup or tables for every ten words
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    # two fifths of the words stand in repeated three-word windows
    "repeats": lambda f: 5 * f.n_repeat_words > 2 * f.n_words,
    # more lines than not were seen before
    "lines": lambda f: 2 * f.n_dup_lines > f.n_lines,
    # words too short or too long on average for prose
    "lengths": lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 12 * f.n_words,
    # shouting: pairs of adjacent capitals, more than one for every four words
    "capitals": lambda f: 4 * f.n_capitals > f.n_words,
    # exclamation marks, more than one for every five words
    "exclaims": lambda f: 5 * f.raw.count(b"!") > f.n_words,
    # a third of the words and more without any letter
    "letters": lambda f: 3 * f.n_letter_words < 2 * f.n_words,
    # nine of ten lines are items of a list
    "bullets": lambda f: 10 * f.n_bullets > 9 * f.n_lines,
    # three of ten lines break off
    "ellipses": lambda f: 10 * f.n_ellipses > 3 * f.n_lines,
}


def cascade(f: Figures, order: list[str]) -> tuple[bool, int, str | None]:
    """Verdict, rules run, and the rule that rejected."""
    for k, name in enumerate(order, 1):
        if RULES[name](f):
            return False, k, name
    return True, len(order), None


def passes(f: Figures, order: list[str]) -> bool:
    """The verdict alone: what the base rule says of repeats, ``repeats`` says of fewer."""
    return f.n_words >= 50 and cascade(f, order)[0]


def sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """About ``sample_rows`` texts, the first few of up to SAMPLE_PARTITIONS partitions spread over the table."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = texts.rdd.getNumPartitions()
    step = max(1, n // SAMPLE_PARTITIONS)
    each = -(-sample_rows // max(1, n // step))

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = each if TaskContext.get().partitionId() % step == 0 else 0
        while left and (b := next(it, None)) is not None:
            yield b.slice(0, left)
            left -= min(left, b.num_rows)

    return [r.text for r in texts.mapInArrow(first, "text string").collect()]


def measured(texts: list[str]) -> dict[str, tuple[float, float]]:
    """(seconds a text, share rejected) of each rule, every figure computed anew for each rule."""
    texts = [t for t in texts if Figures(t).n_words >= 50]
    out = {}
    for name, rule in RULES.items():
        figures = [Figures(t) for t in texts]
        for f in figures:  # known before the cascade begins
            f.n_words  # noqa: B018
        began = time.perf_counter()
        hits = sum(map(rule, figures))
        out[name] = ((time.perf_counter() - began) / max(1, len(texts)), (hits + 0.5) / (len(texts) + 1))
    return out


def rule_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second on the sample, names breaking ties."""
    texts = sample(docs, sample_rows)
    if not texts:
        return sorted(RULES)
    figures = measured(texts)
    return sorted(RULES, key=lambda name: (-figures[name][1] / max(figures[name][0], 1e-9), name))


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` with base figures and verdict."""
    order = rule_order(docs, sample_rows)

    def rows(ids: list, texts: list) -> dict:
        out = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
        kept, run, by = [], [], []
        for text in texts:
            f = Figures(text)
            for c in out:
                out[c].append(getattr(f, c))
            ok, n, name = (False, 0, "base") if f.base_failed else cascade(f, order)
            kept.append(ok)
            run.append(n)
            by.append(name)
        return {"doc_id": ids, **out, "kept": kept, "n_rules_run": run, "rejected_by": by}

    return map_texts(id_and_text(docs), SCHEMA, rows)


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rule and the cascade."""
    order = rule_order(docs, sample_rows)
    names = docs.columns

    def passing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(names.index("text"))
            yield b.filter(pa.array([passes(Figures(t.as_py() or ""), order) for t in texts], pa.bool_()))

    return spread(docs).mapInArrow(passing, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid
),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(text, '[A-Z][A-Z]')) AS n_caps,
         length(text) - length(replace(text, '!', '')) AS n_exclaims,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letter_words,
         len(regexp_extract_all(text, '(?m)^[ \t]*[-*\x{2022}]')) AS n_bullets,
         len(regexp_extract_all(text, '(?m)(?:\.\.\.|\x{2026})[ \t\r]*$')) AS n_ellipses
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         10 * n_symbols > n_words OR 5 * n_repeat_words > 2 * n_words OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 12 * n_words
         OR 4 * n_caps > n_words OR 5 * n_exclaims > n_words OR 3 * n_letter_words < 2 * n_words
         OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
FROM b
"""
