"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's words give shingles of SHINGLE words, each labelled with the number
of its occurrence, so that repeats count.  For each of BANDS random orders the
LEAST smallest shingles are sampled and put back into text order; their
sequence is hashed to a key.  Equal keys propose a pair: that is sensitive to
which shingles two texts share and to the order they stand in.  A pair is a
link if banded alignment finds an edit similarity of words of at least
SIMILARITY; classes are the components of the links.

Recall.  At Jaccard similarity J of shingles a pair shares some key with
probability 1 - (1 - J^2)^64.  Edits spread at random over a tenth, 15 % and a
fifth of the words (the last is SIMILARITY itself) leave J at about 0.42, 0.28
and 0.20: 99.999 %, 99.5 % and 92 %.  If one of the two has at most MEDIUM
words they share a further key for certain (``short_keys``).

Scale.  Exact copies are one node from the start.  Within a key, members are
paired with its leader only, the smallest node.  Members that are alike but
not like their leader (texts that share a passage and little else) meet by a
second deal, of all texts that share a key with another: FINE_BANDS samples of
FINE_LEAST of their words, occurrences labelled.  Texts that share a passage
alone seldom have such a sample in common, while a link has one with
probability 98.8 % or more.  There again members first meet a leader; what
still stands in several classes is paired off, each pair once, unless lengths
or the parities of word counts rule a link out.  Texts move only for nodes that share a key.  Keys, pairs and labels stay
distributed, hot keys meet in joins that Spark can split.

Defined results: a null text is the empty one; texts without five words have
one shingle of all their words; texts without words are like exact copies
alone; very long texts are sketched and aligned whole; rows with equal texts
are one class, whatever their ids; the class id is the least doc_id of the
class, null if none has one; other columns, whatever their names, are not
looked at; an empty table has no classes.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import allowed, edits
from .common import Workspace, id_and_text, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 64
LEAST = 2
#: Words up to which texts have keys of deletions: texts of at most 9 words link to no longer ones.
SHORT = 11
#: Words up to which every link is proposed; the longer text of such a link has up to a quarter more.
MEDIUM = 64
LONGEST_OF_MEDIUM = 80
#: Second samples, of words, for texts that share a key.
FINE_BANDS = 48
FINE_LEAST = 6
#: Parities of word counts, in words of 64 bits.
PARITIES = 32

_WORD = re.compile(r"\w+")
_KEPT_WORDS = 1_000_000
_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _TWO
    return x ^ (x >> _S)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Hash of each shingle, in text order."""
    n = len(words)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(SHINGLE, n)
    out = np.zeros(n - size + 1 if n else 0, np.uint64)
    for k in range(size if n else 0):
        out = out * _ONE + h[k : n - size + 1 + k]
    return _mixed(out)


def occurrences(h: np.ndarray) -> np.ndarray:
    """Number of equal shingles before each shingle."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return np.zeros(len(h), np.uint64)
    starts = np.flatnonzero(first)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    out = np.empty(len(h), np.uint64)
    out[order] = nth
    return out


_rng = np.random.default_rng(20)
_FACTORS = (_rng.integers(1, 1 << 31, (BANDS, 1), dtype=np.uint32) << np.uint32(1)) + np.uint32(1)
_MASKS = _rng.integers(1, 1 << 32, (BANDS, 1), dtype=np.uint32)


def _least(label: np.ndarray, bands: int, least: int) -> np.ndarray:
    """Places, ascending, of the ``least`` labels that come first in the order of each band."""
    short = (label >> np.uint64(32)).astype(np.uint32)
    places = np.empty((bands, least), np.int64)
    step = max(1, min(bands, 60_000 // len(label)))  # ranks stay in the processor's cache
    for b in range(0, bands, step):
        to = slice(b, min(b + step, bands))
        ranks = short * _FACTORS[to] ^ _MASKS[to]
        lanes = np.arange(len(ranks))
        for k in range(least):
            first = ranks.argmin(axis=1)
            places[to, k] = first
            ranks[lanes, first] = 0xFFFFFFFF
    places.sort(axis=1)
    return places


def _keys(bands: np.ndarray, picked: np.ndarray) -> np.ndarray:
    key = bands * _TWO + np.uint64(picked.shape[1])
    for k in range(picked.shape[1]):
        key = _mixed((key ^ picked[:, k]) * _ONE)
    return key.view(np.int64)


def sketch(words: list[str], hashes: WordHashes) -> list[int]:
    """One key a band; a text of at most LEAST shingles has one key, of all of them in order."""
    if not words:
        return []
    h = shingles(words, hashes)
    n = len(h)
    if n <= LEAST:
        return _keys(np.array([BANDS], np.uint64), h[None, :]).tolist()
    places = _least(_mixed(h + occurrences(h) * _ONE), BANDS, LEAST)
    return _keys(np.arange(BANDS, dtype=np.uint64), h[places]).tolist()


def fine_keys(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Keys of the second samples, and the parities of how often words stand in the text."""
    label = _mixed(words + occurrences(words) * _ONE)
    parity = np.bincount((label % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    parity = np.packbits(parity.astype(np.uint8)).view(np.int64)
    if len(label) <= FINE_LEAST:
        keys = _keys(np.array([FINE_BANDS], np.uint64), np.sort(label)[None, :])
    else:
        keys = _keys(np.arange(FINE_BANDS, dtype=np.uint64), np.sort(label[_least(label, FINE_BANDS, FINE_LEAST)], axis=1))
    return sorted({*keys.tolist(), *_left(words.tolist())}), parity


def _left(words: list) -> list[int]:
    """A key for each sequence that is left of a short text without the words a link may lack."""
    n = len(words)
    if not 0 < n <= SHORT:
        return []
    longest = int(n / SIMILARITY + 1e-9)
    left = {c for k in range(n - allowed(n, longest, SIMILARITY), n + 1) for c in itertools.combinations(words, k)}
    return [_hashed("left", c) for c in left]


def _hashed(what: str, words: tuple) -> int:
    return xxhash.xxh3_64_intdigest(" ".join([what, *map(str, words)]), seed=len(words)) - (1 << 63)


def short_keys(words: list[str]) -> list[int]:
    """Keys of which the two texts of any link share one, if one of them has at most MEDIUM words.

    Up to SHORT words: each sequence that is left without the words a link may
    lack.  From there to MEDIUM words: each run of a few words.  A link of n
    words, the more of the two, has e <= (1 - SIMILARITY) * n edits, so at least
    n - e words in at most e + 1 runs are left as they are, and one of those
    runs has (n - e) / (e + 1) words or more: three up to 15 words, else four.
    """
    n = len(words)
    if not n or n > LONGEST_OF_MEDIUM:
        return []
    runs: set = set()
    if n > SHORT - 3:
        for size, up_to in ((3, 18), (4, LONGEST_OF_MEDIUM)):
            if n <= up_to:
                runs |= {tuple(words[i : i + size]) for i in range(n - size + 1)}
    return _left(words) + [_hashed("run", c) for c in runs]


_SKETCH = "doc_id bigint, md5 binary, n bigint, keys array<bigint>"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, number of words and keys of every row."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            md5, n, keys = [], [], []
            for text in b.column(1):
                text = text.as_py()
                words = words_of(text)
                md5.append(hashlib.md5(text.encode("utf-8")).digest())
                n.append(len(words))
                keys.append(sketch(words, hashes) + short_keys(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(md5, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "md5", "n", "keys"],
            )

    return id_and_text(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(made, _SKETCH)


def compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are links, by banded alignment of their words' hashes."""

    def aligned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(w.as_buffer(), np.uint64).tolist() for w in (x, y))
                limit = allowed(len(x), len(y), least)
                linked.append(edits(x, y, limit) <= limit)
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("words").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(aligned, "a long, b long")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, label of every node of the edges (a, b): equal labels within a component.

    Each level sends a node to its least neighbour and keeps the edges between
    the nodes that are left; levels are written to the shared folder.
    """
    rest = work.written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        to = work.written(least.select("node", F.least("node", "m").alias("to")), "level")
        if labels is None:
            labels = to.withColumnRenamed("to", "label")
        else:
            step = to.select(F.col("node").alias("label"), "to")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = work.written(labels, "labels")
        rest = (
            rest.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        rest = work.written(rest, "edges")
    return edges.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels


def _labelled(df: DataFrame, labels: DataFrame, node: str, to: str) -> DataFrame:
    names = labels.select(F.col("node").alias(node), F.col("label").alias("_l"))
    return df.join(names, node, "left").withColumn(to, F.coalesce("_l", node)).drop("_l")


def _word_hashes(texts: DataFrame) -> DataFrame:
    """(node, words): 64-bit hashes of the words of each text."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            split = (words_of(t.as_py()) for t in b.column(1))
            raw = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)).tobytes() for w in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["node", "words"])

    return texts.mapInArrow(made, "node long, words binary")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, md5, label (of the class) and class_id of every row of ``docs``."""
    with Workspace(docs.sparkSession, "near") as work:
        return written(_classes(docs, least, work), "near-classes")


def _classes(docs: DataFrame, least: float, work: Workspace) -> DataFrame:
    sk = work.written(sketches(docs), "sketches")
    # one row of each text stands for it; repeated rows of it change nothing
    nodes = sk.groupBy("md5").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    nodes = work.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    met = keyed.join(shared.select("key", "leader"), "key").where("node <> leader")
    met = work.written(met, "met")

    wanted = met.select("node").union(met.select("leader")).distinct().join(nodes.select("node", "md5", "first_id"), "node")
    source = id_and_text(docs).select(F.col("doc_id").cast("long").alias("first_id"), "text")
    source = source.withColumn("md5", F.unhex(F.md5(F.col("text").cast("binary"))))
    at = [F.coalesce(F.col("first_id"), F.lit(0)), F.col("first_id").isNull()]
    source = source.select(at[0].alias("k1"), at[1].alias("k2"), "md5", "text")
    wanted = wanted.select(at[0].alias("k1"), at[1].alias("k2"), "md5", "node")
    found = source.join(wanted, ["k1", "k2", "md5"]).select("node", "text")
    texts = work.written(_word_hashes(found).dropDuplicates(["node"]), "texts")

    # first round: each node and the least leader that it meets
    pairs = met.groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b"))
    links = work.written(compared(pairs, texts, least), "links")
    labels = components(links, work)

    # second round: the other leaders that it meets, where the classes still differ
    apart = met.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    apart = apart.join(pairs, ["a", "b"], "left_anti")
    labels = _joined(_apart(apart, labels), texts, labels, least, work)
    labels = _fine(texts, labels, least, work)

    of_node = _labelled(nodes.select("md5", "node", "first_id"), labels, "node", "label")
    ids = of_node.groupBy("label").agg(F.min("first_id").alias("class_id"))
    of_text = of_node.join(ids, "label").select("md5", "label", "class_id")
    return sk.select("doc_id", "md5").join(of_text, "md5").select("doc_id", "md5", "label", "class_id")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes differ."""
    return _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b")


def _joined(pairs: DataFrame, texts: DataFrame, labels: DataFrame, least: float, work: Workspace) -> DataFrame:
    """Labels after comparing these pairs: what their links join are classes."""
    pairs = work.written(pairs, "pairs")
    if pairs.isEmpty():
        return labels
    new = work.written(compared(pairs, texts, least), "links")
    if new.isEmpty():
        return labels
    between = _labelled(_labelled(new, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(between, work).select(F.col("node").alias("label"), F.col("label").alias("to"))
    fresh = new.select(F.col("a").alias("node")).union(new.select("b")).distinct()
    known = _labelled(labels.select("node").union(fresh).distinct(), labels, "node", "label")
    return work.written(known.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _several(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (key, node, ...), labelled, whose key holds nodes of different classes."""
    now = _labelled(keyed, labels, "node", "label")
    keys = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("leader"))
    return now.join(keys.where("low < high").select("key", "leader"), "key")


_FINE = "node long, n long, keys array<long>, " + ", ".join(f"p{i} long" for i in range(PARITIES))


def _fine(texts: DataFrame, labels: DataFrame, least: float, work: Workspace) -> DataFrame:
    """Labels after comparing what shares a second sample, among texts that share a key with another.

    Pairs are ruled out by bounds that every link keeps: of two texts of n and m
    words, n the more, with e edits, m >= n - e, and the words that one has
    oftener than the other number at most 2 * e - (n - m), and so do the
    parities that differ.
    """

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = [np.frombuffer(w.as_buffer(), np.uint64) for w in b.column(1)]
            fine = [fine_keys(w) for w in words]
            parities = np.array([p for _, p in fine], np.int64).reshape(len(fine), PARITIES)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([k for k, _ in fine], pa.list_(pa.int64())),
                    *(pa.array(parities[:, i]) for i in range(PARITIES)),
                ],
                names=["node", "n", "keys", *(f"p{i}" for i in range(PARITIES))],
            )

    fine = work.written(texts.select("node", "words").mapInArrow(made, _FINE), "fine")
    # each node and the leaders of its keys
    members = work.written(_several(fine.select("node", F.explode("keys").alias("key")), labels), "members")
    led = members.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    labels = _joined(_apart(led, labels), texts, labels, least, work)

    # what is left, each pair in the least key that it shares
    rest = members.where("node <> leader").select("key", "node")
    rest = _several(rest, labels).select("key", "node", "label").join(fine, "node")
    side = lambda x: rest.select("key", *[F.col(c).alias(f"{c}_{x}") for c in rest.columns if c != "key"])
    edits_left = F.floor((1 - least) * F.greatest("n_a", "n_b") + 1e-9)
    differ = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITIES)), F.lit(0))
    may = (
        (F.col("node_a") > F.col("node_b"))
        & (F.col("label_a") != F.col("label_b"))
        & (F.abs(F.col("n_a") - F.col("n_b")) <= edits_left)
        & (differ <= 2 * edits_left - F.abs(F.col("n_a") - F.col("n_b")))
        & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))
    )
    left, right = side("a"), side("b").withColumnRenamed("key", "key_b")
    pairs = left.join(right, (left["key"] == right["key_b"]) & may).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return _joined(pairs, texts, labels, least, work)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: one of each.

    It is a row of the least doc_id; of rows that repeat that, the one whose
    text has the least digest.
    """
    names = docs.columns
    best = classes(docs, least).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    best = best.select("label", "doc_id", F.hex("md5").alias("hex")).groupBy("label", "doc_id").agg(F.min("hex").alias("hex"))
    best = best.select(
        F.coalesce("doc_id", F.lit(0)).alias("_k1"), F.col("doc_id").isNull().alias("_k2"), F.unhex("hex").alias("_k3")
    )
    source = docs.withColumns({
        "_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "_k2": F.col("doc_id").isNull(),
        "_k3": F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))),
    })
    return source.join(best, ["_k1", "_k2", "_k3"], "left_semi").dropDuplicates(["_k1", "_k2", "_k3"]).select(*names)


def query(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id")
