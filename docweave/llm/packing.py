"""Packing documents into windows by best-fit decreasing.

Ids of a document, with the end id, are cut into full windows first; what is
left over (shorter than a window) is packed by best-fit decreasing: leftovers
in descending length, each into the open window with the least room that still
holds it.  A segment tree over the remaining capacities 1..window finds that
window in log2(window) steps.

Documents are encoded where they lie and cut into pieces.  The figures of the
leftovers alone (piece number and length, a few bytes a document) are dealt out
in groups of about GROUP_PIECES, however many partitions the documents have,
and each group is packed by itself: memory is bounded, and what a group's last
windows leave empty is little.  Ids, where they are wanted, are joined to the
packed figures, so windows are the same with and without them.

Defined results: a null or empty text is the end id alone; very long texts are
cut into full windows and one leftover; repeated rows are separate documents,
which only their pieces' numbers tell apart; other columns, whatever their
names, are not looked at; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_TEXT, byte_letters, id_and_text, tokenizer, written

WINDOW = 1024
#: Leftovers that are packed together, about (their figures are in memory, not their ids).
GROUP_PIECES = 50_000


class RoomTree:
    """A segment tree indexed by remaining capacity, holding the open windows."""

    def __init__(self, window: int):
        self.size = 1 << max(1, window.bit_length())
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window_id: int) -> None:
        if room:
            self.open[room].append(window_id)
            at = self.size + room
            while at:
                self.count[at] += 1
                at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with at least ``need`` room: its room and number."""
        at, count = self.size + need, self.count
        while not count[at]:
            while at & 1:  # a right child: what is above lies to the left
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at *= 2
            if not count[at]:
                at += 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each length (1..window), and the number of windows."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if (found := tree.take(length)) is None:
            room, w, n = window, n, n + 1
        else:
            room, w = found
        where[i], offset[i] = w, window - room
        tree.put(room - length, w)
    return where, offset, n


class ByteEncoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them.

    Plain texts go to tiktoken, which merges by the same ranks several times
    faster, if the file's ids rise with its merges; all others to the library.
    """

    #: Fixed value: the split pattern that the files' byte-level pre-tokenizer stands for.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        self.fast = None
        if made == sorted(set(made)) and len(made) + 256 == len(vocab) and min(made) == 256 and not spec["normalizer"]:
            import tiktoken

            byte_of = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN_TEXT.fullmatch(text) and not self.special.search(text):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of every document, at most ``window`` ids each; with ``with_ids`` their ids as 32-bit integers."""
    names = [c.split()[0] for c in _PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4")
        for b in it:
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([encode(text.as_py()), end])
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    for col, x in zip(cols, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), part)):
                        col.append(x)
                if len(cols[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                    cols = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return id_and_text(docs).mapInArrow(cut, _PIECES + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids, so that windows can be put together."""
    cut = written(pieces(docs, path, end_id, window, with_ids).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == window).withColumns({"sequence_id": 2 * F.col("piece"), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    held = ["piece", "length"] if with_ids else ["piece", *_COLUMNS[:5]]

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        order = np.argsort(table.column("piece").to_numpy())  # the same windows if the task is run again
        piece = table.column("piece").to_numpy()[order]
        where, offset, n = best_fit_decreasing(table.column("length").to_numpy()[order], window)
        first = np.empty(n, np.int64)  # a window has the number of the piece that it begins with
        first[where[offset == 0]] = piece[offset == 0]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        table = table.append_column("sequence_id", pa.array(2 * first[where[back]] + 1))
        yield from table.append_column("offset", pa.array(offset[back])).to_batches(max_chunksize=20_000)

    schema = ", ".join(f"{c} bigint" for c in held) + ", sequence_id bigint, offset bigint"
    placed = rest.select(*held).repartition(groups, "piece").mapInArrow(packed, schema)
    if with_ids:
        placed = rest.join(placed.drop("length"), "piece")
    out = [*_COLUMNS, "ids"] if with_ids else [*_COLUMNS]
    return full.select(*out).unionByName(placed.select(*out))


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows, ids and padding of packed pieces; a window filled to a power of two is not padded."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    pad = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, 0).otherwise(window - F.col("used"))
    return used.agg(F.count("*").alias("windows"), F.sum("used").alias("ids"), F.sum(pad).alias("padding"))


def query(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path)
