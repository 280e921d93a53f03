"""BPE encoding by a pair-occurrence index, and decoding.

The distinct words that a partition has not met before lie end to end in one
symbol array with links to the left and right neighbour.  An index maps every
adjacent pair that the vocabulary can merge, by its rank, to all positions
where the pair stands.  Active ranks are taken in ascending order; a rank is
applied at all of its positions at once, and only the lists of the pairs next
to the merged positions are changed.  Finished words are kept, so a word is
encoded once per Python worker while the (bounded) store holds it.

Beside the Arrow batch that comes in, memory does not grow with the partition
or its distinct words: a text is held as the numbers of its words in the store,
4 bytes a word, new words are encoded when LOT_BYTES of them wait, and rows
leave in batches of about OUT_CHARS.  Longer texts are split and encoded in
sections that end before a space or a newline; only a stretch without one and
the row itself are held whole.

The order by rank over all words is each word's own order as long as a merge
ranks after the merges that build its two parts; the loader checks that.

Defined results: a null text is an empty one and has no tokens; texts of any
length and script are encoded whole; the strings of special tokens inside a
text become those tokens, as in the library; repeated rows give repeated rows;
other columns, whatever their names, are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_TEXT, PLAIN_WORDS, byte_letters, id_and_text, tokenizer

#: Encoded words that one Python worker keeps, and their bytes; at either it starts anew.
KEPT_WORDS = 400_000
KEPT_BYTES = 16 << 20
#: Bytes of new words that are encoded together, about.
LOT_BYTES = 2 << 20
#: Characters of the texts whose word numbers are held, and of a section of a long text, about.
GROUP_CHARS = 16_000_000
SECTION_CHARS = 1 << 18
#: Characters of text that leave in one batch, about.
OUT_CHARS = 2_000_000


class WordVocabulary:
    """Vocabulary, merges and word splitting of a BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = max(self.vocab.values()) + 1
        self.size = n
        self.left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([self.vocab[b] for _, b in merges], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        born = np.full(n, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge ranks before the merges of its parts")
        keys = self.left * n + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int32)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        names = dict(zip(self.vocab.values(), self.vocab)) | {i: s for s, i in self.specials.items()}
        #: string of each id, None where there is none
        self.names = np.array([names.get(i) for i in range(max(names) + 1)], object)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        out = np.empty(len(a), np.int32)
        for i in range(0, len(a), 1 << 18):
            key = a[i : i + (1 << 18)].astype(np.int64) * self.size + b[i : i + (1 << 18)]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[i : i + (1 << 18)] = np.where(self.keys[at] == key, self.by_key[at], -1)
        return out

    def words(self, text: str) -> list[bytes | int]:
        """The text as words in UTF-8, an int for each special token."""
        if PLAIN_TEXT.fullmatch(text) and not self.special.search(text):
            return [w.encode() for w in PLAIN_WORDS.findall(text.lower())]
        out: list[bytes | int] = []
        at = 0
        for m in [*self.special.finditer(text), None]:
            out += self._split(text[at : m.start() if m else len(text)])
            if m:
                out.append(self.specials[m[0]])
                at = m.end()
        return out

    def _split(self, text: str) -> list[bytes]:
        if not text:
            return []
        tok, byte_of = tokenizer(self.path), self.byte_of
        pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))
        return [bytes(byte_of[c] for c in piece) for piece, _ in pieces]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)


def encode_words(v: WordVocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of non-empty words end to end, and their number in each word; all words at once by the pair index."""
    if not words:
        return np.array([], np.int32), np.array([], np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    sym = v.inner[raw]
    sym[ends - 1] = v.final[raw[ends - 1]]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[ends - lens] = -1

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def file(at: np.ndarray) -> None:
        """Enter the pairs that start at these positions."""
        rank = v.ranks(sym[at], sym[nxt[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            groups, heads = np.split(at, cuts), [int(rank[0]), *rank[cuts].tolist()]
        else:
            groups, heads = [at], [int(rank[0])]
        for r, g in zip(heads, groups):
            if r in index:
                index[r].append(g)
            else:
                index[r] = [g]
                heapq.heappush(active, r)

    file(np.flatnonzero(nxt >= 0).astype(np.int32))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, made = v.left[r], v.right[r], v.made[r]
        right = nxt[at]
        live = (sym[at] == a) & (right >= 0) & (sym[right] == b)
        if not live.all():
            at = at[live]
            if not len(at):
                continue
        if a == b and len(at) > 1:  # runs of the same symbol pair up from the left
            at = np.sort(at)
            taken, used = [], -1
            for p in at.tolist():
                if p != used:
                    taken.append(p)
                    used = int(nxt[p])
            at = np.array(taken, np.int32)
        right = nxt[at]
        after = nxt[right]
        sym[at] = made
        sym[right] = -1
        nxt[at] = after
        inside = after >= 0
        prv[after[inside]] = at[inside]
        before = prv[at]
        changed = np.concatenate([before[before >= 0], at[inside]])
        if len(changed):
            file(np.unique(changed) if len(changed) > 1 else changed)

    keep = sym >= 0
    return sym[keep], np.add.reduceat(keep, ends - lens, dtype=np.int64)


class Numbers(dict):
    """word -> its number, in the order of first sight; words that are not encoded yet wait."""

    def __init__(self):
        self.waiting: list[bytes | int] = []
        self.waiting_bytes = self.bytes = 0

    def __missing__(self, word: bytes | int) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        self.waiting_bytes += 1 if isinstance(word, int) else len(word)
        return n


class WordStore:
    """Words by number, and the ids of all of them end to end."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.flat, self.start, self.count = np.array([], "<u4"), np.array([], np.int64), np.array([], np.int64)

    def full(self) -> bool:
        return len(self.numbers) > KEPT_WORDS or self.numbers.bytes > KEPT_BYTES

    def number(self, text: str) -> np.ndarray:
        """The text's words by number; ``ids`` takes them after ``encode``, until ``clear``."""
        words = self.v.words(text)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))

    def encode(self) -> None:
        """Encode the words that wait."""
        new = self.numbers
        if not new.waiting:
            return
        lens = np.fromiter((0 if isinstance(w, int) else len(w) for w in new.waiting), np.int64, len(new.waiting))
        flat, count = encode_words(self.v, [w for w in new.waiting if not isinstance(w, int)])
        counts = np.ones(len(lens), np.int64)
        counts[lens > 0] = count
        ids = np.empty(counts.sum(), "<u4")
        ids[np.repeat(lens > 0, counts)] = flat
        ids[np.repeat(lens == 0, counts)] = [w for w in new.waiting if isinstance(w, int)]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids])
        new.bytes += new.waiting_bytes
        new.waiting, new.waiting_bytes = [], 0

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        n = self.count[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[numbers] - ends + n, n) + np.arange(n.sum())]


@functools.lru_cache(maxsize=2)
def word_store(path: str) -> WordStore:
    return WordStore(path)


def in_groups(texts: list[str], size: int = GROUP_CHARS):
    """Slices of a batch of about ``size`` characters; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def sections(text: str) -> Iterator[str]:
    """The text in parts of about SECTION_CHARS that end before a space or a newline.

    No word or special token holds one, and what stands before one is
    normalised and split without regard to what follows.
    """
    at = 0
    while len(text) - at > SECTION_CHARS:
        end = at + SECTION_CHARS
        cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
        if cut < 0:
            cut = min((c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_texts(path: str, texts: Iterable[str]) -> Iterator[np.ndarray]:
    """Ids of each text, in order; texts are taken ahead of what is returned, by about GROUP_CHARS at most."""
    store = word_store(path)
    begun: deque[list[np.ndarray]] = deque()  # sections of each text
    waits: list[tuple[list, int]] = []  # those that are numbers still
    size = 0

    def settle() -> None:
        nonlocal size
        store.encode()
        for parts, i in waits:
            parts[i] = store.ids(parts[i])
        waits.clear()
        size = 0
        if store.full():
            store.clear()

    for text in texts:
        begun.append(parts := [])
        for section in sections(text):
            waits.append((parts, len(parts)))
            parts.append(store.number(section))
            size += len(section) + 64
            if size >= GROUP_CHARS or store.numbers.waiting_bytes >= LOT_BYTES:
                settle()
        while not waits and begun:
            done = begun.popleft()
            yield done[0] if len(done) == 1 else np.concatenate(done)
    settle()
    for done in begun:
        yield done[0] if len(done) == 1 else np.concatenate(done)


def encode_batch(path: str, texts: Iterable[str]) -> Iterator[tuple[bytes, int]]:
    """(ids as bytes, number of ids) of each text."""
    for ids in encode_texts(path, texts):
        yield ids.tobytes(), len(ids)


_ENCODED = "doc_id bigint, ids binary, n_tokens bigint"


def _encode(docs: DataFrame, path: str, with_text: bool) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: deque = deque()

        def texts() -> Iterator[str]:
            for b in it:
                keys.extend(b.column(0).to_pylist())
                yield from (t.as_py() for t in b.column(1))

        def batch(rows: list) -> pa.RecordBatch:
            names, types = ["doc_id", "ids", "n_tokens", "text"], [pa.int64(), pa.binary(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: len(rows[0])])

        rows, size = [], 0
        for ids, n in encode_batch(path, texts()):
            rows.append((keys.popleft(), ids, n, decode(ids, path)) if with_text else (keys.popleft(), ids, n))
            size += 4 * n + 64
            if size >= OUT_CHARS:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return id_and_text(docs).mapInArrow(batches, _ENCODED + ", text string" * with_text)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and n_tokens."""
    return _encode(docs, path, False)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``decoded(encode(docs))``, in one Python worker instead of two."""
    return _encode(docs, path, True)


def decode(ids: bytes | np.ndarray, path: str) -> str:
    """The library's decoding of ids: this vocabulary has no decoder, so token strings stand apart.

    Ids that the vocabulary does not know are left out.
    """
    names = vocabulary(path).names
    seq = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)
    out = []
    for i in range(0, len(seq), SECTION_CHARS):
        part = seq[i : i + SECTION_CHARS]
        known = names[part[part < len(names)]].tolist()
        known = known if None not in known else [x for x in known if x is not None]
        if known:
            out.append(" ".join(known))
    return " ".join(out)


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with a column ``text``, decoded from their ids alone."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [decode(i.as_py(), path) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return encoded.mapInArrow(rows, _ENCODED + ", text string")


def query(docs: DataFrame, path: str) -> DataFrame:
    """Digests of every document's ids, and of the text that is decoded from them."""
    return round_trip(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
