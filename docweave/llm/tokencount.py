"""Token counts by a compiled finite-state tokenizer.

A BPE encoding is the one cut of a word in which every two neighbouring tokens
are an encoding of their own joined text.  So a word can be read from left to
right: a hypothesis is (last token that was completed, place in the trie of
tokens, tokens completed so far), and a state of the transducer is the set of
hypotheses that are still possible.  States become deterministic by
normalising the counts: what all hypotheses of a state have in common is
emitted on the transition that leads there.  A transition thus carries the
next state and an emitted-token count; the end-of-word symbol emits what is
left and leads back to the start.  States and transitions are compiled when
first needed, into dense tables of bounded size.

The words of a batch of texts form one stream of bytes, cut into chunks of
CHUNK bytes.  The map of a chunk takes the state before to the state after and
the tokens emitted.  From a chunk's first word end on the map is fixed, since
every state goes back to the start there.  A chunk inside a long word has no
word end; its map is held at the states that can occur: a guess (what a few
bytes before it lead to) and whatever its left neighbour's map yields, until
no neighbour yields a new one.  Maps then compose in a parallel prefix scan, by
pointer doubling.  All lanes run in lockstep.

Spans of at most SPAN bytes are counted one after the other, and the state at
a span's end is carried on.  If a span would need more than MAX_STATES states,
the tables are emptied and it is cut in half; what is known of pairs of tokens
stays, up to MAX_AGREEMENTS.

Defined results: a null or empty text has no bytes and no tokens; texts and
words of any length and script are counted whole; strings of special tokens
count one; repeated rows give repeated rows; other columns, whatever their
names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from .bpe import in_groups, vocabulary
from .common import PLAIN_TEXT, PLAIN_WORDS, id_and_text, map_texts

CHUNK = 512
LIMIT = 2048
#: Bytes that are counted together.
SPAN = 1 << 22
#: Bytes before a chunk that the guess of its entry state is made from.
WARM = 64
#: States of the compiled tables at most; at that number they are compiled anew.
MAX_STATES = 1 << 18
#: Known agreements of token pairs at most.
MAX_AGREEMENTS = 1 << 20
_END = 0x0A  # cannot be inside a word


class _Full(Exception):
    """The tables hold MAX_STATES states."""


class Transducer:
    """Deterministic automaton over word bytes, compiled on demand."""

    def __init__(self, path: str):
        self.v = v = vocabulary(path)
        # trie over the byte strings of tokens; a token may stand inside a word or at its end
        self.child: list[dict[int, int]] = [{}]
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        self.bytes_of: dict[int, bytes] = {}
        for name, token in v.vocab.items():
            at_end = bool(v.suffix) and name.endswith(v.suffix)
            letters = name[: -len(v.suffix)] if at_end else name
            try:
                raw = bytes(v.byte_of[c] for c in letters)
            except KeyError:
                continue
            if not raw or (len(raw) > 1 and token not in self._made):
                continue
            node = 0
            for b in raw:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.child[node][b]
            (self.final if at_end else self.inner)[node] = token
            self.bytes_of[token] = raw
        self.inner_agree: dict[tuple[int, int], bool] = {}
        self.final_agree: dict[tuple[int, int], bool] = {}
        self.rank = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(v.left, v.right, v.made))}
        self.reset()

    @functools.cached_property
    def _made(self) -> set[int]:
        return set(self.v.made.tolist())

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        #: column of each byte in the tables, given out as bytes are met
        self.column = np.full(256, -1, np.int64)
        self.byte: list[int] = []
        self.next = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int16)
        self.columns(np.array([_END]))
        self.start = self.state(((-1, 0, 0),))

    def columns(self, present: np.ndarray) -> None:
        """Give columns to bytes that have none yet."""
        for b in present[self.column[present] < 0].tolist():
            self.column[b] = len(self.byte)
            self.byte.append(b)
        while len(self.byte) > self.next.shape[1]:
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
            self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)], axis=1)

    def state(self, hypotheses: tuple) -> int:
        if hypotheses not in self.states:
            if len(self.sets) >= MAX_STATES:
                raise _Full
            n = self.states[hypotheses] = len(self.sets)
            self.sets.append(hypotheses)
            if n >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return self.states[hypotheses]

    def agree(self, a: int, b: int, at_end: bool) -> bool:
        """Whether tokens a, b (at the end of a word or not) are the encoding of their joined text."""
        if a < 0:
            return True
        known = self.final_agree if at_end else self.inner_agree
        if (a, b) not in known:
            if len(known) >= MAX_AGREEMENTS:
                known.clear()
            known[a, b] = self._encode(self.bytes_of[a] + self.bytes_of[b], at_end) == [a, b]
        return known[a, b]

    def _encode(self, raw: bytes, at_end: bool) -> list[int]:
        """Plain merging of a few bytes, lowest rank first, leftmost first."""
        seq = [int(self.v.inner[b]) for b in raw]
        if at_end:
            seq[-1] = int(self.v.final[raw[-1]])
        rank = self.rank
        while len(seq) > 1:
            best = min((rank[p] + (i,) for i, p in enumerate(zip(seq, seq[1:])) if p in rank), default=None)
            if best is None:
                break
            seq[best[2] : best[2] + 2] = [best[1]]
        return seq

    def step(self, state: int, column: int) -> None:
        """Compile one transition."""
        byte = self.byte[column]
        if byte == _END:
            ends = {n + 1 for p, node, n in self.sets[state] if (t := self.final[node]) >= 0 and self.agree(p, t, True)}
            if len(ends) != 1 and state != self.start:
                raise ValueError("a word has no or several encodings")
            self.next[state, column], self.emit[state, column] = self.start, min(ends, default=0)
            return
        out = []
        for p, node, n in self.sets[state]:
            if (to := self.child[node].get(byte)) is not None:
                out.append((p, to, n))
                if (t := self.inner[to]) >= 0 and self.agree(p, t, False):
                    out.append((t, 0, n + 1))
        if not out:
            raise ValueError("no token matches")
        least = min(n for _, _, n in out)
        to = self.state(tuple(sorted((p, node, n - least) for p, node, n in out)))
        self.next[state, column], self.emit[state, column] = to, least

    def run(self, states: np.ndarray, stream: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run stream[begin:end] of each lane from its state, in lockstep; exit states and counts."""
        n = len(begin)
        counts, exits = np.zeros(n, np.int64), states.copy()
        order = np.argsort(begin - end, kind="stable")  # longest first: lanes drop off at the tail
        at, state, count = begin[order], states[order], np.zeros(n, np.int64)
        length = (end - begin)[order]
        alive = n
        for k in range(int(length[0]) if n else 0):
            while alive and length[alive - 1] <= k:
                alive -= 1
            b, s = stream[at[:alive] + k], state[:alive]
            to = self.next[s, b]
            if (missing := to < 0).any():
                for pair in np.unique(s[missing].astype(np.int64) * 256 + b[missing]).tolist():
                    self.step(pair >> 8, pair & 255)
                to = self.next[s, b]
            count[:alive] += self.emit[s, b]
            state[:alive] = to
        exits[order], counts[order] = state, count
        return exits, counts

    def count(self, stream: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each piece stream[bounds[i]:bounds[i + 1]]; a piece ends with a word end or is empty."""
        sizes = np.diff(bounds)
        chunks = -(-sizes // CHUNK)
        piece = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = bounds[piece] + nth * CHUNK
        end = np.minimum(begin + CHUNK, bounds[piece + 1])
        breaks = np.flatnonzero(stream == _END) + 1
        total = np.zeros(len(piece), np.int64)
        at, most, carried = 0, max(1, SPAN // CHUNK), self.sets[self.start]
        while at < len(piece):
            to = slice(at, min(at + most, len(piece)))
            try:
                total[to], after = self._span(stream, begin[to], end[to], nth[to] > 0, breaks, self.state(carried))
            except _Full:
                self.reset()
                if to.stop - at > 1:
                    most = (to.stop - at) // 2
                elif len(self.states) == 1 and self._only_chunk_failed(at):
                    raise
                continue
            carried, at = self.sets[after], to.stop
            most = min(2 * most, max(1, SPAN // CHUNK))
        self._failed = -1
        return np.bincount(piece, total, len(sizes)).astype(np.int64)

    _failed = -1

    def _only_chunk_failed(self, at: int) -> bool:
        """Whether a chunk alone, in empty tables, was too much before."""
        again, self._failed = self._failed == at, at
        return again

    def _span(
        self, stream: np.ndarray, begin: np.ndarray, end: np.ndarray, inside: np.ndarray, breaks: np.ndarray, state: int
    ) -> tuple[np.ndarray, int]:
        """Tokens of each chunk, and the state after the last.

        ``inside`` says which chunks go on with the piece of the chunk before
        them; ``state`` is that before the first chunk, if it is such a one.
        """
        low = max(0, int(begin[0]) - WARM)
        used = np.unique(stream[low : int(end[-1])])
        self.columns(used)
        stream, base = self.column[stream[low : int(end[-1])]].astype(np.uint8), low
        begin, end = begin - base, end - base
        breaks = breaks[np.searchsorted(breaks, base + begin[0], side="right") :] - base
        n = len(begin)
        if len(breaks):
            sync = breaks[np.minimum(np.searchsorted(breaks, begin, side="right"), len(breaks) - 1)]
            sync = np.where(sync > begin, sync, end + 1)
        else:
            sync = end + 1
        sync = np.where(inside, sync, begin)  # a piece starts at the start state
        fixed = sync <= end
        start = np.full(n, self.start, np.int64)
        exits, total = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        lanes = np.flatnonzero(fixed)
        exits[lanes], total[lanes] = self.run(start[lanes], stream, sync[lanes], end[lanes])

        loose = np.flatnonzero(~fixed)
        if len(loose):
            self._compose(stream, begin, end, loose, exits, total, state)
        # what stands before the first word end, from the state before it
        head = np.flatnonzero(fixed & inside)
        before = np.where(head > 0, exits[head - 1], state)
        total[head] += self.run(before, stream, begin[head], sync[head])[1]
        return total, int(exits[-1])

    def _compose(
        self, stream: np.ndarray, begin: np.ndarray, end: np.ndarray, loose: np.ndarray, exits: np.ndarray, total: np.ndarray, state: int
    ) -> None:
        """Exits and totals of chunks without a word end, by a prefix scan over their maps."""
        is_loose = np.zeros(len(begin) + 1, bool)
        is_loose[loose] = True
        first = loose[~is_loose[loose - 1] | (loose == 0)]  # the first of each run of such chunks
        warm = np.maximum(begin[loose] - WARM, 0)
        guess = self.run(np.full(len(loose), self.start, np.int64), stream, warm, begin[loose])[0]
        entry = np.where(first > 0, exits[first - 1], state)
        wanted = sorted({*zip(loose.tolist(), guess.tolist()), *zip(first.tolist(), entry.tolist())})
        number: dict[tuple[int, int], int] = {}  # the maps: (chunk, state before) -> its place in the lists below
        after: list[int] = []
        counts: list[int] = []
        while wanted:
            chunk, before = (np.array(x, np.int64) for x in zip(*wanted))
            to, more = self.run(before, stream, begin[chunk], end[chunk])
            for key in wanted:
                number[key] = len(number)
            after += to.tolist()
            counts += more.tolist()
            follows = ((c + 1, s) for c, s in zip(chunk.tolist(), to.tolist()) if is_loose[c + 1])
            wanted = sorted({x for x in follows if x not in number})
        place = np.full(len(number), -1, np.int64)
        chunk_of = np.array([c for c, _ in number], np.int64)
        for (c, _), i in number.items():
            if is_loose[c + 1]:
                place[i] = number[c + 1, after[i]]
        # which entries occur: pointer doubling from the first chunk of each run
        live = np.zeros(len(number), bool)
        live[[number[x] for x in zip(first.tolist(), entry.tolist())]] = True
        step = place
        while (step >= 0).any():
            reached = step[live]
            live[reached[reached >= 0]] = True
            step = np.where(step >= 0, step[step], -1)
        on = np.flatnonzero(live)
        exits[chunk_of[on]] = np.array(after, np.int64)[on]
        total[chunk_of[on]] = np.array(counts, np.int64)[on]


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


#: Characters of text in one stream.
GROUP_CHARS = 8_000_000


def count_batch(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text."""
    t = transducer(path)
    special = t.v.special
    out: list[int] = []
    for part in in_groups(texts, GROUP_CHARS):
        raws, bounds, extra = [], [0], []
        for text in texts[part]:
            if PLAIN_TEXT.fullmatch(text) and not special.search(text):
                words, n = PLAIN_WORDS.findall(text.lower()), 0
                raw = ("\n".join(words) + "\n").encode() if words else b""
            else:
                parts = t.v.words(text)
                words = [w for w in parts if not isinstance(w, int)]
                n = len(parts) - len(words)
                raw = b"\n".join(words) + b"\n" if words else b""
            raws.append(raw)
            bounds.append(bounds[-1] + len(raw))
            extra.append(n)
        counts = t.count(np.frombuffer(b"".join(raws), np.uint8), np.array(bounds, np.int64))
        out += (counts + np.array(extra)).tolist()
    return out


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def rows(keys: list, texts: list) -> dict:
        tokens = count_batch(path, texts)
        return {
            "doc_id": keys,
            "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    return map_texts(id_and_text(docs), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", rows)


query = count
