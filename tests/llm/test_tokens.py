"""Packing, BPE, token counts and shards against the library."""

import hashlib
import io
import os
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from docweave.llm import bpe, packing, sstable, tokencount
from docweave.llm.common import arrow_uri, shared_dir, tokenizer


def library(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def _both(docs, odd):
    return docs.select("doc_id", "text").limit(40).unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text"))


def test_bpe(docs, odd, nothing, word_bpe):
    df = _both(docs, odd)
    text = {r.doc_id: r.text for r in df.collect()}
    rows = bpe.query(df, word_bpe).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = library(word_bpe, text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        whole = tokenizer(word_bpe).decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert bpe.query(nothing, word_bpe).count() == 0
    for r in bpe.decoded(bpe.encode(df, word_bpe), word_bpe).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids) and r.text == tokenizer(word_bpe).decode(ids, skip_special_tokens=False)
    assert bpe.decode(np.array([10**6, 5], "<u4"), word_bpe) == bpe.decode(np.array([5], "<u4"), word_bpe)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aehinorst", min_size=1, max_size=12), min_size=1, max_size=30))
def test_bpe_and_transducer_on_any_words(words):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(words)
    ids = library(path, text)
    assert [int(x) for x in np.frombuffer(next(bpe.encode_batch(path, [text]))[0], "<u4")] == ids
    assert tokencount.count_batch(path, [text]) == [len(ids)]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = library(path, text)
    assert [int(x) for x in np.frombuffer(next(bpe.encode_batch(path, [text]))[0], "<u4")] == ids
    assert tokencount.count_batch(path, [text]) == [len(ids)]
    assert [int(x) for x in np.frombuffer(sstable.encoder(path)(text), "<u4")] == ids
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(other)(text).tolist() == library(other, text)


def test_bpe_in_sections_and_lots(word_bpe, monkeypatch):
    """Whatever is encoded together, and whenever the store starts anew: the library's ids."""
    rng = random.Random(7)
    parts = ["a", "é", "e\u0301", " ", "\n", "\t", "\u3000", "'s", "Σ", "你", "<|endoftext|>", "<|end", "1", "...", "words", "\u0301"]
    texts = ["", "no-white-space" * 30, " " * 90, *("".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(300))]
    want = [library(word_bpe, t) for t in texts]
    for words, size, lot, group, section in ((50, 1 << 20, 40, 2000, 16), (10**6, 200, 1, 1, 1), (10**6, 1 << 20, 10**6, 10**6, 50)):
        for name, value in zip(("KEPT_WORDS", "KEPT_BYTES", "LOT_BYTES", "GROUP_CHARS", "SECTION_CHARS"), (words, size, lot, group, section)):
            monkeypatch.setattr(bpe, name, value)
        store = bpe.WordStore(word_bpe)
        monkeypatch.setattr(bpe, "word_store", lambda path: store)
        assert [x.tolist() for x in bpe.encode_texts(word_bpe, iter(texts))] == want
        assert len(store.numbers) <= words + 200
        assert [bpe.decode(np.array(i, "<u4"), word_bpe) for i in want] == [tokenizer(word_bpe).decode(i, skip_special_tokens=False) for i in want]
        assert all("".join(bpe.sections(t)) == t for t in texts)


def test_bpe_memory(docs, word_bpe):
    """One Python worker a task, and little held in it beside the texts: for many texts, for a long one, for new words."""
    plan = bpe.query(docs, word_bpe)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rng = random.Random(11)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(2000)]
    many = [" ".join(rng.choices(names, k=400)) for _ in range(2500)]
    new = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1000)) for _ in range(1000)]
    bpe.word_store.cache_clear()
    next(bpe.encode_batch(word_bpe, [" ".join(names)]))
    peaks = []
    for texts in (many, [" ".join(many)], new):
        tracemalloc.start()
        for _ in bpe.encode_batch(word_bpe, texts):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1] / sum(map(len, texts)))
        tracemalloc.stop()
    print(f"bytes held at most for a character of many texts, of a long one, of new words: {peaks}")
    assert peaks[0] < 4 and peaks[1] < 10 and peaks[2] < 55  # 7.7, 25.8 and 70.9 with lists of words


def test_counts(docs, odd, nothing, word_bpe):
    df = _both(docs, odd)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    rows = tokencount.query(df, word_bpe).collect()
    assert len(rows) == df.count()
    for r in rows:
        n = len(library(word_bpe, text[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 2048)
    assert tokencount.query(nothing, word_bpe).count() == 0


def test_chunk_maps_compose(word_bpe, monkeypatch):
    texts = ["thing " * 200 + "supercalifragilistic" * 40 + " end", "a", "", "ab " * 700]
    want = [len(library(word_bpe, t)) for t in texts]
    for size in (7, 64, 4096):
        monkeypatch.setattr(tokencount, "CHUNK", size)
        assert tokencount.count_batch(word_bpe, texts) == want


def test_chunks_inside_long_words(word_bpe, monkeypatch):
    """Words of many chunks without an end: random letters, one letter, and patterns out of step with the chunks."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000)), "a" * 9001, "abc" * 3000, "ha" * 4000 + "z", "=" * 7000, "é" * 3000]
    texts = [f"so {w} it {w[:700]}" for w in words] + words
    want = [len(library(word_bpe, t)) for t in texts]
    for chunk, span in ((512, 1 << 20), (128, 1000), (64, 1 << 14)):
        monkeypatch.setattr(tokencount, "CHUNK", chunk)
        monkeypatch.setattr(tokencount, "SPAN", span)
        assert tokencount.count_batch(word_bpe, texts) == want


def test_transducer_starts_anew_when_full(word_bpe, monkeypatch, docs):
    """The tables never hold more states than they may, whatever is counted."""
    t = tokencount.Transducer(word_bpe)
    monkeypatch.setattr(tokencount, "transducer", lambda path: t)
    monkeypatch.setattr(tokencount, "MAX_STATES", 3000)
    rng = random.Random(3)
    texts = [r.text for r in docs.select("text").limit(40).collect()] + ["".join(rng.choices("abcdefghij", k=30_000))]
    most, grow = 0, t.state
    def state(hypotheses):
        nonlocal most
        n = grow(hypotheses)
        most = max(most, len(t.sets))
        return n
    monkeypatch.setattr(t, "state", state)
    assert tokencount.count_batch(word_bpe, texts) == [len(library(word_bpe, x)) for x in texts]
    assert 1000 < most <= 3000 and len(t.inner_agree) <= tokencount.MAX_AGREEMENTS


def test_very_long_word(word_bpe):
    rng = random.Random(5)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    began = time.perf_counter()
    n = tokencount.count_batch(word_bpe, [word])[0]
    seconds = time.perf_counter() - began
    print(f"a word of 300 kB: {n} tokens in {seconds:.0f} s, {len(tokencount.transducer(word_bpe).sets)} states")
    parts = len(library(word_bpe, word[:60_000]))
    assert abs(n - 5 * parts) < 0.02 * n and seconds < 120


def test_packing(docs, odd, nothing, byte_bpe):
    df = _both(docs, odd.dropDuplicates(["doc_id"]))
    ids = {r.doc_id: np.array(library(byte_bpe, r.text) + [0], "<u4") for r in df.collect()}
    rows = packing.query(df, byte_bpe).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == len(ids[d]) and [s for s, _ in sorted(pieces)] == list(np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1])
    assert set(by_doc) == set(ids)
    for pieces in by_window.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1]) and sum(n for _, n in pieces) <= 1024
    assert packing.query(nothing, byte_bpe).count() == 0


@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing(lengths):
    where, offset, n = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # the plain way: look at every open window
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(64 - lengths[i])
    used = np.bincount(where, lengths, n).astype(int) if lengths else np.array([])
    assert sorted(64 - used) == sorted(room) and not want
    for w in range(n):
        at = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
        assert all(a + x == b for (a, x), (b, _) in zip(at, at[1:])) and at[0][0] == 0


def test_little_padding(docs, byte_bpe):
    p = packing.padding(packing.query(docs, byte_bpe)).first()
    assert p.padding < 0.02 * p.ids


def test_little_padding_over_many_partitions(docs, byte_bpe):
    shares = []
    for n in (1, 211):
        p = packing.padding(packing.query(docs.repartition(n), byte_bpe)).first()
        shares.append(p.padding / p.ids)
    print(f"padding at 1 and 211 partitions: {shares}")
    assert max(shares) < 0.01


def test_windows_with_ids(spark, docs, odd, byte_bpe):
    """The same windows with and without ids, and the documents come back from them; repeated rows count each."""
    df = docs.select("doc_id", "text").limit(60).unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text")).repartition(7)
    df = spark.createDataFrame(df.collect(), df.schema)
    plain = packing.pack(df, byte_bpe).collect()
    full = packing.pack(df, byte_bpe, with_ids=True).collect()
    assert sorted(r[:7] for r in full) == sorted(tuple(r) for r in plain)
    for r in full:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    want = sorted(len(library(byte_bpe, r.text)) + 1 for r in df.collect())
    assert sum(want) == sum(r.length for r in plain) and len(plain) >= len(want)
    assert sorted(r.doc_tokens for r in plain if r.start == 0) == want
    used = {}
    for r in sorted(plain, key=lambda r: r.offset):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024


def test_bloom_filter_and_many_keys(spark, word_bpe, monkeypatch):
    monkeypatch.setattr(sstable, "BLOOM_KEYS", 16)
    monkeypatch.setattr(sstable, "_BLOOM_BITS", 160)
    out = io.BytesIO()
    w = sstable.ShardWriter(out, 2)
    for i in range(0, 2000, 2):
        w.add(sstable.key_of(i), np.array([i], "<u4"))
    w.finish()
    path = f"{shared_dir(spark, 'bloom').removeprefix('file://')}.sst"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(out.getvalue())
    shard = sstable.Shard(f"file://{path}")
    assert all(shard.get(i)[0].tolist() == [i] for i in range(0, 2000, 2)) and not any(shard.get(i) for i in range(-5, 2005, 2))
    assert np.mean([shard.may_hold(sstable.key_of(i)) for i in range(1, 2000, 2)]) < 0.05
    assert len(w.blooms) == 63


def test_uris_of_object_stores():
    assert arrow_uri("s3a://b/k") == "s3://b/k" and arrow_uri("abfss://c@a/x") == "abfss://c@a/x" and arrow_uri("file:///x") == "file:///x"


def test_shards(spark, docs, odd, nothing, word_bpe):
    df = _both(docs, odd).unionByName(spark.createDataFrame([(None, "no id"), (-5, "below zero")], "doc_id long, text string"))
    manifest = sstable.write(df, word_bpe, 1, shared_dir(spark, "sst-test"))
    rows = sstable.read(spark, manifest, with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i or 0))
    text, at = {}, 0
    for r in df.collect():
        text.setdefault(r.doc_id, []).append(library(word_bpe, r.text) + [1])
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and list(r.ids) in text[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    for i in (-5, None, 3, 100005):
        assert sorted(x.tolist() for x in sstable.lookup(manifest, i)) == sorted(text[i])
    assert sstable.lookup(manifest, 77_777) == []
    assert sstable.query(nothing, word_bpe).count() == 0


def test_a_damaged_block_is_noticed(spark, docs, word_bpe, tmp_path):
    manifest = sstable.write(docs.limit(20), word_bpe, 1, f"file://{tmp_path}")
    path = manifest[0].uri.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[10] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(sstable.Shard(manifest[0].uri).records(0))
