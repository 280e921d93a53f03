"""WARC archives, top-k search, and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import topk, warc
from docweave.llm.common import shared_dir


@pytest.fixture()
def pages(spark, sf):
    real = spark.read.parquet(f"{sf}/pages.parquet").limit(20)
    rows = [(1001, "http://a\r\nb", "same é"), (1002, None, "same é"), (1003, "u", None), (1004, "u", ""), (None, "v", "same é"), (None, "w", "alone"), (1005, "x", "twice"), (1005, "x", "twice")]
    return real.unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_warc(spark, pages):
    root = shared_dir(spark, "warc-test")
    warc.write(pages, root)
    got = warc.read(spark, root).collect()
    assert len(got) == pages.count()
    rows = pages.collect()
    for r in got:
        html = next((p.html or "") for p in rows if p.page_id == r.page_id and base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode() == r.payload_digest)
        same = [p.page_id for p in rows if (p.html or "") == html and p.page_id is not None]
        best = max(same, default=None)
        assert r.payload_bytes == len(html.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == best else ("revisit", best))
    assert warc.payloads(spark, root).count() == len({p.html or "" for p in rows})
    for r in warc.records(spark, root).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        kind = head.partition(b"WARC-Type: ")[2].split(b"\r\n")[0]
        assert head.startswith(b"WARC/1.1\r\n") and kind in (b"response", b"revisit") and block.endswith(b"\r\n\r\n")
        length = int(head.partition(b"Content-Length: ")[2].split(b"\r\n")[0])
        assert length == len(block) - 4
        if kind == b"response":
            payload = block[:-4].partition(b"\r\n\r\n")[2]
            assert b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) in head


def test_warc_ids_and_columns(spark):
    """Rows that are equal in page_id and url have ids of their own; columns may clash with those of the archive."""
    rows = [(5, "u", "same", "s", 1)] * 3 + [(5, "u", "other", "s", 1), (2, "u", "same", "s", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string, n int")
    root = shared_dir(spark, "warc-test")
    warc.write(df, root)
    texts = [bytes(r.header).decode() for r in warc.headers(spark, root).collect()]
    ids = [t.partition("WARC-Record-ID: ")[2].split("\r\n")[0] for t in texts]
    assert len(set(ids)) == 5
    to = [t.partition("WARC-Refers-To: ")[2].split("\r\n")[0] for t in texts if "WARC-Refers-To: " in t]
    assert len(to) == 1 and to[0] in ids
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.read(spark, root).collect()) == [(2, "revisit", 5)] + [(5, "response", 0)] * 4


def test_the_archive_alone_is_read(spark, pages):
    """Another session knows the files only; a changed byte is noticed."""
    root = shared_dir(spark, "warc-test")
    warc.write(pages, root)
    first = sorted(map(str, warc.read(spark, root).collect()))
    warc.forget(spark, root)
    assert sorted(map(str, warc.read(spark, root).collect())) == first
    joined = warc.records(spark, root)
    bad = joined.withColumn("record", F.concat("record", F.lit("x").cast("binary")))
    with pytest.raises(Exception, match="has not the length"):
        warc.parsed(bad).collect()


def test_warc_empty(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _by_force(rows, k=10):
    clean = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in clean), default=0)
    ints = [np.floor(1024.0 * np.array([*v, *[0.0] * (width - len(v))])).astype(int) for _, v in clean]
    out = []
    for a, (i, _) in enumerate(clean):
        if i is not None and i % 100 == 0:
            best = sorted((-int(ints[a] @ ints[b]), j is None, j) for b, (j, _) in enumerate(clean) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, _, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 12)) * rng.choice([0.01, 1, 30], size=(900, 1))
    vectors[10:60] = vectors[5]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(901, None), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0]), (1000, [float("inf")] * 12), (7, [0.5] * 12), (100, rows[100][1]), (1100, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.query(df).collect())
    assert got == _by_force(rows)


def test_topk_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.query(spark.createDataFrame([], schema)).count() == 0
    assert topk.query(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk.query(spark.createDataFrame([(0, [1.0]), (5, [-2.0])], schema)).collect()] == [(0, 1, 5, -2097152)]


def test_stopping_is_proved():
    rng = np.random.default_rng(8)
    comps = rng.integers(-500, 500, size=(3000, 20))
    comps[:, 0] *= 20  # one dimension decides most
    index = topk.ImpactIndex(np.arange(3000), comps)
    for _ in range(20):
        q = rng.integers(-500, 500, size=20)
        rows, scores = index.search(q, 10)
        full = comps @ q
        assert rows.tolist() == np.lexsort((np.arange(3000), -full))[:10].tolist() and (full[rows] == scores).all()


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from docweave.llm import ordermin, pii, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.run(spark, sf)
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, t in rows.items() if not (f := quality.Figures(t)).base_failed and quality.cascade(f, list(quality.RULES))[0]}
    classes = {r.doc_id: r.class_id for r in ordermin.query(docs.where(docs.doc_id.isin(list(good)))).collect()}
    model, cut = pii.fit()
    left = {i: rows[i] for i in good if classes[i] == i}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(left)
    from docweave.llm.packing import encoder
    import public_tokenizers

    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(encode(pii.redacted(t, pii.select([t], model, cut)[0][1]))) + 1 for i, t in left.items()}
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == tokens
    for r in out.where("length > 0").limit(50).collect():
        whole = encode(pii.redacted(left[r.doc_id], pii.select([left[r.doc_id]], model, cut)[0][1])).tolist() + [0]
        assert list(r.ids) == whole[r.start : r.start + r.length]
    assert [name for name, _ in p.STAGES] == ["quality_rules", "near_dedup", "redact_pii", "pack"]


def test_pipeline_odd(spark, tmp_path):
    """Null ids and texts, repeats, a very long text, clashing columns; and an empty table."""
    import corpus_pipeline as p

    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9000, n))
    a, b, long = prose(80), prose(90), prose(60_000)
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, None), (4, ""), (5, long), (6, "short")]
    schema = "doc_id long, text string, sequence_id string, n_words int, ids string"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = p.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in got} == {1, None, 5} and len([r for r in got if r.start == 0]) == 3
    assert sum(r.length for r in got if r.doc_id == 5) == next(r.doc_tokens for r in got if r.doc_id == 5) > 60_000
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
