"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Components are integers.  Each partition of vectors is one index: for every
dimension the postings (vector, component) are kept in segments by quantised
impact, the absolute component in LEVELS steps.  A query processes segments of
all dimensions in descending |query component| * impact and adds what they
contribute to its accumulators.

After every few segments the bounds are looked at: what has not been processed
can add at most the sum over dimensions of the largest contribution left
there, and take away at most the same of the smallest.  The k-th best lower
bound is a proof for every vector whose upper bound is below it.  Processing
stops only once those proofs leave few possible members, or nothing is left;
possible members are then scored exactly.

Queries are a stated set that grows with the vectors: they are written once to
the shared folder and streamed from there in blocks of QUERY_BLOCK, so no task
holds all of them; each partition sends k + 1 rows a query to the merge.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; vectors of different lengths are compared as if padded with
zeros; of rows that repeat a vec_id only the query's own row is left out;
scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_dir

LEVELS = 8
QUERY_BLOCK = 256
#: Vectors of one index, about; a larger partition is several indexes.
INDEX_ROWS = 20_000
#: Bounds are looked at that often in the course of a query.
LOOKS = 16


def integers(vectors: list[list[float]]) -> np.ndarray:
    """floor(1024 x) of each component, in one padded matrix."""
    return matrix(pa.array(vectors, pa.list_(pa.float64())))[1]


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and the integer components of those in one padded matrix."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # without null lists; null components are NaN
    ends = np.cumsum(lengths)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    part = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    width = int(lengths[part].max(initial=0))
    out = np.zeros((int(part.sum()), width), np.int64)
    if width:
        inside = np.arange(width) < lengths[part][:, None]
        out[inside] = np.floor(1024.0 * values[np.repeat(part, lengths)])
    return part, out


def _widened(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


class ImpactIndex:
    def __init__(self, ids: np.ndarray, comps: np.ndarray):
        """``ids`` ascending; ``comps`` the integer components, one row a vector."""
        self.ids, self.comps = ids, comps
        self.n, self.width = comps.shape
        impact = np.abs(comps)
        top = np.maximum(impact.max(axis=0, initial=0), 1)
        level = np.minimum(impact * LEVELS // top, LEVELS - 1)
        self.segments: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        #: largest and smallest component in levels up to each level, by dimension
        self.high = np.zeros((self.width, LEVELS + 1), np.int64)
        self.low = np.zeros((self.width, LEVELS + 1), np.int64)
        for d in range(self.width):
            column = comps[:, d]
            order = np.argsort(level[:, d], kind="stable")
            cuts = np.searchsorted(level[order, d], np.arange(LEVELS + 1))
            for k in range(LEVELS):
                members = order[cuts[k] : cuts[k + 1]]
                values = column[members]
                self.high[d, k + 1] = max(self.high[d, k], values.max(initial=0))
                self.low[d, k + 1] = min(self.low[d, k], values.min(initial=0))
                if len(members):
                    self.segments.append((d, k, members, values))
        self.seg_dim = np.array([s[0] for s in self.segments], np.int64)
        self.seg_level = np.array([s[1] for s in self.segments], np.int64)
        self.seg_impact = np.array([np.abs(s[3]).max() for s in self.segments], np.int64)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best, ties to smaller ids."""
        width = min(self.width, len(query))
        q = np.zeros(self.width, np.int64)
        q[:width] = query[:width]
        if self.n > k:
            rows = self._possible(q, k)
        else:
            rows = np.arange(self.n)
        scores = self.comps[rows] @ q
        best = np.lexsort((rows, -scores))[:k]  # rows are in the order of ids
        return rows[best], scores[best]

    def _possible(self, q: np.ndarray, k: int) -> np.ndarray:
        """Vectors that no proof excludes from the k best."""
        weight = self.seg_impact * np.abs(q[self.seg_dim])
        order = np.argsort(-weight, kind="stable")
        acc = np.zeros(self.n, np.int64)
        left = np.full(self.width, LEVELS)  # levels below this one are still to come
        few = max(8 * k, self.n // 8)
        step = max(1, len(order) // LOOKS)
        possible = np.arange(self.n)
        for at in range(0, len(order), step):
            for s in order[at : at + step].tolist():
                d, level, members, values = self.segments[s]
                acc[members] += q[d] * values
                # weights fall with the level inside a dimension, so levels go from the top
                left[d] = level
            dims = np.arange(self.width)
            ends = np.stack([q * self.high[dims, left], q * self.low[dims, left]])
            above, below = int(ends.max(axis=0).clip(min=0).sum()), int(ends.min(axis=0).clip(max=0).sum())
            sure = np.partition(acc, self.n - k)[self.n - k] + below
            possible = np.flatnonzero(acc + above >= sure)
            if len(possible) <= few:
                break
        return possible


def _clean(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """Ids and components of the rows that take part."""
    part, comps = matrix(batch.column("embedding"))
    return batch.column("vec_id").filter(pa.array(part)).to_pylist(), comps


def _query_blocks(uri: str) -> Iterator[tuple[int, list, np.ndarray]]:
    """(number of the first query, ids, components) of each block, in the same order in every task."""
    fs, path = filesystem(uri)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
    first = 0
    for file in files:
        for batch in pads.dataset(file, filesystem=fs, format="parquet").to_batches(batch_size=QUERY_BLOCK):
            if batch.num_rows:
                ids, comps = _clean(batch)
                yield first, ids, comps
                first += len(ids)


_LOCAL = "q long, query_id long, vec_id long, score long, own boolean"


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding.  A row of ``vectors`` that equals the query
    in both is taken for the query's own row, once.
    """
    uri = shared_dir(vectors.sparkSession, "queries")
    queries.select("vec_id", "embedding").where("embedding IS NOT NULL").write.parquet(uri)

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(ids: list, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            ids = [ids[i] for i in order]
            index = ImpactIndex(np.arange(len(ids)), rows[order])
            for first, query_ids, comps in _query_blocks(uri):
                out: list[tuple] = []
                for j, (query_id, query) in enumerate(zip(query_ids, comps)):
                    found, scores = index.search(query, k + 1)
                    for r, s in zip(found.tolist(), scores.tolist()):
                        own = ids[r] == query_id and _equal(index.comps[r], query)
                        out.append((first + j, query_id, ids[r], s, own))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)],
                        names=["q", "query_id", "vec_id", "score", "own"],
                    )

        held_ids: list = []
        held: list[np.ndarray] = []
        for b in it:
            ids, rows = _clean(b)
            held_ids += ids
            held.append(rows)
            if len(held_ids) >= INDEX_ROWS:
                yield from answers(held_ids, _widened(held))
                held_ids, held = [], []
        if held_ids:
            yield from answers(held_ids, _widened(held))

    best = vectors.select("vec_id", "embedding").mapInArrow(local, _LOCAL)
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    of_query = Window.partitionBy("q")
    one_own = F.row_number().over(Window.partitionBy("q", "own").orderBy(*order))
    return (
        best.withColumn("nth", one_own)
        .where(~F.col("own") | (F.col("nth") > 1))
        .withColumn("rank", F.row_number().over(of_query.orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _equal(a: np.ndarray, b: np.ndarray) -> bool:
    n = min(len(a), len(b))
    return bool((a[:n] == b[:n]).all() and not a[n:].any() and not b[n:].any())


def query(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    return search(embeddings, embeddings.where(F.col("vec_id") % every == 0), k)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
