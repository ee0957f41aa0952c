"""Exact top-k inner products by norm-bucketed retrieval (LEMP).

Vectors are range-partitioned by length into buckets of similar length. A
query's running k-th best score ``theta`` (first taken from the longest
vectors) gives a local cosine threshold in each bucket, ``theta / (|q| *
longest)``:

* over 1: no vector of the bucket can be among the best, it is skipped;
* ``COORDINATE_FROM`` or more: *coordinate pruning*, a vector must lie within
  an angle of the query, which bounds each of its normalised coordinates; the
  sorted lists of a few focus coordinates give the candidates;
* below: *length pruning*, only vectors of length ``theta / |q|`` or more.

What is left is verified by exact products. Queries and buckets meet in the
cells of a grid, each a bounded block of both; a task streams the buckets of
its cell, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentrec.llm.common import shuffle_partitions, stored
from latentrec.llm.vectors import QUERY_GROUP, best, clean_vectors, grid, matrix, query_blocks

SCALE = 256
BUCKET = 1_024  # vectors of a bucket, at most
SEEDS = 512  # long vectors that give the first thresholds
COORDINATE_FROM = 0.7
FOCUS = 3
EXACT = 2**53
EPS = 1e-9


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number rows (float64 as far as it is exact)."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if q.shape[1] * np.abs(q).max() * np.abs(p).max() < EXACT:
        return (q @ p.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in p], object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)  # beyond 64 bits a score is the end of the range


class Bucket:
    """Vectors by falling length, with the sorted lists of normalised coordinates."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray):
        norm = np.sqrt((mat * mat).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.mat, self.norm = ids[order], mat[order], norm[order]
        self.lists: np.ndarray | None = None

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        if self.lists is None:
            unit = self.mat / np.maximum(self.norm, 1e-300)[:, None]
            self.lists = unit.argsort(0, kind="stable")
            self.values = np.take_along_axis(unit, self.lists, 0)
        return self.values, self.lists

    def near(self, unit_q: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose angle to the query can have that cosine, by focus coordinates."""
        values, lists = self.coordinates()
        reach = np.arccos(min(1.0, cosine))
        found = None
        for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
            mid = np.arccos(np.clip(unit_q[f], -1, 1))
            low, high = np.cos(min(np.pi, mid + reach)) - EPS, np.cos(max(0.0, mid - reach)) + EPS
            rows = lists[np.searchsorted(values[:, f], low, "left") : np.searchsorted(values[:, f], high, "right"), f]
            found = rows if found is None else found[np.isin(found, rows, assume_unique=True)]
            if len(found) < 8:
                break
        return found


class Best:
    """Running best scores of a block of queries."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int):
        self.ids, self.mat, self.k = ids, mat, k
        self.norm = np.sqrt((mat * mat).sum(1))
        self.unit = mat / np.maximum(self.norm, 1e-300)[:, None]
        self.theta = np.full(len(ids), -np.inf)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def offer(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.theta[i]) & (ids != self.ids[i])
        if not keep.any():
            return
        s = np.concatenate([self.found[i][0], scores[keep]])
        v = np.concatenate([self.found[i][1], ids[keep]])
        order = np.lexsort((v, -s))[: self.k]
        self.found[i] = s[order], v[order]
        if len(order) == self.k:
            self.theta[i] = max(self.theta[i], float(s[order[-1]]))

    def search(self, b: Bucket) -> None:
        """Offer every vector of the bucket that the thresholds leave."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = self.theta / (self.norm * b.norm[0])
            least = self.theta / self.norm
        # a zero length bounds nothing: such queries are compared with all
        bounded = (self.theta > 0) & (self.norm > 0) & (b.norm[0] > 0)
        skip = (self.theta > 0) & ((self.norm == 0) | (b.norm[0] == 0) | (cosine > 1 + EPS))
        by_angle = bounded & ~skip & (cosine >= COORDINATE_FROM)
        for i in np.flatnonzero(by_angle):
            rows = b.near(self.unit[i], float(cosine[i]))
            if len(rows):
                self.offer(i, b.ids[rows], products(self.mat[i : i + 1], b.mat[rows])[0])
        by_length = np.flatnonzero(~skip & ~by_angle)
        if not len(by_length):
            return
        # lengths fall: the vectors that are long enough for the least demanding query
        need = np.where(bounded[by_length], least[by_length], 0.0).min() * (1 - EPS)
        n = int(np.searchsorted(-b.norm, -need, "right"))
        scores = products(self.mat[by_length], b.mat[:n])
        hit = scores >= self.theta[by_length][:, None]
        for at in np.flatnonzero(hit.any(1)):
            rows = np.flatnonzero(hit[at])
            self.offer(by_length[at], b.ids[rows], scores[at, rows])


def buckets(vectors: DataFrame) -> DataFrame:
    """``(dim, n, first, ids, mat, norm)``: packed buckets; ``norm`` is the longest length."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n = shuffle_partitions(vectors.sparkSession)
    keys = [F.col("dim"), F.col("norm").desc(), F.col("id")]
    ordered = vectors.withColumn("norm", norm).repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim", sort=False):
                for at in range(0, len(part), BUCKET):
                    p = part.iloc[at : at + BUCKET]
                    ids = p["id"].to_numpy(np.int64)
                    yield pd.DataFrame(
                        {
                            "dim": [dim], "n": [len(p)], "first": [int(ids[0])], "ids": [ids.tobytes()],
                            "mat": [matrix(p["v"]).tobytes()], "norm": [float(p["norm"].iloc[0])],
                        }
                    )

    return ordered.select("dim", "id", "v", "norm").mapInPandas(
        run, "dim int, n int, first long, ids binary, mat binary, norm double"
    )


def _unpack(ids: bytes, mat: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(mat, np.float64).reshape(n, -1)


def top_k(
    df: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row whose id is divisible by ``every``.

    Components become ``floor(scale * x)``; the score is their inner product.
    A query's candidates are all rows of another id and of its dimension. Rows
    without an id, and vectors that are null or hold null or non-finite
    components, take no part; rows equal in id and vector count once.
    """
    vectors = stored(clean_vectors(df, id_col, vec_col, lambda x: F.floor(x * scale)), "vectors")
    # any vectors give thresholds; long ones give high thresholds
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    share = max(0.0, 1 - SEEDS / max(1, vectors.count()))
    long = vectors.agg(F.percentile_approx(norm, share, 10_000)).first()[0] or 0.0
    seeds = vectors.where(norm >= long).limit(SEEDS).collect()
    by_dim: dict[int, list] = {}
    for r in seeds:
        by_dim.setdefault(r["dim"], []).append(r)
    first = {d: Bucket(np.array([r["id"] for r in rs]), matrix(pd.Series([r["v"] for r in rs]))) for d, rs in by_dim.items()}
    packed = stored(buckets(vectors), "buckets")
    queries = stored(query_blocks(vectors.where(F.pmod("id", F.lit(every)) == 0)), "queries")
    n_buckets, n_queries = packed.count(), queries.count()
    cells = grid(
        queries.withColumn("norm", F.lit(None).cast("double")),
        packed,
        max(1, -(-n_queries // QUERY_GROUP)),
        max(1, min(n_buckets, shuffle_partitions(df.sparkSession) * 2) if n_buckets < 4_096 else n_buckets // 32),
        F.xxhash64("first"),
        F.xxhash64("first", "norm"),
    ).sortWithinPartitions("lg", "rg", "kind", F.col("norm").desc(), "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, blocks = None, []

        def results() -> pd.DataFrame:
            rows = [
                (int(q), int(v), int(s))
                for b in blocks
                for q, (scores, ids) in zip(b.ids, b.found)
                for s, v in zip(scores, ids)
            ]
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        for batch in batches:
            for lg, rg, kind, dim, n, ids, mat in zip(*(batch[c] for c in ("lg", "rg", "kind", "dim", "n", "ids", "mat"))):
                if cell != (lg, rg):
                    yield results()
                    cell, blocks = (lg, rg), []
                own = _unpack(ids, mat, n)
                if kind == 0:
                    block = Best(*own, k)
                    if dim in first:
                        block.search(first[dim])
                        block.found = [(s[:0], v[:0]) for s, v in block.found]  # seeds are in their buckets, too
                    block.dim = dim
                    blocks.append(block)
                else:
                    bucket = Bucket(*own)
                    for b in blocks:
                        if b.dim == dim:
                            b.search(bucket)
        yield results()

    found = cells.select("lg", "rg", "kind", "dim", "n", "ids", "mat").mapInPandas(
        run, "query_id long, vec_id long, score long"
    )
    return best(found, k, ascending=False)


TOP_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, len(embedding) AS dim,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e  -- whole numbers, whose products are exact
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.dim = c.dim
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
