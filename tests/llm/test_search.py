"""Searches over vectors against brute force."""

import numpy as np
import pytest

from latentrec.llm import hnsw, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def vectors(n, dim, seed, hot=0):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dim)) * rng.gamma(2, 1, (n, 1))).astype(np.float32)
    x[: n // 4] = x[0] + 0.05 * x[: n // 4]  # a dense direction, for coordinate pruning
    x[rng.permutation(n)[:hot]] = x[1]
    return [(int(i), x[i].tolist()) for i in rng.permutation(n)]


def plain_top(rows, k, every):
    out = {}
    q = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows}
    for i in q:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)
            out[i] = [(j, -n) for n, j in s[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("n,dim,hot", [(600, 8, 0), (400, 3, 150), (4, 5, 0)])
def test_top_k_is_exact(spark, monkeypatch, n, dim, hot):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "SEEDS", 16)
    rows = vectors(n, dim, n, hot)
    assert answers(topk.top_k(frame(spark, rows), k=5, every=10)) == plain_top(rows, 5, 10)


@pytest.mark.parametrize("cut", [-1.0, 0.3, 2.0])
def test_both_prunings_are_exact(spark, monkeypatch, cut):
    """Coordinate pruning wherever it applies, sometimes, and never."""
    monkeypatch.setattr(topk, "BUCKET", 50)
    monkeypatch.setattr(topk, "COORDINATE_FROM", cut)
    rows = vectors(500, 6, 3)
    assert answers(topk.top_k(frame(spark, rows), k=4, every=25)) == plain_top(rows, 4, 25)


def test_large_components_are_exact():
    big = np.array([[2.0**40, 3.0], [2.0**40, -5.0]])
    assert topk.products(big, big).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    mid = np.array([[2.0**29, 1.0]])
    assert topk.products(mid, mid).tolist() == [[2**58 + 1]]


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [0.0, 0.0]), (6, [1.0, 2.0]), (None, [5.0, 5.0]), (7, [-1.0, -2.0]), (100, [0.5, 0.5]), (8, [1.0]), (9, []),
    ]


def test_top_k_of_odd_rows(spark):
    got = answers(topk.top_k(frame(spark, odd_vectors()), k=5, every=50))
    use = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]), (7, [-1.0, -2.0]), (100, [0.5, 0.5])]
    assert got == plain_top(use, 5, 50)
    assert topk.top_k(frame(spark, [])).count() == 0


def plain_nearest(rows, k, every):
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    out = {}
    for i in x:
        if i % every == 0:
            d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in x if j != i)
            out[i] = d[:k]
    return out


@pytest.mark.parametrize("n,hot,shard", [(3_000, 0, 700), (2_000, 900, 2_048), (6, 0, 64)])
def test_neighbours_are_found(spark, n, hot, shard):
    rows = vectors(n, 24, n, hot)
    got = answers(hnsw.nearest(frame(spark, rows), k=10, every=50 if n > 100 else 1, shard_rows=shard))
    want = plain_nearest(rows, 10, 50 if n > 100 else 1)
    assert set(got) == set(want)
    hits = total = 0
    for i, near in want.items():
        assert len(got[i]) == len(near)
        assert [s for _, s in got[i]] == sorted(s for _, s in got[i])
        hits += len({j for _, j in near} & {j for j, _ in got[i]})
        total += len(near)
        known = dict((j, d) for d, j in near)
        assert all(s == pytest.approx(known[j], abs=1e-12) for j, s in got[i] if j in known)
    assert hits / total >= 0.95


def test_neighbours_of_odd_rows(spark):
    got = answers(hnsw.nearest(frame(spark, odd_vectors()), k=10, every=50))
    use = [(0, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [-1.0, -2.0]), (100, [0.5, 0.5])]
    want = {i: [(j, d) for d, j in near] for i, near in plain_nearest(use, 10, 50).items()}
    assert got == want
    assert hnsw.nearest(frame(spark, [])).count() == 0
