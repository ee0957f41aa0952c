"""Operators checked against brute force in numpy: exact quantile (including
the narrowing path), histogram, dense index."""

import numpy as np
import pytest

from latentrec.operators.indexing import dense_index
from latentrec.operators.quantile import bin_sql, exact_quantile, summarize
from latentrec.operators.scoring import histogram


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    ties = rng.integers(0, 300, 6000).astype(float)
    smooth = rng.lognormal(0, 2, 6000)
    v = np.concatenate([ties, smooth, [np.nan]])
    df = spark.createDataFrame([(float(x) if not np.isnan(x) else None,) for x in v], "score double")
    return df.repartition(7), v[~np.isnan(v)]


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 0.9999, 1.0])
def test_exact_quantile_small_path(values, p):
    df, v = values
    assert exact_quantile(df, "score", p) == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=0)


@pytest.mark.parametrize("p", [0.05, 0.37, 0.9])
def test_exact_quantile_narrowing_path(values, p):
    """max_candidates far below n forces several sketch-and-count rounds."""
    df, v = values
    got = exact_quantile(df, "score", p, accuracy=40, max_candidates=50)
    assert got == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=0)


def test_exact_quantile_all_ties(spark):
    df = spark.createDataFrame([(1.5,)] * 1000, "score double")
    assert exact_quantile(df, "score", 0.9, accuracy=10, max_candidates=5) == 1.5


def test_histogram_matches_numpy(values):
    df, v = values
    rows = histogram(df, "score", 30).orderBy("bin").collect()
    counts, edges = np.histogram(v, bins=30)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_lo for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1].bin_hi == pytest.approx(edges[-1])


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "score double")
    rows = histogram(df, "score", 10).collect()
    counts, _ = np.histogram(np.full(5, 2.0), bins=10)
    assert sorted(r.n for r in rows) == sorted(counts.tolist())


def test_dense_index_is_sorted_rank(spark):
    words = ["pear", "apple", "fig", "apple", "kiwi", "fig", "banana"] * 50
    df = spark.createDataFrame([(w,) for w in words], "item_id string").repartition(5)
    idx = {r.item_id: r.idx for r in dense_index(df, "item_id", "idx").collect()}
    expected = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    assert idx == expected


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_exact_quantile_random_ties_and_bounds(spark, seed):
    """Heavy ties, random p and tiny sketch settings: every branch of the
    narrowing (overshoot, undershoot, inside, tie at a bracket end)."""
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.integers(0, 40, 700).astype(float), rng.normal(20, 8, 700)])
    df = spark.createDataFrame([(float(x),) for x in v], "score double").repartition(5)
    for p in rng.uniform(0, 1, 3).tolist() + [0.5]:
        got = exact_quantile(df, "score", p, accuracy=8, max_candidates=30)
        assert got == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-12)


def _counted(df, spark):
    """``df`` whose rows are counted whenever they are read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), seen


def _mixed_values(seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate(
        [rng.normal(0, 5, 3000), rng.lognormal(0, 6, 2000), -rng.lognormal(-3, 4, 1000), np.zeros(500), np.full(700, 2.5), [1e-310, -1e-310, 1e300]]
    )
    return rng.permutation(v)


@pytest.mark.parametrize("seed,steps", [(1, 512), (2, 3), (3, 1)])
def test_quantiles_and_histogram_share_two_scans(spark, seed, steps):
    v = _mixed_values(seed)
    v = v[np.abs(v) < 1e6] if seed == 3 else v
    rows = [(float(x),) for x in v] + [(None,), (float("nan"),)]
    df, seen = _counted(spark.createDataFrame(rows, "score double").repartition(6), spark)
    ps = [0.0, 0.003, 0.25, 0.5, 0.777, 0.9, 0.9999, 1.0]
    s = summarize(df, "score", ps, bins=30, steps=steps, max_candidates=40)
    assert seen.value <= 2 * len(rows)
    assert (s.n, s.lo, s.hi) == (len(v), v.min(), v.max())
    for p in ps:
        assert s.quantiles[p] == pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-300), p
    got = s.histogram.orderBy("bin").collect()
    assert [r.bin for r in got] == list(range(30))
    assert [r.n for r in got] == np.histogram(v, bins=30)[0].tolist()


def test_summary_of_few_or_no_values(spark):
    none = summarize(spark.createDataFrame([(None,), (float("nan"),)], "score double"), "score", [0.5], bins=3)
    assert (none.n, none.quantiles, none.histogram.count()) == (0, {0.5: None}, 0)
    ends = spark.createDataFrame([(float("inf"),), (1.0,), (-float("inf"),)], "score double")
    assert summarize(ends, "score", [0.0, 0.5, 1.0]).quantiles == {0.0: -np.inf, 0.5: 1.0, 1.0: np.inf}
    with pytest.raises(ValueError):
        exact_quantile(ends, "score", 1.5)


def test_bins_ascend_with_values(spark):
    v = np.sort(_mixed_values(7))
    df = spark.createDataFrame([(float(x),) for x in v], "_x double").selectExpr("_x", f"{bin_sql('_x', 64)} AS k")
    rows = sorted(df.distinct().collect())
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    for a, b in zip(rows, rows[1:]):
        if a.k == b.k and a["_x"] > 1e-300:
            assert b["_x"] / a["_x"] <= np.exp(1 / 64) * (1 + 1e-9)
