"""Recommendations by bound equal the filtered grid, in every bit and for every plan."""

import math

import numpy as np
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER
from latentrec.operators.pruning import cells_between, components_between, item_blocks, pruning_report
from latentrec.operators.scoring import score_components, score_pairs
from latentrec.plans.model import fit
from latentrec.plans.recommend import predict, recommend, score_summary
from latentrec.sources.interactions import events_pairs

# the blocks are broadcast; their bounds alone are; neither is
LIMITS = (2**26, 8_000, 0)


@pytest.fixture(scope="module")
def grouped(spark):
    """Three groups of users with items of their own, some shared items, string ids."""
    rng = np.random.default_rng(3)
    rows = {(f"u{u}", f"i{(u % 3) * 40 + int(40 * rng.random() ** 2)}") for u in range(60) for _ in range(15)}
    rows |= {(f"u{u}", f"i{200 + u % 7}") for u in range(60)}
    return fit(spark.createDataFrame(sorted(rows), "user_id string, item_id string"), 3, 25, seed=1)


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("p", [0.3, 0.9, 0.995])
def test_pruned_equals_filtered_grid(grouped, limit, p):
    scores = score_pairs(grouped)
    t = score_summary(grouped, [p]).quantiles[p]
    pruned = cells_between(grouped, [(t, None)], limit, block_rows=8)
    full = values(scores.where(F.col("score") >= t))
    assert values(pruned) == full and full
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("limit", LIMITS)
def test_pruned_components_and_intervals(grouped, limit):
    comp = score_components(grouped)
    t = score_summary(grouped, [0.9], per_class=True).quantiles[0.9]
    assert values(components_between(grouped, [(t, None)], limit, block_rows=8)) == values(comp.where(F.col("score") >= t))
    some = [(0.001, 0.002), (0.01, 0.02), (0.5, None)]
    wanted = " OR ".join(f"(score >= {a} AND score <= {b or 9})" for a, b in some)
    assert values(cells_between(grouped, some, limit, block_rows=8)) == values(score_pairs(grouped).where(wanted))
    assert values(components_between(grouped, some, limit, block_rows=8)) == values(comp.where(wanted))


def test_whole_blocks_are_skipped(grouped):
    t = score_summary(grouped, [0.95]).quantiles[0.95]
    n = grouped.layout.n_users * grouped.layout.n_items
    reports = [pruning_report(grouped, [(t, None)], broadcast_limit=limit, block_rows=8).first() for limit in (2**26, 0)]
    assert reports[0] == reports[1]
    r = reports[0]
    assert r.n_cells == n and r.skipped_share == pytest.approx(1 - r.n_expanded / r.n_blocks)
    assert r.skipped_share > 0.5  # users of one group never meet the blocks of another
    assert 0.05 * n <= r.n_cells_expanded <= 0.5 * n
    nothing = pruning_report(grouped, [(2.0, None)], block_rows=8).first()
    assert nothing.n_expanded == nothing.n_cells_expanded == 0
    every = pruning_report(grouped, [(0.0, None)], per_class=True, block_rows=8).first()
    assert every.n_cells_expanded == n


def test_blocks_hold_every_item_once(grouped):
    blocks = item_blocks(grouped, block_rows=8)
    rows = blocks.packed.collect()
    assert len({r["_block"] for r in rows}) == len(rows) <= blocks.count
    assert sorted(i.item_id for r in rows for i in r["_items"]) == sorted(r.item_id for r in grouped.item_factors().collect())
    for r in rows:
        assert r["_n"] == len(r["_items"])
        for z in range(3):
            p = [i[f"pi_{z}"] for i in r["_items"]]
            assert (r[f"_hi{z}"], r[f"_lo{z}"]) == (max(p), min(p))


def test_flagged_only_predictions(spark):
    m = fit(events_pairs(spark, SF_MID), 3, 5, init="weighted")
    for kw in ({"quantile": 0.9}, {"threshold": 0.01}, {"quantile": 0.9, "per_class": True}):
        t, full = predict(m, **kw)
        t2, only = predict(m, flagged_only=True, **kw)
        assert t == t2 and only.columns == full.columns
        assert values(only) == values(full.where("recommended"))


def test_recommend_flagged_only(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(12) for i in range(u % 4 + 1)], "user_id long, item_id long")
    rec = recommend(pairs, 2, 5, seed=2, flagged_only=True)
    assert values(rec.predictions.drop("recommended")) == values(score_pairs(rec.model).where(F.col("score") >= rec.threshold))
    assert rec.predictions.where("NOT recommended").count() == 0


def test_one_class_and_zero_mass(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, item_id long")
    m = fit(pairs, 1, 2)
    assert values(cells_between(m, [(0.5, None)])) == values(score_pairs(m).where("score >= 0.5"))
    q0 = pairs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("z")).selectExpr("*", "CAST(1 - z AS DOUBLE) AS q")
    m = fit(pairs, 2, 2, q0=q0)
    assert values(cells_between(m, [(0.0, None)])) == values(score_pairs(m))


def test_summary_by_bounds_equals_plain_one(grouped):
    ps = [0.1, 0.5, 0.9]
    scores = [r.score for r in score_pairs(grouped).collect()]
    s = score_summary(grouped, ps, bins=10)
    for p in ps:
        assert s.quantiles[p] == pytest.approx(float(np.quantile(scores, p)), rel=1e-13)
        assert score_summary(grouped, [p]).quantiles[p] == s.quantiles[p]
    x = np.array(scores)  # many scores lie at an edge but for rounding, so the edges must be those of the rule itself
    bars = np.minimum(np.floor((x - x.min()) / (x.max() - x.min()) * 10).astype(int), 9)
    assert [r.n for r in s.histogram.orderBy("bin").collect()] == np.bincount(bars, minlength=10).tolist()


def test_grid_exchanges_a_row_per_user(spark, monkeypatch):
    """With the blocks broadcast, users are dealt before they meet the blocks."""
    from latentrec.operators import scoring

    monkeypatch.setattr(scoring, "ITEM_BLOCK", 4)
    users = spark.range(60).select(F.col("id").alias(USER))
    items = spark.range(50).select(F.col("id").alias(ITEM))
    lines = scoring.all_items_for_each_user(users, items)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = {kind: next(i for i, x in enumerate(lines) if kind in x) for kind in ("Generate inline", "BroadcastHashJoin", "Generate explode")}
    dealt = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert at["Generate inline"] < at["BroadcastHashJoin"] < at["Generate explode"] < dealt
    # fewer users than tasks: a user's blocks are split, and none is lost
    monkeypatch.setattr(scoring, "CELLS_PER_PARTITION", 1)
    few = scoring.all_items_for_each_user(users.limit(2), items)
    assert {tuple(r) for r in few.collect()} == {(u, i) for u in range(2) for i in range(50)} and few.count() == 100
    assert math.ceil(50 / 4) == 13
