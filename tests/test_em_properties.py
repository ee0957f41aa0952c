"""Properties of the fitted model that hold for any data."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from latentrec.functions.columns import ITEM, USER
from latentrec.operators.scoring import score_pairs
from latentrec.plans.layout import plan_layout
from latentrec.plans.model import fit
from latentrec.sources.interactions import customer_brand_pairs, events_pairs


def _by_key(rows, key_len):
    return {tuple(r[:key_len]): r[key_len] for r in rows}


@pytest.fixture(scope="module")
def events(spark):
    return events_pairs(spark, SF_MID).cache()


@pytest.fixture(scope="module")
def model(events):
    return fit(events, 4, n_iter=6, init="hashed", seed=3)


def test_posterior_sums_to_one(model):
    bad = model.posterior().groupBy(USER, ITEM).agg(F.sum("q").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9)
    assert bad.count() == 0


def test_item_given_class_sums_to_one(model):
    sums = model.p_item_given_class().groupBy("z").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 4
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_class_given_user_sums_to_one(model):
    bad = model.p_class_given_user().groupBy(USER).agg(F.sum("p").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9)
    assert bad.count() == 0


def test_likelihood_never_falls(model):
    lls = model.log_likelihoods
    assert len(lls) == 6
    assert all(b >= a - 1e-12 for a, b in zip(lls, lls[1:]))


def test_user_mass_is_item_count(model, events):
    counts = _by_key(events.groupBy(USER).count().collect(), 1)
    mass = _by_key(model.user_mass().collect(), 1)
    assert counts.keys() == mass.keys()
    assert all(abs(mass[k] - counts[k]) < 1e-9 for k in counts)


def test_scores_sum_to_one_per_user(model):
    s = score_pairs(model).groupBy(USER).agg(F.sum("score").alias("s"))
    assert s.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert s.count() == model.layout.n_users


def test_history_matches_pair_likelihood(model):
    psu = model.pair_likelihood().agg(F.sum(F.ln("psu")).alias("t"), F.count("*").alias("n")).first()
    last = model.history_rows[-1]
    assert psu.n == last[4]
    assert math.isclose(psu.t, last[3], rel_tol=1e-12)


def test_single_class_gives_popularity(events):
    m = fit(events, 1, n_iter=2, init="hashed")
    n = events.count()
    pop = _by_key(events.groupBy(ITEM).count().collect(), 1)
    p = _by_key(m.p_item_given_class().select(ITEM, "p").collect(), 1)
    assert all(abs(p[k] - pop[k] / n) < 1e-12 for k in pop)
    assert all(abs(r.p - 1) < 1e-12 for r in m.p_class_given_user().collect())


def test_duplicates_do_not_matter(spark, events):
    doubled = events.unionByName(events).distinct()
    a = fit(events, 3, 3, init="weighted").history_rows
    b = fit(doubled, 3, 3, init="weighted").history_rows
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b], rel=1e-12)


def test_hashed_start_does_not_depend_on_partitioning(spark, events):
    a = fit(events.repartition(3), 3, 3, init="hashed", seed=11)
    b = fit(events.repartition(13), 3, 3, init="hashed", seed=11)
    pa = _by_key(a.p_item_given_class().collect(), 2)
    pb = _by_key(b.p_item_given_class().collect(), 2)
    assert pa.keys() == pb.keys()
    assert all(abs(pa[k] - pb[k]) < 1e-12 for k in pa)


def test_permuting_start_classes_permutes_result(spark, events):
    k = 3
    q0 = fit(events, k, 1, init="weighted").layout.pairs  # laid-out pairs only
    from latentrec.operators.init import with_start_posterior
    from latentrec.functions.columns import long_form

    wide = with_start_posterior(q0, k, "weighted").select(USER, ITEM, "q_0", "q_1", "q_2")
    long = long_form(wide, [USER, ITEM], ["q_0", "q_1", "q_2"], "q")
    perm = {0: 2, 1: 0, 2: 1}
    permuted = long.withColumn(
        "z", F.when(F.col("z") == 0, 2).when(F.col("z") == 1, 0).otherwise(1).cast("bigint")
    )
    a = _by_key(fit(events, k, 3, q0=long).p_item_given_class().collect(), 2)
    b = _by_key(fit(events, k, 3, q0=permuted).p_item_given_class().collect(), 2)
    assert all(abs(a[(i, z)] - b[(i, perm[z])]) < 1e-12 for (i, z) in a)


def test_given_start_equals_weighted_start(spark, events):
    from latentrec.functions.columns import long_form
    from latentrec.operators.init import with_start_posterior

    wide = with_start_posterior(events, 3, "weighted").select(USER, ITEM, "q_0", "q_1", "q_2")
    q0 = long_form(wide, [USER, ITEM], ["q_0", "q_1", "q_2"], "q")
    a = fit(events, 3, 2, init="weighted").history_rows
    b = fit(events, 3, 2, q0=q0).history_rows
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b], rel=1e-13)


def test_tolerance_stops_and_keeps_matching_params(events):
    full = fit(events, 3, 4, init="weighted")
    stopped = fit(events, 3, 10, tol=1.0, init="weighted")
    assert len(stopped.history_rows) == 2
    assert stopped.history_rows[1][2] == pytest.approx(full.history_rows[1][2], rel=1e-13)
    psu = stopped.pair_likelihood().agg(F.sum(F.ln("psu")).alias("t")).first().t
    assert psu == pytest.approx(stopped.history_rows[-1][3], rel=1e-12)


def test_invalid_arguments(events):
    with pytest.raises(ValueError):
        fit(events, 0, 3)
    with pytest.raises(ValueError):
        fit(events, 3, 0)


def test_forced_shuffle_layouts_match_broadcast(spark, events):
    """Co-partitioned user side, shuffled item side and salted hot keys give
    the same parameters as the all-broadcast plan."""
    ref = fit(events, 3, 3, init="weighted")
    forced = plan_layout(events, 3, broadcast_limit=0, rows_per_partition=50)
    d = forced.describe()
    assert not d["broadcast_users"] and not d["broadcast_items"]
    # 147 partitions, so a key with more than 50 pairs is hot: every item
    # (~73 pairs each) and the busiest users are split into sub-keys
    assert d["salted_items"] and d["salted_users"]
    other = fit(forced, 3, 3, init="weighted")
    assert [r[3] for r in ref.history_rows] == pytest.approx([r[3] for r in other.history_rows], rel=1e-12)
    a = _by_key(ref.p_class_given_user().collect(), 2)
    b = _by_key(other.p_class_given_user().collect(), 2)
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_copartitioned_pairs_are_not_shuffled(spark, events):
    """With the user side too big to broadcast, the pairs keep their hash
    partitioning by user: the user join shuffles only the parameter table."""
    lay = plan_layout(events, 3, broadcast_limit=0)
    m = fit(lay, 3, 1, init="weighted")
    joined = m.layout.attach(m.user_factors(), m.item_factors())
    lines = joined._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(lines) if "latentrec_pairs_" in line]
    assert len(scans) == 1 and "Bucketed: true" in lines[scans[0]]
    # walk up from the pairs scan to the user join: no Exchange on the way
    depth = len(lines[scans[0]]) - len(lines[scans[0]].lstrip(" :+-"))
    parents = []
    for line in reversed(lines[: scans[0]]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            parents.append(line.strip(" :+-"))
            depth = d
    first_join = next(i for i, p in enumerate(parents) if "Join" in p)
    assert not any(p.startswith("Exchange") for p in parents[:first_join])


def test_string_ids_with_weighted_start(spark):
    pairs = customer_brand_pairs(spark, SF_SMALL)
    m = fit(pairs, 2, 2, init="weighted")
    assert m.layout.user_rank == "_ur"
    sums = m.p_item_given_class().groupBy("z").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)


def test_grid_plan_has_no_cartesian_product(model):
    """All user x item scores come from explode + equi-join, never from a
    Cartesian or nested-loop join."""
    plan = score_pairs(model)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan and "Generate explode" in plan


def test_hot_key_tables_are_bounded(events):
    lay = plan_layout(events, 3, broadcast_limit=0, rows_per_partition=50)
    assert lay.user_salts.count() < lay.partitions
    assert lay.item_salts.count() < lay.partitions
    # every pair lands in one sub-key and the sub-keys cover the key's pairs
    assert lay.pairs.count() == lay.n_pairs
