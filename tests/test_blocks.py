"""Two-dimensional pair blocks, and salts of hot keys alone."""

import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER
from latentrec.operators import em
from latentrec.plans.layout import CO_PARTITION, PAIR_BLOCK, block_grid, block_numbers, plan_layout
from latentrec.plans.model import fit, sweep
from latentrec.sources.interactions import customer_brand_pairs, events_pairs


@pytest.fixture(scope="module")
def events(spark):
    return events_pairs(spark, SF_MID).cache()


def above(lines, at):
    """The operators on the way from a line of a plan up to its root, nearest first."""
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    now, out = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < now:
            out.append(line.strip(" :+-"))
            now = depth(line)
    return out


def iteration(layout, model):
    joined = layout.attach(model.user_factors(), model.item_factors())
    return em.m_step_sums(em.e_step(joined, model.k, keep=[USER, ITEM]), model.k)


# neither side is broadcast; the items alone are not
@pytest.mark.parametrize("limit", [0, 150 * 56])
def test_pairs_are_not_exchanged_in_an_iteration(spark, events, limit):
    items_first = events.select(F.col(ITEM).alias(USER), F.col(USER).alias(ITEM)) if limit else events
    layout = plan_layout(items_first, 3, broadcast_limit=limit * 100 // 150 if limit else 0)
    assert layout.grid is not None and layout.broadcast_users == bool(limit)
    model = fit(layout, 3, 3, init="weighted")
    ref = fit(items_first, 3, 3, init="weighted")
    assert [r[3] for r in model.history_rows] == pytest.approx([r[3] for r in ref.history_rows], rel=1e-12)
    for method in ("p_class_given_user", "p_item_given_class"):
        a, b = ({tuple(r)[:2]: r.p for r in getattr(m, method)().collect()} for m in (model, ref))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    lines = iteration(layout, model)._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "latentrec_pairs_" in line]
    assert len(scans) == 1 and "Bucketed: true" in lines[scans[0]]
    way = above(lines, scans[0])
    assert sum("Join" in x for x in way) == 2
    assert next(i for i, x in enumerate(way) if "partial_sum" in x) < next(i for i, x in enumerate(way) if "Exchange" in x)
    layout.close()


def test_string_ids_and_sweep_in_blocks(spark, events):
    brands = customer_brand_pairs(spark, "/root/testdata/sf0.001")
    a, b = fit(brands, 2, 2, init="weighted", broadcast_limit=0), fit(brands, 2, 2, init="weighted")
    assert [r[3] for r in a.history_rows] == pytest.approx([r[3] for r in b.history_rows], rel=1e-12)
    x, y = (sweep(events, [2, 3], 2, broadcast_limit=limit).collect() for limit in (0, 2**26))
    assert [r.mean_log_likelihood for r in x] == pytest.approx([r.mean_log_likelihood for r in y], rel=1e-12)


def test_every_block_has_a_bucket_of_its_own(spark):
    for parts in (1, 7, 64, 300):
        rows = block_numbers(spark, parts).select("_at", PAIR_BLOCK, F.pmod(F.hash(PAIR_BLOCK), F.lit(parts)).alias("bucket")).collect()
        assert sorted(r["_at"] for r in rows) == list(range(parts))
        assert all(r["bucket"] == r["_at"] for r in rows)


def test_routes_are_where_the_pairs_are(spark, events):
    layout = plan_layout(events, 3, broadcast_limit=0, rows_per_partition=100)
    for routes, key in ((layout.user_routes, USER), (layout.item_routes, ITEM)):
        want = {tuple(r) for r in layout.pairs.select(key, PAIR_BLOCK).distinct().collect()}
        got = [tuple(r) for r in routes.select(key, PAIR_BLOCK).collect()]
        assert len(got) == len(want) and set(got) == want
    a, b = layout.grid
    assert max(layout.user_routes.groupBy(USER).count().select("count").collect())[0] <= a * b


def test_hot_keys_spread_over_blocks(spark):
    """A user and an item with a third of all pairs each; no block holds much more than its share."""
    rows = [(0, i) for i in range(3_000)] + [(u, 0) for u in range(1, 3_000)]
    rows += [(u % 997 + 1, (u * 31) % 1_499 + 1) for u in range(3_000)]
    pairs = spark.createDataFrame(rows, "user_id long, item_id long").distinct()
    layout = plan_layout(pairs, 2, broadcast_limit=0, rows_per_partition=250)
    sizes = [r["count"] for r in layout.pairs.groupBy(PAIR_BLOCK).count().collect()]
    assert sum(sizes) == layout.n_pairs and max(sizes) < 4 * layout.n_pairs / layout.partitions
    a, b = fit(layout, 2, 2), fit(pairs, 2, 2)
    assert a.history_rows[-1][2] == pytest.approx(b.history_rows[-1][2], rel=1e-12)


def test_one_hot_user_leaves_the_others_together(spark):
    """Broadcast layout: only the pairs of the hot user are spread; partial sums stay few."""
    rows = [(0, i) for i in range(4_000)] + [(u, (u * 7 + j) % 400) for u in range(1, 801) for j in range(10)]
    pairs = spark.createDataFrame(rows, "user_id long, item_id long")
    layout = plan_layout(pairs, 2)
    assert layout.broadcast_users and layout.broadcast_items and layout.user_salts.count() == 1
    per_user = layout.pairs.select(USER, F.input_file_name().alias("f")).distinct().groupBy(USER).count()
    files = {r[USER]: r["count"] for r in per_user.collect()}
    assert files.pop(0) > 1 and set(files.values()) == {1}
    sizes = [r["count"] for r in layout.pairs.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 3 * layout.n_pairs / layout.partitions


def test_grid_shape():
    assert block_grid(100, 10**6, 10**6, False) == (10, 10)
    assert block_grid(100, 10**8, 10**6, False) == (100, 1)
    assert block_grid(100, 10**6, 10**8, True) == (1, 100)
    rows, cols = block_grid(37, 5_000, 400, False)
    assert rows * cols >= 37 and rows > cols


def test_close_restores_the_session(spark, events):
    spark.conf.set(CO_PARTITION, "true")
    layout = plan_layout(events, 2, broadcast_limit=0)
    assert spark.conf.get(CO_PARTITION) == "false"
    layout.close()
    assert spark.conf.get(CO_PARTITION) == "true"
