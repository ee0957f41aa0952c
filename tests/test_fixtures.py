"""Small hand-made fixtures (FIXTURES.md): hand-computed EM step, separation of
disjoint groups, CSV edge cases, sinks."""

import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from latentrec.functions.columns import ITEM, USER
from latentrec.operators.scoring import candidate_grid, joint_probability, score_components, score_pairs
from latentrec.plans.layout import plan_layout
from latentrec.plans.model import fit, sweep
from latentrec.plans.recommend import predict
from latentrec.sources.interactions import dropped_rows, preview, read_interactions, read_table, shape, to_pairs
from latentrec.session import checkpoint_dir
from latentrec.sources.sinks import write_predictions


def _q0(spark, rows):
    return spark.createDataFrame(rows, "user_id string, item_id string, z bigint, q double")


@pytest.fixture(scope="module")
def tiny(spark):
    pairs = spark.createDataFrame([("Ines", "Red Kite"), ("Tomas", "Low Tide")], "user_id string, item_id string")
    q0 = _q0(
        spark,
        [
            ("Ines", "Red Kite", 0, 0.3),
            ("Ines", "Red Kite", 1, 0.7),
            ("Tomas", "Low Tide", 0, 0.6),
            ("Tomas", "Low Tide", 1, 0.4),
        ],
    )
    return pairs, fit(pairs, 2, 1, q0=q0)


def test_tiny_m_step_by_hand(tiny):
    _, m = tiny
    p = {(r.item_id, r.z): r.p for r in m.p_item_given_class().collect()}
    assert p[("Red Kite", 0)] == pytest.approx(1 / 3)
    assert p[("Red Kite", 1)] == pytest.approx(7 / 11)
    assert p[("Low Tide", 0)] == pytest.approx(2 / 3)
    assert p[("Low Tide", 1)] == pytest.approx(4 / 11)
    u = {(r.user_id, r.z): r.p for r in m.p_class_given_user().collect()}
    assert u[("Ines", 1)] == pytest.approx(0.7)
    assert m.class_mass == pytest.approx([0.9, 1.1])


def test_tiny_e_step_by_hand(tiny):
    _, m = tiny
    q = {(r.user_id, r.z): r.q for r in m.posterior().collect()}
    assert q[("Ines", 0)] == pytest.approx(1.1 / 6)
    assert q[("Tomas", 0)] == pytest.approx(0.4 * 11 / 6)
    psu = {r.user_id: r.psu for r in m.pair_likelihood().collect()}
    assert psu["Ines"] == pytest.approx(6 / 11)
    assert m.history_rows[0][2] == pytest.approx(math.log(6 / 11))


def test_tiny_grid_scores(tiny):
    pairs, m = tiny
    assert candidate_grid(pairs).count() == 4
    s = {(r.user_id, r.item_id): r.score for r in score_pairs(m).collect()}
    assert s[("Ines", "Low Tide")] == pytest.approx(5 / 11)
    assert s[("Ines", "Red Kite")] == pytest.approx(6 / 11)
    assert s[("Tomas", "Red Kite")] == pytest.approx(5 / 11)
    comp = score_components(m).collect()
    assert len(comp) == 8
    by = {(r.user_id, r.item_id, r.z): r.score for r in comp}
    assert by[("Ines", "Low Tide", 0)] == pytest.approx(0.3 * 2 / 3)
    joint = {(r.user_id, r.item_id): r.p_joint for r in joint_probability(m).collect()}
    assert sum(joint.values()) == pytest.approx(1.0)


def test_tiny_fixed_threshold_is_inclusive(tiny):
    _, m = tiny
    t, preds = predict(m, threshold=6 / 11 - 1e-15)
    flags = {(r.user_id, r.item_id): r.recommended for r in preds.collect()}
    assert flags[("Ines", "Red Kite")] and flags[("Tomas", "Low Tide")]
    assert not flags[("Ines", "Low Tide")]


def test_disjoint_groups_separate(spark):
    a_users, b_users = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    a_items, b_items = ["x1", "x2", "x3"], ["y1", "y2", "y3"]
    rows = [(u, i) for u in a_users for i in a_items] + [(u, i) for u in b_users for i in b_items]
    pairs = spark.createDataFrame(rows, "user_id string, item_id string")
    lean = [(u, i, 0, 0.55) for u, i in rows[:18]] + [(u, i, 1, 0.45) for u, i in rows[:18]]
    lean += [(u, i, 0, 0.45) for u, i in rows[18:]] + [(u, i, 1, 0.55) for u, i in rows[18:]]
    m = fit(pairs, 2, 40, q0=_q0(spark, lean))
    s = {(r.user_id, r.item_id): r.score for r in score_pairs(m).collect()}
    assert max(s[(u, i)] for u in a_users for i in b_items) < 1e-6
    assert min(s[(u, i)] for u in a_users for i in a_items) > 0.3


CSV = """user_id,user_username,movie_id,rating
u-11,Petra,m-501,4
u-12,Okan,m-502,2
u-12,Okan,m-502,5
u-13,"Vale, R",m-503,1
u-14,Lim
,Noor,m-501,3
u-15,Sena,m-502,4"""

OTHER_LAYOUT = """userId,movieId,rating,timestamp
41,7001,3.5,1111111111
42,7002,4.0,1111111112
42,7002,1.0,1111111113
x,7003,2.0,1111111114"""


def _written(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_csv_source_binds_by_name(spark, tmpdir_local):
    raw = read_interactions(spark, _written(tmpdir_local, "other.csv", OTHER_LAYOUT))
    pairs = to_pairs(raw, "userId", "movieId")
    assert sorted(tuple(r) for r in pairs.collect()) == [("41", "7001"), ("42", "7002"), ("x", "7003")]
    numbers = to_pairs(raw, "userId", "movieId", "bigint")
    assert sorted(tuple(r) for r in numbers.collect()) == [(41, 7001), (42, 7002)]
    assert tuple(dropped_rows(raw, "userId", "movieId", "bigint").first()) == (4, 1)
    bare = _written(tmpdir_local, "bare.csv", "7,a\n8,b\n")
    named = read_interactions(spark, bare, header=False, columns=["who", "what"])
    assert sorted(tuple(r) for r in to_pairs(named, "who", "what").collect()) == [("7", "a"), ("8", "b")]


def test_read_table_infers_types(spark, tmpdir_local):
    path = _written(tmpdir_local, "movies.csv", "movieId,title,genres\n7001,Quiet Hill,Drama|Short\n")
    assert [tuple(r) for r in read_table(spark, path).collect()] == [(7001, "Quiet Hill", "Drama|Short")]


def test_csv_source_edge_cases(spark, tmpdir_local):
    raw = read_interactions(spark, _written(tmpdir_local, "ratings.csv", CSV))
    assert raw.count() == 7
    assert tuple(dropped_rows(raw).first()) == (7, 2)
    pairs = to_pairs(raw)
    got = sorted(tuple(r) for r in pairs.collect())
    assert got == [("u-11", "m-501"), ("u-12", "m-502"), ("u-13", "m-503"), ("u-15", "m-502")]
    sh = shape(pairs).first()
    assert (sh.n_rows, sh.n_columns, sh.n_users, sh.n_items) == (4, 2, 4, 3)
    assert [tuple(r) for r in preview(pairs, 2).collect()] == [("u-11", "m-501"), ("u-12", "m-502")]


def test_write_predictions_round_trip(spark, tiny, tmpdir_local):
    _, m = tiny
    _, preds = predict(m, quantile=0.5)
    for fmt in ("parquet", "csv"):
        path = os.path.join(tmpdir_local, f"pred_{fmt}")
        write_predictions(preds, path, fmt=fmt)
        with pytest.raises(AnalysisException):
            write_predictions(preds, path, fmt=fmt)
        write_predictions(preds, path, fmt=fmt, mode="overwrite")
        if fmt == "parquet":
            back = spark.read.parquet(path)
        else:
            back = spark.read.option("header", True).option("inferSchema", True).csv(path)
        assert back.count() == 4
        assert back.where(F.col("recommended")).count() == preds.where(F.col("recommended")).count()
        assert set(back.columns) == {USER, ITEM, "score", "recommended"}


def test_class_without_mass_takes_no_part(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x")]
    pairs = spark.createDataFrame(rows, "user_id string, item_id string")
    q0 = _q0(spark, [(u, i, z, 1.0 - z) for u, i in rows for z in (0, 1)])
    m = fit(pairs, 2, 3, q0=q0)
    assert all(math.isfinite(r[2]) for r in m.history_rows)
    assert m.class_mass == pytest.approx([3.0, 0.0])
    assert {r.p for r in m.p_item_given_class().where("z = 1").collect()} == {0.0}
    scores = {(r.user_id, r.item_id): r.score for r in score_pairs(m).collect()}
    assert scores[("b", "y")] == pytest.approx(1 / 3)


def test_empty_input_is_an_error(spark):
    with pytest.raises(ValueError, match="no pairs"):
        fit(spark.createDataFrame([], "user_id string, item_id string"), 2, 1)


@pytest.mark.parametrize(
    "broken",
    [
        [("a", "x", 0, 0.5)],  # a class is missing
        [("a", "x", 0, 0.5), ("a", "x", 1, 0.6)],  # sum is not 1
        [("a", "x", 0, 1.5), ("a", "x", 1, -0.5)],  # not probabilities
        [("a", "x", 0, 0.5), ("a", "x", 0, 0.5), ("a", "x", 1, 0.5)],  # given twice
        [("b", "x", 0, 0.5), ("b", "x", 1, 0.5)],  # another pair
    ],
)
def test_given_start_is_checked(spark, broken):
    with pytest.raises(ValueError, match="q0"):
        fit(spark.createDataFrame([("a", "x")], "user_id string, item_id string"), 2, 1, q0=_q0(spark, broken))


def test_grid_is_split_by_cells_and_never_broadcast(spark, monkeypatch):
    from latentrec.operators import scoring

    monkeypatch.setattr(scoring, "ITEM_BLOCK", 4)
    monkeypatch.setattr(scoring, "CELLS_PER_PARTITION", 100)
    users = spark.range(60).select(F.col("id").alias(USER))
    items = spark.range(50).select(F.col("id").alias(ITEM))
    want = {(u, i) for u in range(60) for i in range(50)}
    for limit in (0, 2**20):
        grid = scoring.all_items_for_each_user(users, items, broadcast_limit=limit)
        assert {tuple(r) for r in grid.collect()} == want and grid.count() == len(want)
        plan = grid._jdf.queryExecution().executedPlan().toString()
        # the blocks of items are the build side, or there is no broadcast at all
        assert ("BuildRight" in plan) == ("BroadcastExchange" in plan) == (limit > 0)
        assert "BuildLeft" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(scoring, "CELLS_PER_PARTITION", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scoring.all_items_for_each_user(users, items).rdd.getNumPartitions() == 150
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bucket_count_stays_under_the_session_limit(spark):
    rows = [(u, i) for u in range(40) for i in range(5)]
    pairs = spark.createDataFrame(rows, "user_id long, item_id long")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "10")
    try:
        layout = plan_layout(pairs, 2, broadcast_limit=0, rows_per_partition=2)
        assert layout.partitions <= 10
        a, b = fit(layout, 2, 2), fit(pairs, 2, 2)
        assert a.history_rows[-1][2] == pytest.approx(b.history_rows[-1][2])
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_sweep_and_close_leave_nothing(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def left():
        return {s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("latentrec-")}

    before, tables = left(), {t.name for t in spark.catalog.listTables()}
    pairs = spark.createDataFrame([(u, i) for u in range(20) for i in range(u % 5 + 1)], "user_id long, item_id long")
    sweep(pairs, [2, 3], 2)
    fit(pairs, 2, 2, broadcast_limit=0).close()
    assert left() == before
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_sweep_in_groups_equals_single_fits(spark, monkeypatch):
    from latentrec.plans import sweep as fused

    rows = [(f"u{u}", f"i{(u * 7 + j * j) % 13}") for u in range(30) for j in range(u % 4 + 1)]
    pairs = spark.createDataFrame(rows, "user_id string, item_id string").distinct()
    assert fused.groups([5, 3, 4, 10], 12) == [[3, 4, 5], [10]]
    monkeypatch.setattr(fused.groups, "__defaults__", (8,))
    got = {(r.k, r.iteration): r.mean_log_likelihood for r in sweep(pairs, [4, 2, 3], 3, seed=3).collect()}
    for k in (2, 3, 4):
        for row in fit(pairs, k, 3, seed=3).history_rows:
            assert got[k, row[1]] == pytest.approx(row[2], abs=1e-12)


def test_account_of_dropped_rows_from_the_scan_of_the_fit(spark):
    from latentrec.sources.interactions import accounted_pairs

    rows = [("1", "10"), ("1", "10"), ("2", "11"), (None, "10"), ("3", None), (None, None), ("x", "10"), ("4", "y"), ("z", "y")]
    rows += [(str(u), str(i)) for u in range(5) for i in range(20, 24)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    source = spark.createDataFrame(rows, "u string, i string")
    pairs, account = accounted_pairs(source.mapInPandas(count, source.schema), "u", "i", "bigint")
    layout = plan_layout(pairs, 2)
    assert seen.value == len(rows)  # one scan for the pairs and the account
    want = {"n_rows": 29, "n_kept": 23, "no_user": 2, "no_item": 1, "bad_user": 2, "bad_item": 1}
    assert account.counts == want
    assert account.table().first().asDict() == want
    assert layout.n_pairs == 22 == to_pairs(source, "u", "i", "bigint").count()
    plain, account = accounted_pairs(source, "u", "i")
    assert plain.count() == 25 and account.counts["bad_user"] == account.counts["bad_item"] == 0
