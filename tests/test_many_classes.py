"""More classes than generated code can hold unrolled: the same numbers from arrays."""

import pytest
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER
from latentrec.operators import em
from latentrec.plans.model import fit


@pytest.fixture(scope="module")
def pairs(spark):
    rows = {(f"u{u}", f"i{(u * 7 + j * j) % 29}") for u in range(40) for j in range(u % 9 + 1)}
    return spark.createDataFrame(sorted(rows), "user_id string, item_id string")


def params(model):
    out = {}
    for name in ("p_class_given_user", "p_item_given_class"):
        out |= {(name, *tuple(r)[:2]): r.p for r in getattr(model, name)().collect()}
    return out


@pytest.mark.parametrize("k,limit", [(3, 2**26), (3, 0), (60, 2**26)])
def test_arrays_equal_unrolled_columns(pairs, monkeypatch, k, limit):
    monkeypatch.setattr(em, "MAX_UNROLLED", 1_000)
    want = fit(pairs, k, 4, seed=2)
    monkeypatch.setattr(em, "MAX_UNROLLED", 2)
    got = fit(pairs, k, 4, seed=2, broadcast_limit=limit)
    assert [r[2] for r in got.history_rows] == pytest.approx([r[2] for r in want.history_rows], abs=1e-12)
    a, b = params(got), params(want)
    assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-12 for x in a)


def test_hundred_classes(pairs):
    model = fit(pairs, 100, 3, seed=1)
    assert model.k > em.MAX_UNROLLED
    lls = model.log_likelihoods
    assert all(b >= a - 1e-12 for a, b in zip(lls, lls[1:]))
    sums = model.p_item_given_class().groupBy("z").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 100 and all(abs(r.s - 1) < 1e-9 for r in sums)
    counts = {r[USER]: r["count"] for r in pairs.groupBy(USER).count().collect()}
    assert all(abs(r.n - counts[r[USER]]) < 1e-9 for r in model.user_mass().collect())


def test_zero_mass_in_arrays(spark, monkeypatch):
    """A class without mass stays empty, a pair without likelihood gives -inf, as unrolled."""
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], f"{USER} long, {ITEM} long")
    q0 = pairs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("z")).selectExpr("*", "CAST(1 - z AS DOUBLE) AS q")
    want = fit(pairs, 2, 3, q0=q0)
    monkeypatch.setattr(em, "MAX_UNROLLED", 1)
    got = fit(pairs, 2, 3, q0=q0)
    assert [r[2] for r in got.history_rows] == pytest.approx([r[2] for r in want.history_rows], abs=1e-12)
    assert params(got) == pytest.approx(params(want), abs=1e-12)
