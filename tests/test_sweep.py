"""Ragged passes of a sweep: the same curves as separate fits, in fewer passes."""

import pytest
from conftest import SF_MID

from latentrec.plans import sweep as ragged
from latentrec.plans.model import fit, sweep
from latentrec.sources.interactions import customer_brand_pairs, events_pairs


@pytest.fixture(scope="module")
def events(spark):
    return events_pairs(spark, SF_MID).cache()


def curves(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append((r.iteration, r.mean_log_likelihood))
    return out


@pytest.mark.parametrize("stops", [False, True])
def test_curves_equal_separate_fits(events, monkeypatch, stops):
    passes = []
    real = ragged.cut_lineage
    monkeypatch.setattr(ragged, "cut_lineage", lambda df, *a: passes.append(df.columns) or real(df, *a))
    monkeypatch.setattr(ragged.fit_ragged, "__defaults__", (None, 8))
    ks, n_iter, tol = [2, 5, 3, 4], 6, None
    if stops:  # at the second iteration, for the half that gains less
        gains = sorted(b - a for a, b in ([r[2] for r in fit(events, k, 2, init="weighted").history_rows] for k in ks))
        tol = (gains[1] + gains[2]) / 2
    got = curves(sweep(events, ks, n_iter, init="weighted", tol=tol))
    assert list(got) == ks
    for k in ks:
        want = fit(events, k, n_iter, tol=tol, init="weighted").history_rows
        assert [t for t, _ in got[k]] == [r[1] for r in want]
        assert [x for _, x in got[k]] == pytest.approx([r[2] for r in want], abs=1e-12)
    if not stops:
        assert len(passes) == 2 * n_iter  # 5 and 3 together, then 4 and 2
    else:
        assert any(len(x) < n_iter for x in got.values())  # some stopped
        assert len(passes) <= 2 * n_iter
    widths = [sum(c.startswith("n") and "_" in c and c != "n_pairs" for c in p) for p in passes]
    assert max(widths) <= 8
    assert (sum(widths) == sum(ks) * n_iter) != stops  # columns of those that stopped are not carried on


def test_a_waiting_k_takes_freed_columns(events, monkeypatch):
    """One of 3 and 2 stops first, and 1 starts in a pass in which the other goes on."""
    monkeypatch.setattr(ragged.fit_ragged, "__defaults__", (None, 5))
    means = {k: [r[2] for r in fit(events, k, 2, init="weighted").history_rows] for k in (3, 2)}
    tol = sum(b - a for a, b in means.values()) / 2
    starts = []
    real = ragged.with_start_posterior

    def spy(rows, k, *a, **b):
        starts.append((k, sorted(c for c in rows.columns if c.startswith("ll"))))
        return real(rows, k, *a, **b)

    monkeypatch.setattr(ragged, "with_start_posterior", spy)
    got = curves(sweep(events, [1, 2, 3], 6, init="weighted", tol=tol))
    first, later = sorted((3, 2), key=lambda k: len(got[k]))
    assert len(got[first]) == 2 < len(got[later]) and len(got[1]) == 2
    assert starts == [(3, []), (2, []), (1, [f"ll{later}"])]


def test_string_ids_and_one_wide_k(spark, monkeypatch):
    monkeypatch.setattr(ragged.fit_ragged, "__defaults__", (None, 3))
    pairs = customer_brand_pairs(spark, "/root/testdata/sf0.001")
    got = curves(sweep(pairs, [2, 4], 2, init="weighted"))
    for k in (2, 4):
        want = fit(pairs, k, 2, init="weighted").history_rows
        assert [x for _, x in got[k]] == pytest.approx([r[2] for r in want], abs=1e-12)


def test_admission():
    assert ragged.admit([3, 5, 4, 2], 8, True) == [5, 3]
    assert ragged.admit([4, 2], 3, False) == [2]
    assert ragged.admit([60, 2], 50, True) == [60]
    assert ragged.admit([60, 2], 50, False) == [2]
    assert ragged.admit([60], 50, False) == []
    nine, groups = [3, 4, 5, 10, 15, 20, 25, 30, 35], []
    while nine:
        groups.append(ragged.admit(nine, ragged.MAX_COLUMNS, True))
        nine = [k for k in nine if k not in groups[-1]]
    assert len(groups) == 3
