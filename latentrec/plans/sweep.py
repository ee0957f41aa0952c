"""Likelihood curves for several numbers of classes in shared passes.

A row carries the class columns of all K of a pass next to each other
(``q3_0 .. q3_2, q4_0 .. q4_3, ...``), so one iteration of all of them is one
pass over the pairs, one pair of joins and one aggregate. A pass is as wide as
``MAX_COLUMNS`` class columns: far wider rows make generated methods that the
JVM no longer compiles. Passes are ragged: a K that has had its iterations, or
has stopped gaining, leaves its columns to the next one that waits, which
starts in the same pass in which the others go on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from latentrec.functions.columns import ITEM, USER, dlit, sql_sum
from latentrec.operators import em
from latentrec.operators.init import with_start_posterior
from latentrec.plans.layout import PairLayout, cut_lineage, drop_written

MAX_COLUMNS = 50


def groups(ks: list[int], width: int = MAX_COLUMNS) -> list[list[int]]:
    """Consecutive K whose class columns fit into ``width`` together (a larger K stands alone)."""
    out: list[list[int]] = []
    for k in sorted(set(ks)):
        if out and sum(out[-1]) + k <= width:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def cols(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{k}_{z}" for z in range(k)]


def admit(waiting: list[int], free: int, idle: bool) -> list[int]:
    """The K to start next: the largest that fit into ``free`` columns; if none is running, the largest in any case."""
    out: list[int] = []
    for k in sorted(waiting, reverse=True):
        if k <= free or (idle and not out):
            out.append(k)
            free -= k
    return out


def _likelihoods(ks) -> list[str]:
    return [f"{f}(ll{k}) AS {name}{k}" for k in ks for f, name in (("sum", "ll"), ("count", "nll"))]


def _sums(posterior: DataFrame, ks: list[int], running: list[int]) -> DataFrame:
    """N(u,z), N(s,z) and N(z) of every K, with the likelihood sums of those running, as in ``em.m_step_sums``."""
    sums = [f"sum({q}) AS {n}" for k in ks for q, n in zip(cols("q", k), cols("n", k))] + _likelihoods(running)
    grouped = posterior.groupingSets([[USER], [ITEM], []], USER, ITEM)
    return grouped.agg(*[em.F.expr(x) for x in (*sums, "count(1) AS n_pairs", "grouping_id() AS gid")])


def _users(state: DataFrame, ks: list[int]) -> DataFrame:
    rows = state.where(f"gid = {em.USER_ROW}").selectExpr(
        USER, *[c for k in ks for c in cols("n", k)], *[f"{sql_sum(cols('n', k))} AS _nu{k}" for k in ks]
    )
    shares = [
        f"coalesce(try_divide({n}, _nu{k}), 0.0D) AS {p}" for k in ks for n, p in zip(cols("n", k), cols("pu", k))
    ]
    return rows.selectExpr(USER, *shares)


def _items(state: DataFrame, ks: list[int], total) -> DataFrame:
    shares = [
        f"coalesce(try_divide({n}, {dlit(total[n] or 0.0)}), 0.0D) AS {p}"
        for k in ks
        for n, p in zip(cols("n", k), cols("pi", k))
    ]
    return state.where(f"gid = {em.ITEM_ROW}").selectExpr(ITEM, *shares)


def _e_step(joined: DataFrame, ks: list[int], posterior: bool, keep: list[str]) -> DataFrame:
    products = [
        f"{u} * {i} AS {p}" for k in ks for u, i, p in zip(cols("pu", k), cols("pi", k), cols("_p", k))
    ]
    with_sum = joined.selectExpr(*keep, *products).selectExpr("*", *[f"{sql_sum(cols('_p', k))} AS psu{k}" for k in ks])
    lls = [f"{em.ln_sql(f'psu{k}')} AS ll{k}" for k in ks]
    if not posterior:
        return with_sum.selectExpr(*lls)
    shares = [f"coalesce(try_divide({p}, psu{k}), 0.0D) AS {q}" for k in ks for p, q in zip(cols("_p", k), cols("q", k))]
    return with_sum.selectExpr(*keep, *shares, *lls)


def mean_likelihood(ll, n_ll, n_pairs) -> float:
    """-inf where some pair has no likelihood (its logarithm is null in Spark)."""
    return float(ll) / n_pairs if int(n_ll or 0) == n_pairs else -math.inf


def fit_ragged(
    layout: PairLayout, ks: list[int], n_iter: int, init: str, seed: int, tol: float | None = None, width: int = MAX_COLUMNS
) -> list[tuple]:
    """``(k, iteration, total log-likelihood, pairs with one, pairs)`` of each K and iteration.

    With ``tol`` a K stops after an iteration t >= 2 that gained at most ``tol``, as in ``fit``.
    """
    keep = list(dict.fromkeys([USER, ITEM, layout.user_rank, layout.item_rank]))
    waiting = sorted(set(ks))
    running: dict[int, int] = {}  # K and the iteration whose likelihood the next pass gives
    means: dict[int, float] = {}
    out: list[tuple] = []
    state = total = None
    while waiting or running:
        starting = admit(waiting, width - sum(running), idle=not running)
        waiting = [k for k in waiting if k not in starting]
        rows, last = layout.pairs.select(*keep), False
        if running:
            joined = layout.attach(_users(state, list(running)), _items(state, list(running), total))
            last = not starting and all(t == n_iter for t in running.values())  # no parameters after this pass
            rows = _e_step(joined, list(running), not last, keep)
        for k in starting:
            rows = with_start_posterior(rows, k, init, seed, layout.user_rank, layout.item_rank, prefix=f"q{k}_")
        if last:
            after = None
            s = rows.agg(*[em.F.expr(x) for x in (*_likelihoods(running), "count(1) AS n_pairs")]).collect()[0]
        else:
            after = cut_lineage(_sums(rows, [*running, *starting], list(running)))
            s = em.state_summary(after)
        ended = []
        for k, t in running.items():
            out.append((k, t, s[f"ll{k}"], s[f"nll{k}"], s["n_pairs"]))
            mean = mean_likelihood(s[f"ll{k}"], s[f"nll{k}"], s["n_pairs"])
            if t == n_iter or (tol is not None and t >= 2 and mean - means[k] <= tol):
                ended.append(k)
            means[k] = mean
        running = {k: t + 1 for k, t in running.items() if k not in ended} | dict.fromkeys(starting, 1)
        drop_written(state)
        state, total = after, s
    drop_written(state)
    return out
