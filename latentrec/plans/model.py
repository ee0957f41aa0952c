"""EM fit driver: a short loop of Spark jobs over a fixed pair layout.

Each iteration is one job: the pairs join p(z|u) and p(s|z) (broadcast or
co-partitioned, see ``layout``), the E-step is row arithmetic, and one
grouping-sets aggregate produces the next M-step sums together with the
log-likelihood of the current parameters. The small result is written as
parquet in the session's shared folder, which cuts the lineage so plans stay
the same size in every iteration and a lost executor only costs the current
iteration. Only K + 3 numbers per iteration come back to the driver: N(z) and
the log-likelihood, needed for the next p(s|z) and for the stopping rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentrec.functions.columns import ITEM, USER, class_cols, long_form, row_sum
from latentrec.operators import em
from latentrec.operators.init import check_given_posterior, wide_given_posterior, with_start_posterior
from latentrec.plans.layout import (
    DEFAULT_BROADCAST_LIMIT,
    DEFAULT_ROWS_PER_PARTITION,
    PairLayout,
    cut_lineage,
    drop_written,
    ids_are_integral,
    plan_layout,
)
from latentrec.plans.sweep import MAX_COLUMNS, fit_ragged

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("k", T.LongType(), False),
        T.StructField("iteration", T.LongType(), False),
        T.StructField("mean_log_likelihood", T.DoubleType(), True),
        T.StructField("total_log_likelihood", T.DoubleType(), True),
        T.StructField("n_pairs", T.LongType(), False),
    ]
)


@dataclass
class PlsiModel:
    """Fitted parameters of the last M-step and the likelihood curve."""

    k: int
    layout: PairLayout
    state: DataFrame
    class_mass: list[float]
    history_rows: list[tuple] = field(default_factory=list)

    # ---- parameters, wide (one row per user / item) -------------------------
    def user_factors(self) -> DataFrame:
        """``(user_id, pu_0..pu_{K-1})`` = p(z|u)."""
        return em.user_factors(self.state, self.k)

    def item_factors(self) -> DataFrame:
        """``(item_id, pi_0..pi_{K-1})`` = p(s|z)."""
        return em.item_factors(self.state, self.k, self.class_mass)

    # ---- parameters and sums, long (one row per key and class) --------------
    def p_class_given_user(self) -> DataFrame:
        return long_form(self.user_factors(), [USER], class_cols(em.PU, self.k), "p")

    def p_item_given_class(self) -> DataFrame:
        return long_form(self.item_factors(), [ITEM], class_cols(em.PI, self.k), "p")

    def user_class_mass(self) -> DataFrame:
        rows = self.state.where(F.col("gid") == em.USER_ROW)
        return long_form(rows, [USER], class_cols(em.N, self.k), "n")

    def item_class_mass(self) -> DataFrame:
        rows = self.state.where(F.col("gid") == em.ITEM_ROW)
        return long_form(rows, [ITEM], class_cols(em.N, self.k), "n")

    def user_mass(self) -> DataFrame:
        rows = self.state.where(F.col("gid") == em.USER_ROW)
        return rows.select(USER, row_sum(class_cols(em.N, self.k)).alias("n"))

    def class_mass_table(self) -> DataFrame:
        """``(z, n)``: N(z), the total row of the M-step sums."""
        rows = self.state.where(F.col("gid") == em.TOTAL_ROW)
        return long_form(rows, [], class_cols(em.N, self.k), "n")

    # ---- E-step outputs on the training pairs ------------------------------
    def _joined(self) -> DataFrame:
        return self.layout.attach(self.user_factors(), self.item_factors())

    def pair_products(self) -> DataFrame:
        """``(user_id, item_id, z, pzu, psz, product)`` for every pair and class."""
        k = self.k
        j = self._joined().select(
            USER, ITEM,
            F.arrays_zip(
                F.array(*[F.col(f"{em.PU}{z}") for z in range(k)]).alias("pzu"),
                F.array(*[F.col(f"{em.PI}{z}") for z in range(k)]).alias("psz"),
            ).alias("_c"),
        )
        e = j.select(USER, ITEM, F.posexplode("_c").alias("z", "_v"))
        return e.select(
            USER, ITEM, F.col("z").cast("bigint").alias("z"),
            F.col("_v.pzu").alias("pzu"), F.col("_v.psz").alias("psz"),
            (F.col("_v.pzu") * F.col("_v.psz")).alias("product"),
        )

    def pair_likelihood(self) -> DataFrame:
        """``(user_id, item_id, psu)`` with psu = p(s|u) = sum_z p(z|u) p(s|z)."""
        return self._joined().selectExpr(USER, ITEM, f"{em.psu_sql(self.k)} AS psu")

    def posterior(self) -> DataFrame:
        """Next posterior ``(user_id, item_id, z, q)`` from the fitted parameters."""
        e = em.e_step(self._joined(), self.k, keep=[USER, ITEM])
        return long_form(e, [USER, ITEM], class_cols(em.Q, self.k), "q")

    def close(self) -> None:
        """Delete the stored parameters and the layout's tables."""
        drop_written(self.state)
        self.layout.close()

    # ---- likelihood curve --------------------------------------------------
    def history(self) -> DataFrame:
        spark = self.state.sparkSession
        return spark.createDataFrame(self.history_rows, HISTORY_SCHEMA)

    @property
    def log_likelihoods(self) -> list[float]:
        return [r[2] for r in self.history_rows]


def _history_row(k: int, iteration: int, ll, n_ll, n_pairs) -> tuple:
    n_pairs = int(n_pairs or 0)
    if n_pairs == 0:
        return (k, iteration, None, None, 0)
    # A pair with p(s|u) = 0 has log -inf; Spark's ln gives null, so count them.
    total = float(ll) if int(n_ll or 0) == n_pairs else -math.inf
    return (k, iteration, total / n_pairs, total, n_pairs)


def fit(
    pairs: DataFrame | PairLayout,
    k: int,
    n_iter: int = 20,
    tol: float | None = None,
    init: str = "hashed",
    seed: int = 0,
    q0: DataFrame | None = None,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
) -> PlsiModel:
    """Fit p(s|z) and p(z|u) by ``n_iter`` EM iterations (M-step then E-step).

    ``tol``: stop after iteration t >= 2 when the mean log-likelihood gained
    at most ``tol`` over iteration t-1; the parameters returned are then
    those of iteration t (the ones behind the last history row).
    ``q0``: optional long start ``(user_id, item_id, z, q)``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if n_iter < 1:
        raise ValueError("n_iter must be at least 1")
    if isinstance(pairs, PairLayout):
        layout = pairs
    else:
        rank = init == "weighted" and q0 is None and not ids_are_integral(pairs)
        layout = plan_layout(pairs, k, broadcast_limit, rows_per_partition, rank_ids=rank)
    if init == "weighted" and q0 is None and not ids_are_integral(layout.pairs.select(USER, ITEM)):
        if layout.user_rank == USER:
            raise ValueError("weighted start on string ids needs a layout planned with rank_ids=True")

    if layout.n_pairs == 0:
        raise ValueError("no pairs to fit: the interactions are empty or every row lacks an id")
    qcols = class_cols(em.Q, k)
    if q0 is not None:
        check_given_posterior(q0, layout.pairs, k)
        start = layout.pairs.select(USER, ITEM).join(wide_given_posterior(q0, k), [USER, ITEM], "left")
        start = start.select(USER, ITEM, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in qcols])
    else:
        start = with_start_posterior(
            layout.pairs, k, init, seed, layout.user_rank, layout.item_rank
        ).select(USER, ITEM, *qcols)

    wide = k > em.MAX_UNROLLED
    if wide:
        start = start.select(USER, ITEM, F.array(*qcols).alias(em.Q))
    state = cut_lineage(em.array_sums(start, k) if wide else em.m_step_sums(start, k))
    summary = em.state_summary(state)
    class_mass = [float(summary[f"{em.N}{z}"] or 0.0) for z in range(k)]

    history: list[tuple] = []
    for t in range(1, n_iter + 1):
        users = em.user_factors(state, k)
        items = em.item_factors(state, k, class_mass)
        if wide:
            users, items = em.packed(users, USER, em.PU, k), em.packed(items, ITEM, em.PI, k)
        joined = layout.attach(users, items)
        if t < n_iter:
            if wide:
                sums = em.array_sums(joined, k)
            else:
                sums = em.m_step_sums(em.e_step(joined, k, keep=[USER, ITEM]), k)
            next_state = cut_lineage(sums)
            s = em.state_summary(next_state)
            history.append(_history_row(k, t, s["ll"], s["n_ll"], s["n_pairs"]))
        else:
            s = em.array_loglik(joined) if wide else em.loglik_only(joined, k)
            history.append(_history_row(k, t, s["ll"], s["n_ll"], s["n_pairs"]))
            next_state = None
        if tol is not None and t >= 2 and _gain(history) <= tol:
            drop_written(next_state)
            break
        if next_state is not None:
            drop_written(state)
            state = next_state
            class_mass = [float(s[f"{em.N}{z}"] or 0.0) for z in range(k)]
    return PlsiModel(k=k, layout=layout, state=state, class_mass=class_mass, history_rows=history)


def _gain(history: list[tuple]) -> float:
    prev, cur = history[-2][2], history[-1][2]
    if prev is None or cur is None:
        return math.inf
    return cur - prev


def sweep(
    pairs: DataFrame,
    ks: list[int],
    n_iter: int = 20,
    init: str = "hashed",
    seed: int = 0,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
    tol: float | None = None,
) -> DataFrame:
    """Likelihood curves for several K on one stored pair layout.

    One pass over the pairs serves all K that run at the time (see
    ``latentrec.plans.sweep``). With ``tol`` each K stops as in ``fit``, and
    its columns go to the next K.
    """
    rank = init == "weighted" and not ids_are_integral(pairs)
    widest = max([min(sum(set(ks)), MAX_COLUMNS), *ks], default=1)
    layout = plan_layout(pairs, widest, broadcast_limit, rows_per_partition, rank_ids=rank)
    if layout.n_pairs == 0:
        raise ValueError("no pairs to fit: the interactions are empty or every row lacks an id")
    found = fit_ragged(layout, ks, n_iter, init, seed, tol)
    rows = {(k, t): _history_row(k, t, ll, n_ll, n_pairs) for k, t, ll, n_ll, n_pairs in found}
    ordered = [rows[k, t] for k in ks for t in range(1, n_iter + 1) if (k, t) in rows]
    out = layout.pairs.sparkSession.createDataFrame(ordered, HISTORY_SCHEMA)
    layout.close()
    return out
