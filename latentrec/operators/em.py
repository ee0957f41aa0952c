"""EM building blocks in the wide layout (one row per pair, K class columns).

M-step sums  N(s,z) = sum_u q,  N(u,z) = sum_s q  and  N(z) = sum q  come from
one grouping-sets aggregate over (user), (item) and () : a single scan and one
shuffle of partially aggregated rows. N(u) is the sum of a user row's K
columns. The E-step is row arithmetic once a pair row carries p(z|u) and
p(s|z):

    prod_z = p(z|u) * p(s|z),   p(s|u) = sum_z prod_z,   q_z = prod_z / p(s|u)

Expressions are written as SQL text and handed over in one call per
projection: with K columns, building them as Column objects costs thousands
of driver-JVM round trips per iteration for no change in the plan.

Beyond ``MAX_UNROLLED`` classes the generated methods would be longer than the
JVM compiles, and every row would be interpreted. There, a pair row carries
p(z|u) and p(s|z) as two arrays, and ``array_sums`` does the E-step and the
partial sums of a batch of rows on whole matrices; joins, the shuffle of the
partial sums and the state are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER, dlit, sql_sum

# grouping_id() of groupingSets([[user], [item], []], user, item): bit 1 is
# user_id, bit 0 is item_id; a set bit means "aggregated away".
USER_ROW = 1
ITEM_ROW = 2
TOTAL_ROW = 3

MAX_UNROLLED = 50  # classes up to which sums and products are columns of generated code

Q = "q_"  # posterior q(z|u,s)
PU = "pu_"  # p(z|u)
PI = "pi_"  # p(s|z)
N = "n_"  # class mass sums N(.,z)


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{z}" for z in range(k)]


def product_sql(k: int) -> list[str]:
    """``p(z|u) * p(s|z)`` for each class, as SQL text."""
    return [f"{PU}{z} * {PI}{z}" for z in range(k)]


def psu_sql(k: int) -> str:
    """p(s|u) = sum_z p(z|u) p(s|z), as SQL text."""
    return " + ".join(f"({p})" for p in product_sql(k))


def ln_sql(x: str) -> str:
    """ln(x) for x > 0, else null (Spark's ln(0) is null, not -inf: callers count)."""
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def e_step(joined: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """Add ``q_z``, ``psu`` and ``ll`` to rows that carry ``pu_z`` and ``pi_z``."""
    prods = joined.selectExpr(*keep, *[f"{p} AS _p{z}" for z, p in enumerate(product_sql(k))])
    return prods.selectExpr(
        *keep,
        f"{sql_sum(names('_p', k))} AS psu",
        *names("_p", k),
    ).selectExpr(
        *keep,
        *[f"coalesce(try_divide(_p{z}, psu), 0.0D) AS {Q}{z}" for z in range(k)],
        "psu",
        f"{ln_sql('psu')} AS ll",
    )


def m_step_sums(posterior: DataFrame, k: int) -> DataFrame:
    """Class mass per user, per item and in total, in one pass.

    Output rows: ``(user_id, item_id, n_0..n_{K-1}, ll, n_ll, n_pairs, gid)``.
    User rows (gid=1) hold N(u,z) and the log-likelihood of that user's pairs;
    item rows (gid=2) hold N(s,z); the single total row (gid=3) holds N(z) and
    the total log-likelihood. Partial aggregation runs map-side, so a user or
    item owning a third of all pairs still sends at most one row per map task
    through the shuffle.
    """
    ll = "ll" if "ll" in posterior.columns else "CAST(NULL AS DOUBLE)"
    return posterior.groupingSets([[USER], [ITEM], []], USER, ITEM).agg(
        *[F.expr(f"sum({Q}{z}) AS {N}{z}") for z in range(k)],
        F.expr(f"sum({ll}) AS ll"),
        F.expr(f"count({ll}) AS n_ll"),
        F.expr("count(1) AS n_pairs"),
        F.expr("grouping_id() AS gid"),
    )


def user_factors(state: DataFrame, k: int) -> DataFrame:
    """p(z|u) = N(u,z) / N(u), with N(u) = sum_z N(u,z); one row per user.

    N(u) is summed in a projection of its own. A user without mass gets 0.
    """
    rows = state.where(f"gid = {USER_ROW}").selectExpr(USER, *names(N, k), f"{sql_sum(names(N, k))} AS _nu")
    return rows.selectExpr(USER, *[f"coalesce(try_divide({N}{z}, _nu), 0.0D) AS {PU}{z}" for z in range(k)])


def item_factors(state: DataFrame, k: int, class_mass: list[float]) -> DataFrame:
    """p(s|z) = N(s,z) / N(z); N(z) is K numbers already summed by Spark.

    A class without mass has p(s|z) = 0 for every item and takes no part.
    """
    return state.where(f"gid = {ITEM_ROW}").selectExpr(
        ITEM, *[f"coalesce(try_divide({N}{z}, {dlit(class_mass[z])}), 0.0D) AS {PI}{z}" for z in range(k)]
    )


def state_summary(state: DataFrame):
    """The total row: N(z) for every z, total log-likelihood, counts.

    ``collect`` of the single matching row is one job; ``first`` would scan
    partitions in growing batches.
    """
    return state.where(f"gid = {TOTAL_ROW}").collect()[0]


def loglik_only(joined: DataFrame, k: int):
    """Global log-likelihood of rows carrying ``pu_z`` / ``pi_z`` (no M-step)."""
    return (
        joined.selectExpr(f"{psu_sql(k)} AS psu")
        .selectExpr(f"{ln_sql('psu')} AS ll")
        .agg(F.expr("sum(ll) AS ll"), F.expr("count(ll) AS n_ll"), F.expr("count(1) AS n_pairs"))
        .collect()[0]
    )


# ---- many classes -----------------------------------------------------------------


def packed(factors: DataFrame, key: str, prefix: str, k: int) -> DataFrame:
    """``(key, <prefix>)``: the K columns of a parameter row (or posterior) as one array."""
    return factors.select(key, F.array(*names(prefix, k)).alias(prefix))


def array_sums(rows: DataFrame, k: int) -> DataFrame:
    """As ``m_step_sums``, for rows with arrays: ``pu_`` and ``pi_``, or a given posterior ``q_``.

    Every batch is reduced to one row per user and per item in it and one total,
    inside the task, so what is shuffled are partial sums, as before.
    """
    given = Q in rows.columns
    ids = {c: rows.schema[c].dataType.simpleString() for c in (USER, ITEM)}
    values = [Q] if given else [PU, PI]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first, *second = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in values)
            if given:
                q, ll, known = first, np.zeros(len(first)), np.zeros(len(first), np.int64)
            else:
                q = first * second[0]
                psu = q.sum(1)
                known = (psu > 0).astype(np.int64)
                some = np.where(known, psu, 1.0)
                q, ll = np.where(known[:, None] > 0, q / some[:, None], 0.0), np.log(some)
            for gid, key in ((USER_ROW, USER), (ITEM_ROW, ITEM), (TOTAL_ROW, None)):
                if key is None:
                    keys, code = None, np.zeros(len(q), np.int64)
                else:
                    coded = b[key].dictionary_encode()
                    keys, code = coded.dictionary, coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                add = lambda x, order=order, starts=starts: np.add.reduceat(x[order], starts, axis=0)
                n = len(starts)
                own = {key: keys.take(pa.array(code[order][starts]))} if key else {}
                none = lambda c: pa.nulls(n, b.schema.field(c).type)  # noqa: B023, E731
                sums = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(add(q).ravel()))
                columns = [own.get(c, none(c)) for c in (USER, ITEM)]
                columns += [sums, pa.array(add(ll)), pa.array(add(known)), pa.array(add(np.ones(len(q), np.int64)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, gid, np.int64))], [*ids, "n", "ll", "n_ll", "n_pairs", "gid"])

    schema = ", ".join(f"{c} {t}" for c, t in ids.items())
    part = rows.select(*ids, *values).mapInArrow(run, f"{schema}, n array<double>, ll double, n_ll long, n_pairs long, gid long")
    sums = [F.expr(f"sum(n[{z}]) AS {N}{z}") for z in range(k)] + [F.expr(f"sum({c}) AS {c}") for c in ("ll", "n_ll", "n_pairs")]
    return part.groupBy(USER, ITEM, "gid").agg(*sums).select(USER, ITEM, *names(N, k), "ll", "n_ll", "n_pairs", "gid")


def array_loglik(joined: DataFrame):
    """As ``loglik_only``, for rows with arrays."""
    psu = f"aggregate(zip_with({PU}, {PI}, (x, y) -> x * y), 0D, (s, x) -> s + x) AS psu"
    sums = [F.expr("sum(ll) AS ll"), F.expr("count(ll) AS n_ll"), F.expr("count(1) AS n_pairs")]
    return joined.selectExpr(psu).selectExpr(f"{ln_sql('psu')} AS ll").agg(*sums).collect()[0]
