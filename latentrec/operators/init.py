"""Start posterior q0(z | u, s): one wide row per pair, K columns summing to 1.

Three starts:

* ``hashed`` (default) - uniform numbers from a hash of (seed, user, item, z),
  normalised per pair. Reproducible for any partitioning and retry.
* ``weighted`` - an integer weight rule used by the SQL oracle tests; needs
  integral ids (string ids are first replaced by their dense rank).
* ``given`` - a caller-supplied long table ``(user_id, item_id, z, q)``.

No shuffle is needed for the first two: every value is a function of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER, class_cols, row_sum, safe_div, unit_uniform

# Fixed values of the oracle start rule: w = (u*7919 + i*104729 + z*1299709) % 1009 + 1.
WEIGHT_USER_FACTOR = 7919
WEIGHT_ITEM_FACTOR = 104729
WEIGHT_CLASS_FACTOR = 1299709
WEIGHT_MODULUS = 1009

# Smallest positive increment that keeps a hashed weight away from exactly 0.
_TINY = 2.0**-53


def weighted_weights(k: int, user: Column, item: Column) -> list[Column]:
    """Integer start weights of the oracle rule, as doubles."""
    base = user * F.lit(WEIGHT_USER_FACTOR) + item * F.lit(WEIGHT_ITEM_FACTOR)
    return [
        (F.pmod(base + F.lit(z * WEIGHT_CLASS_FACTOR), F.lit(WEIGHT_MODULUS)) + 1).cast("double")
        for z in range(k)
    ]


def hashed_weights(k: int, seed: int, user: Column, item: Column) -> list[Column]:
    """Uniform start weights from a content hash (independent of partitioning)."""
    return [unit_uniform(seed, user, item, F.lit(z)) + F.lit(_TINY) for z in range(k)]


def posterior_columns(weights: list[Column], prefix: str = "q_") -> tuple[list[str], list[Column]]:
    """Names for K weight columns and the expressions normalising them to sum 1."""
    k = len(weights)
    names = class_cols("_w", k)
    total = row_sum(names)
    return names, [safe_div(F.col(n), total).alias(f"{prefix}{z}") for z, n in enumerate(names)]


def with_start_posterior(
    pairs: DataFrame,
    k: int,
    init: str = "hashed",
    seed: int = 0,
    user_key: str = USER,
    item_key: str = ITEM,
    prefix: str = "q_",
) -> DataFrame:
    """Add ``q_0..q_{K-1}`` to ``pairs`` for the ``hashed`` or ``weighted`` start.

    ``user_key`` / ``item_key`` name the integral columns the weighted rule
    reads (the ids themselves, or their dense ranks for string ids).
    """
    u, i = F.col(user_key), F.col(item_key)
    if init == "hashed":
        weights = hashed_weights(k, seed, F.col(USER), F.col(ITEM))
    elif init == "weighted":
        weights = weighted_weights(k, u.cast("bigint"), i.cast("bigint"))
    else:
        raise ValueError(f"unknown start {init!r}")
    names, posterior = posterior_columns(weights, prefix)
    with_w = pairs.select("*", *[w.alias(n) for w, n in zip(weights, names)])
    return with_w.select(*pairs.columns, *posterior)


def check_given_posterior(q0: DataFrame, pairs: DataFrame, k: int) -> None:
    """Raise unless ``q0`` has K values from 0 to 1 that sum to 1 for every pair, and no others.

    One aggregate per pair and one over them; only the number of bad pairs
    reaches the driver.
    """
    per_pair = q0.groupBy(USER, ITEM).agg(
        F.count("q").alias("_n"),
        F.count_distinct("z").alias("_nz"),
        F.min("z").alias("_z0"),
        F.max("z").alias("_z1"),
        F.min("q").alias("_q0"),
        F.sum("q").alias("_s"),
    )
    good = (F.col("_n") == k) & (F.col("_nz") == k) & (F.col("_z0") == 0) & (F.col("_z1") == k - 1)
    good = good & (F.col("_q0") >= 0) & (F.abs(F.col("_s") - 1) <= 1e-6)
    known = pairs.select(USER, ITEM, F.lit(1).alias("_known"))
    both = per_pair.join(known, [USER, ITEM], "full")
    bad = both.where(F.col("_known").isNull() | ~F.coalesce(good, F.lit(False))).count()
    if bad:
        raise ValueError(f"q0 does not fit {bad} pairs: each needs {k} values from 0 to 1, for z = 0..{k - 1}, with sum 1")


def wide_given_posterior(q0: DataFrame, k: int, prefix: str = "q_") -> DataFrame:
    """Pivot a long start ``(user_id, item_id, z, q)`` to one row per pair.

    One shuffle on (user, item), once per fit. ``check_given_posterior`` says
    whether the values make sense.
    """
    wide = q0.groupBy(USER, ITEM).pivot("z", list(range(k))).agg(F.first("q"))
    return wide.select(
        USER, ITEM, *[F.coalesce(F.col(str(z)), F.lit(0.0)).alias(f"{prefix}{z}") for z in range(k)]
    )
