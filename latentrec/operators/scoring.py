"""Scoring every user against every item, score summaries and flags.

The grid of all (user, item) combinations is the result the recommender
exists to produce, so its size, n_users x n_items, is the output size, and
summaries over it read as many cells. Items are packed into blocks of about
``ITEM_BLOCK`` rows. When the blocks are under the broadcast limit (their size
is known exactly), users are dealt to tasks once, by the number of cells, and
each task walks the blocks: a row per user is exchanged, and user and block
meet and are expanded to cells inside the task. Otherwise both sides are
hash-partitioned by (block, user salt) and merge-joined, so neither is ever a
broadcast side.

Where only cells within score bounds are wanted, see ``pruning``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER, class_cols, dlit, long_form
from latentrec.operators import em
from latentrec.operators.quantile import summarize
from latentrec.plans.layout import DEFAULT_BROADCAST_LIMIT, factor_row_bytes, ids_are_integral

ITEM_BLOCK = 1_024
CELLS_PER_PARTITION = 2_000_000

BLOCK = "_block"
SALT = "_salt"


def user_list(pairs: DataFrame) -> DataFrame:
    """Distinct users of the pairs."""
    return pairs.select(USER).distinct()


def item_list(pairs: DataFrame) -> DataFrame:
    """Distinct items of the pairs."""
    return pairs.select(ITEM).distinct()


def all_items_for_each_user(
    users: DataFrame,
    items: DataFrame,
    n_users: int | None = None,
    n_items: int | None = None,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    row_bytes: int = 32,
) -> DataFrame:
    """Every ``users`` row combined with every ``items`` row; the keys must be unique."""
    n_users = users.count() if n_users is None else n_users
    n_items = items.count() if n_items is None else n_items
    n_blocks = max(1, math.ceil(n_items / ITEM_BLOCK))
    floor = users.sparkSession.sparkContext.defaultParallelism
    parts = max(floor, math.ceil(n_users * n_items / CELLS_PER_PARTITION))
    parts = max(1, min(parts, n_users * n_blocks))
    block = F.pmod(F.xxhash64(ITEM), F.lit(n_blocks)).cast("int").alias(BLOCK)
    packed = items.select("*", block).groupBy(BLOCK).agg(F.collect_list(F.struct(*items.columns)).alias("_items"))
    if n_items * row_bytes <= broadcast_limit:
        walked = walk_blocks(users, n_users, n_blocks, parts)
        joined = walked.join(F.broadcast(packed), BLOCK)
    else:
        expanded = users.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias(BLOCK))
        joined = join_blocks(expanded, packed, n_blocks, parts)
    return joined.select(*users.columns, F.inline("_items"))


def walk_blocks(users: DataFrame, n_users: int, n_blocks: int, parts: int) -> DataFrame:
    """``users`` with each block number, in ``parts`` tasks; what is exchanged is a row per user.

    Only where there are fewer users than tasks a user's blocks are dealt to
    several tasks, and as many rows are exchanged.
    """
    shares = max(1, min(n_blocks, math.ceil(parts / max(1, n_users))))
    if shares == 1:
        dealt, first = users.repartition(min(parts, max(1, n_users)), USER), F.lit(0)
    else:
        split = users.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias(SALT))
        dealt, first = split.repartition(parts, USER, SALT), F.col(SALT)
    return dealt.select(*users.columns, F.explode(F.sequence(first, F.lit(n_blocks - 1), F.lit(shares))).alias(BLOCK))


def join_blocks(expanded: DataFrame, packed: DataFrame, n_blocks: int, parts: int) -> DataFrame:
    """(user, block) rows with their blocks, by an exchange of both sides on (block, user salt)."""
    salts = math.ceil(parts / n_blocks)
    salted = expanded.withColumn(SALT, F.pmod(F.xxhash64(USER), F.lit(salts)).cast("int"))
    copies = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(SALT))
    key = [BLOCK, SALT]
    return salted.repartition(parts, *key).hint("merge").join(copies.repartition(parts, *key).hint("merge"), key)


def candidate_grid(pairs: DataFrame, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``(user_id, item_id)`` for all users and all items seen in ``pairs``."""
    return all_items_for_each_user(
        user_list(pairs), item_list(pairs), broadcast_limit=broadcast_limit, row_bytes=factor_row_bytes(0, ids_are_integral(pairs))
    )


def _factor_grid(model, broadcast_limit: int) -> DataFrame:
    return all_items_for_each_user(
        model.user_factors(),
        model.item_factors(),
        model.layout.n_users,
        model.layout.n_items,
        broadcast_limit,
        model_row_bytes(model),
    )


def model_row_bytes(model) -> int:
    return factor_row_bytes(model.k, ids_are_integral(model.state))


def score_pairs(model, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``(user_id, item_id, score)`` with score = p(s|u) = sum_z p(z|u) p(s|z)."""
    return _factor_grid(model, broadcast_limit).selectExpr(USER, ITEM, f"{em.psu_sql(model.k)} AS score")


def score_components(model, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``(user_id, item_id, z, score)`` with score = p(z|u) p(s|z), one row per class."""
    g = _factor_grid(model, broadcast_limit).selectExpr(
        USER, ITEM, *[f"{p} AS _c{z}" for z, p in enumerate(em.product_sql(model.k))]
    )
    return long_form(g, [USER, ITEM], class_cols("_c", model.k), "score")


def score_known_pairs(model, pairs: DataFrame) -> DataFrame:
    """Scores of given ``(user_id, item_id)`` rows (equi-joins, no grid)."""
    users, items = model.user_factors(), model.item_factors()
    lay = model.layout
    u = F.broadcast(users) if lay.broadcast_users else users
    i = F.broadcast(items) if lay.broadcast_items else items
    joined = pairs.select(USER, ITEM).join(u, USER).join(i, ITEM)
    return joined.selectExpr(USER, ITEM, f"{em.psu_sql(model.k)} AS score")


def joint_probability(model, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``(user_id, item_id, p_joint)`` with P(u,s) = sum_z P(z) P(u|z) P(s|z).

    With P(z) = N(z)/T, P(u|z) = N(u,z)/N(z), P(s|z) = N(s,z)/N(z) this is
    sum_z N(u,z) p(s|z) / T, T = sum_z N(z).
    """
    k = model.k
    total = float(sum(model.class_mass))
    user_rows = model.state.where(F.col("gid") == em.USER_ROW).selectExpr(
        USER, *[f"{em.N}{z} / {dlit(total)} AS {em.PU}{z}" for z in range(k)]
    )
    g = all_items_for_each_user(
        user_rows, model.item_factors(), model.layout.n_users, model.layout.n_items, broadcast_limit, model_row_bytes(model)
    )
    return g.selectExpr(USER, ITEM, f"{em.psu_sql(k)} AS p_joint")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]: ``(bin, bin_lo, bin_hi, n)``.

    Bins are closed on the left, the last one also on the right; empty bins
    are listed with n = 0. At most two scans, which quantiles may share (see
    ``quantile.summarize``).
    """
    return summarize(df, col, bins=bins).histogram


def flag(scores: DataFrame, threshold: float, col: str = "score") -> DataFrame:
    """Add ``recommended = score >= threshold`` (inclusive)."""
    return scores.withColumn("recommended", F.col(col) >= F.lit(float(threshold)))
