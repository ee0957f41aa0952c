"""Cells of the score grid within score bounds, by branch and bound over item blocks.

Recommendations are the few cells at or above a threshold, so the grid need
not be expanded to find them. Items are put into blocks of items that are alike:
the same leading class, and about the same p(s|z) in it. A block knows the
greatest and the least p(s|z) of its items in each class; a user's scores in the
block lie between::

    sum_z p(z|u) least_z   and   sum_z p(z|u) greatest_z

A (user, block) whose range misses all wanted intervals is never expanded.
Rounding is monotone and the bounds are computed by the operations of the
score itself, so the bounds hold in floating point too, and the result equals
the filtered grid in every bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER, class_cols, dlit, long_form
from latentrec.operators import em
from latentrec.operators.scoring import BLOCK, CELLS_PER_PARTITION, join_blocks, model_row_bytes, walk_blocks
from latentrec.plans.layout import DEFAULT_BROADCAST_LIMIT

PRUNE_BLOCK = 256
LEVELS = 4  # of p(s|z) in the leading class, for a factor of e

TOP = "_hi"
BOTTOM = "_lo"

Intervals = list[tuple[float, float | None]]


@dataclass
class Blocks:
    """Items packed by block, with the bounds of each block and class."""

    packed: DataFrame  # _block, _n, _hi0.., _lo0.., _items
    count: int


def item_blocks(model, block_rows: int = PRUNE_BLOCK) -> Blocks:
    """Blocks of about ``block_rows`` items with the same leading class and level.

    The sizes of (class, level) groups come from one count; there are as many
    as classes times levels of a double at most, so their table is broadcast.
    """
    k = model.k
    shares = class_cols(em.PI, k)
    items = model.item_factors().withColumn("_most", F.greatest(*shares) if k > 1 else F.col(shares[0]))
    lead = F.array_position(F.array(*shares), F.col("_most")).cast("int")
    level = F.when(F.col("_most") > 0, F.floor(F.ln("_most") * LEVELS)).cast("int")
    items = items.select(ITEM, *shares, F.coalesce(lead, F.lit(0)).alias("_lead"), F.coalesce(level, F.lit(-(10**6))).alias("_level"))
    rows, first = [], 0
    for r in sorted(items.groupBy("_lead", "_level").count().collect()):
        n = math.ceil(r["count"] / block_rows)
        rows.append((r["_lead"], r["_level"], first, n))
        first += n
    numbers = model.state.sparkSession.createDataFrame(rows, "_lead int, _level int, _first int, _parts int")
    block = (F.col("_first") + F.pmod(F.xxhash64(ITEM), F.col("_parts"))).cast("int").alias(BLOCK)
    packed = (
        items.join(F.broadcast(numbers), ["_lead", "_level"])
        .select(block, ITEM, *shares)
        .groupBy(BLOCK)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.max(c).alias(f"{TOP}{z}") for z, c in enumerate(shares)],
            *[F.min(c).alias(f"{BOTTOM}{z}") for z, c in enumerate(shares)],
            F.collect_list(F.struct(ITEM, *shares)).alias("_items"),
        )
    )
    return Blocks(packed, first)


def _bound(k: int, side: str) -> str:
    """p(s|u) with the bounds of a block in place of p(s|z); the same operations as ``em.psu_sql``."""
    return em.psu_sql(k).replace(em.PI, side)


def _reach(k: int, intervals: Intervals, per_class: bool) -> str:
    """Whether scores of a (user, block) can lie in one of the closed intervals."""

    def meets(top: str, bottom: str) -> str:
        upper = lambda hi: "" if hi is None else f" AND {bottom} <= {dlit(hi)}"
        return " OR ".join(f"({top} >= {dlit(lo)}{upper(hi)})" for lo, hi in intervals)

    if not per_class:
        return meets(f"({_bound(k, TOP)})", f"({_bound(k, BOTTOM)})")
    return " OR ".join(meets(f"{em.PU}{z} * {TOP}{z}", f"{em.PU}{z} * {BOTTOM}{z}") for z in range(k))


def _in(intervals: Intervals, score: str = "score") -> str:
    upper = lambda hi: "" if hi is None else f" AND {score} <= {dlit(hi)}"
    return " OR ".join(f"({score} >= {dlit(lo)}{upper(hi)})" for lo, hi in intervals)


def _parts(model) -> int:
    cells = model.layout.n_users * model.layout.n_items
    return max(model.state.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / CELLS_PER_PARTITION))


def _expanded(model, intervals: Intervals, per_class: bool, broadcast_limit: int, block_rows: int) -> DataFrame:
    """(user, item) rows with both sides' factors, of the (user, block) that can hold wanted scores."""
    k, users = model.k, model.user_factors()
    n_users, n_items = model.layout.n_users, model.layout.n_items
    blocks = item_blocks(model, block_rows)
    row_bytes, parts, reach = model_row_bytes(model), _parts(model), _reach(model.k, intervals, per_class)
    walked = walk_blocks(users, n_users, blocks.count, parts)
    if n_items * row_bytes + 2 * blocks.count * row_bytes <= broadcast_limit:
        alive = walked.join(F.broadcast(blocks.packed), BLOCK).where(reach)
    elif 2 * blocks.count * row_bytes <= broadcast_limit:
        # the bounds alone are small: only (user, block) rows that pass them are exchanged
        bounds = blocks.packed.drop("_items", "_n")
        passed = walked.join(F.broadcast(bounds), BLOCK).where(reach).select(*users.columns, BLOCK)
        alive = join_blocks(passed, blocks.packed.select(BLOCK, "_items"), blocks.count, parts)
    else:
        alive = join_blocks(walked, blocks.packed, blocks.count, parts).where(reach)
    return alive.select(USER, *class_cols(em.PU, k), F.inline("_items"))


def cells_between(
    model, intervals: Intervals, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, block_rows: int = PRUNE_BLOCK
) -> DataFrame:
    """``(user_id, item_id, score)`` of all cells whose score lies in a closed interval.

    ``(lo, None)`` is an interval without upper end. Equals ``score_pairs`` filtered by the same condition.
    """
    cells = _expanded(model, intervals, False, broadcast_limit, block_rows)
    return cells.selectExpr(USER, ITEM, f"{em.psu_sql(model.k)} AS score").where(_in(intervals))


def components_between(
    model, intervals: Intervals, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, block_rows: int = PRUNE_BLOCK
) -> DataFrame:
    """``(user_id, item_id, z, score)`` of all per-class scores in a closed interval, as ``score_components`` filtered."""
    cells = _expanded(model, intervals, True, broadcast_limit, block_rows)
    products = [f"{p} AS _c{z}" for z, p in enumerate(em.product_sql(model.k))]
    return long_form(cells.selectExpr(USER, ITEM, *products), [USER, ITEM], class_cols("_c", model.k), "score").where(_in(intervals))


def pruning_report(
    model,
    intervals: Intervals,
    per_class: bool = False,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    block_rows: int = PRUNE_BLOCK,
) -> DataFrame:
    """One row: ``n_blocks, n_expanded, skipped_share, n_cells, n_cells_expanded``.

    Counts (user, block) combinations and the cells in them, all and expanded;
    only bounds are read, no cell is.
    """
    blocks = item_blocks(model, block_rows)
    bounds = blocks.packed.drop("_items")
    walked = walk_blocks(model.user_factors(), model.layout.n_users, blocks.count, _parts(model))
    if 2 * blocks.count * model_row_bytes(model) <= broadcast_limit:
        joined = walked.join(F.broadcast(bounds), BLOCK)
    else:
        joined = join_blocks(walked, bounds, blocks.count, _parts(model))
    rows = joined.selectExpr("_n", f"({_reach(model.k, intervals, per_class)}) AS _alive")
    counted = rows.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count(F.when(F.col("_alive"), 1)).alias("n_expanded"),
        F.sum("_n").alias("n_cells"),
        F.coalesce(F.sum(F.when(F.col("_alive"), F.col("_n"))), F.lit(0)).alias("n_cells_expanded"),
    )
    return counted.select(
        "n_blocks", "n_expanded", (1 - F.col("n_expanded") / F.col("n_blocks")).alias("skipped_share"), "n_cells", "n_cells_expanded"
    )
