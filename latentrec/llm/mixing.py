"""Mixing sources to target weights by Pfair scheduling.

Every source's rows are cut into blocks of ``block_rows``. A source of weight
``w = p / P`` releases its block ``j`` at slot ``floor(j / w)`` and needs it
placed by ``ceil((j + 1) / w)``; earliest deadline first over the released
blocks then keeps every source within less than one block of ``w * t`` after
any ``t`` slots. Weights are multiples of ``1 / P``, so the schedule repeats
every ``P`` slots: one period is scheduled and block ``j`` of a source follows
by arithmetic. Unless given, ``P`` is the length of the mix by the exact targets.
A weight is then off by less than ``1 / P``, so rounding moves no source by more
than a block over the whole mix, and any number of sources has a place. The
driver counts through the blocks (not the rows) of one period; the schedule
itself is a table that the rows are joined with. Blocks grow with the mix, so that
a period has at most ``MAX_SLOTS`` slots (or one for each source), whatever the
number of rows.

No row is left out. The mix ends at the first slot by which every source has
been placed whole; a source that is short of its weight by then starts its next
*epoch* (its blocks again, from the first), so its rows appear again with
``epoch`` 1, 2, ... Rows of sources that need no repeats appear once.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentrec.llm.common import col, free_prefix, quoted, shuffle_partitions, stored

BLOCK_ROWS = 32  # at least
MAX_SLOTS = 2**20  # of a period
BROADCAST_SOURCES = 2**16  # rows of the table of sources up to which it is broadcast
PARTS = 1_000  # P of ``integer_weights`` by itself: weights are multiples of 1 / P
ALPHA = 0.9  # default targets: source sizes to this power
ADDED = ("slot", "place", "epoch", "block", "release", "deadline")


def integer_weights(weights: dict, parts: int = PARTS) -> dict:
    """Weights as whole parts of ``parts``: at least 1 each, largest remainders first."""
    if not weights:
        return {}
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("target weights must be positive and finite")
    if len(weights) > parts:
        raise ValueError(f"{len(weights)} sources need at least as many parts; there are {parts}")
    total = math.fsum(weights.values())
    keys = sorted(weights, key=lambda k: (k is not None, str(k)))
    free = parts - len(keys)  # each has one part; the rest goes by what is due beyond it
    due = {k: max(0.0, weights[k] / total * parts - 1) for k in keys}
    scale = free / math.fsum(due.values()) if any(due.values()) else 0.0
    share = {k: due[k] * scale if scale else free / len(keys) for k in keys}
    out = {k: 1 + math.floor(share[k]) for k in keys}
    rest = sorted(keys, key=lambda k: (math.floor(share[k]) - share[k], str(k)))
    for k in rest[: parts - sum(out.values())]:
        out[k] += 1
    return out


def mix_length(weights: dict, blocks: dict) -> int:
    """Slots after which every source of ``blocks`` has been placed whole, by its exact weight."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return max((math.ceil(n * total / exact[s]) for s, n in blocks.items()), default=1)


def block_size(counts: dict, weights: dict, least: int) -> int:
    """Rows of a block: ``least``, doubled until sources of several blocks need ``MAX_SLOTS`` slots at most.

    Sources of one block are placed once in any period, however small their weight.
    """
    size = least
    while True:
        several = {s: n for s, n in ((s, -(-n // size)) for s, n in counts.items()) if n > 1}
        if not several or mix_length(weights, several) <= MAX_SLOTS:
            return size
        size *= 2


def window(j: int, p: int, parts: int) -> tuple[int, int]:
    """Release slot and deadline of block ``j`` of a source with ``p`` of ``parts``."""
    return j * parts // p, -((j + 1) * -parts // p)


def one_period(weights: dict) -> dict:
    """Slots of each source in one period, by earliest deadline first."""
    parts = sum(weights.values())
    keys = list(weights)
    waiting = [(window(0, weights[k], parts), i, 0) for i, k in enumerate(keys)]
    waiting = [(r, d, i, j) for (r, d), i, j in waiting]
    heapq.heapify(waiting)
    ready: list = []
    slots: dict = {k: [] for k in keys}
    for t in range(parts):
        while waiting and waiting[0][0] <= t:
            r, d, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (d, i, j))
        d, i, j = heapq.heappop(ready)
        slots[keys[i]].append(t)
        if j + 1 < weights[keys[i]]:
            heapq.heappush(waiting, (*window(j + 1, weights[keys[i]], parts), i, j + 1))
    return slots


def indexed_in_source(df: DataFrame, source_col: str, id_col: str, name: str) -> DataFrame:
    """``df`` with ``name``: 0-based place of each row among its source's rows.

    Rows are range-partitioned by (source, hash of the id), so a source that
    holds a third of all rows lies in many partitions; only one count for each
    (partition, source) is summed up over partitions. The place of a row in
    its partition is fixed by writing the partitions down first.
    """
    own = free_prefix(df)
    pid, mid, off, first, n, part, source = (own + x for x in ("pid", "mid", "off", "first", "n", "part", "source"))
    keys = [col(source_col).asc_nulls_first(), F.xxhash64(col(id_col)), col(id_col)]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    tagged = stored(
        ranged.select("*", F.spark_partition_id().alias(pid), F.monotonically_increasing_id().alias(mid)), "mix"
    )
    sizes = tagged.groupBy(pid, col(source_col).alias(source)).agg(F.count(F.lit(1)).alias(n), F.min(mid).alias(first))
    before = Window.partitionBy(source).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(pid).alias(part), source, first, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    # at most one row for each partition and one more for each source
    joined = tagged.join(F.broadcast(sizes), (F.col(pid) == F.col(part)) & col(source_col).eqNullSafe(F.col(source)))
    place = F.col(off) + F.col(mid) - F.col(first)
    return joined.select(*[tagged[c] for c in map(quoted, df.columns)], place.alias(name))


def mix(
    df: DataFrame,
    targets: dict | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    parts: int | None = None,
    alpha: float = ALPHA,
    prefix: str = "mix_",
) -> DataFrame:
    """Rows of ``df`` in mixed order: its columns and ``<prefix>`` + slot, place, epoch, block, release, deadline.

    Sort by (slot, place) for the order of the mix. ``targets`` maps each source to its
    weight (any positive scale); without it sources weigh as their row counts
    to the power ``alpha``. Blocks have ``block_rows`` rows, or more where the mix is long (``block_size``). ``parts`` fixes the period ``P`` (weights are then rounded to
    ``1 / P``); without it the period follows from the targets. A null source is a source of its own (key None).
    A source without a target is an error, not a loss. Repeated rows are rows
    like any other; an empty table gives an empty mix.
    """
    spark = df.sparkSession
    own = free_prefix(df)
    idx, s, k, w, n_blocks, due, e, j = (own + x for x in ("idx", "s", "k", "w", "blocks", "due", "e", "j"))
    k2, turn, at = (own + x for x in ("k2", "turn", "at"))
    names = [prefix + x for x in ADDED]
    clash = {c.lower() for c in df.columns} & set(names)
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)}: choose another prefix")
    rows = indexed_in_source(df, source_col, id_col, idx)
    sizes = rows.groupBy(col(source_col).alias("s")).agg((F.max(idx) + 1).alias("n")).collect()
    counts = {r["s"]: r["n"] for r in sizes}
    missing = [s for s in counts if targets is not None and s not in targets]
    if missing:
        raise ValueError(f"no target weight for {missing}")
    wanted = {s: targets[s] if targets else n**alpha for s, n in counts.items()}
    if any(not x > 0 or math.isinf(x) for x in wanted.values()):
        raise ValueError("target weights must be positive and finite")
    block_rows = block_rows if parts else block_size(counts, wanted, block_rows)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    parts = parts or min(mix_length(wanted, blocks), max(MAX_SLOTS, len(blocks)))
    weights = integer_weights(wanted, parts)
    slots = one_period(weights)
    slot_of = lambda src, b: b // weights[src] * parts + slots[src][b % weights[src]]
    end = max((slot_of(src, n - 1) + 1 for src, n in blocks.items()), default=0)
    plan = [
        (src, i, weights[src], blocks[src], end // parts * weights[src] + bisect_left(slots[src], end % parts))
        for i, src in enumerate(counts)
    ]
    s_type = df.schema[source_col].dataType
    longs = [T.StructField(x, T.LongType()) for x in (k, w, n_blocks, due)]
    # a row for each source
    side = spark.createDataFrame(plan, T.StructType([T.StructField(s, s_type), *longs]))
    side = F.broadcast(side) if len(plan) <= BROADCAST_SOURCES else side
    # a row for each slot of the period: the source, the block's turn in the period, the slot
    turns = [slots[src] for src in counts]
    period = {
        k2: np.repeat(np.arange(len(turns)), [len(x) for x in turns]),
        turn: np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in turns]]),
        at: np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in turns]]),
    }
    schedule = stored(spark.createDataFrame(pa.table({x: pa.array(v, pa.int64()) for x, v in period.items()})), "schedule")
    joined = rows.join(side, col(source_col).eqNullSafe(F.col(s)))
    b0 = F.floor(F.col(idx) / block_rows)
    epochs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(due) - 1 - b0) / F.col(n_blocks)))
    long = joined.select("*", F.explode(epochs).alias(e))
    long = long.select("*", (b0 + F.col(e) * F.col(n_blocks)).cast("bigint").alias(j))
    long = long.join(schedule, (F.col(k) == F.col(k2)) & (F.expr(f"{j} % {w}") == F.col(turn)))
    slot = F.expr(f"{j} div {w}") * parts + F.col(at)
    release = F.expr(f"{j} * {parts} div {w}")
    deadline = F.expr(f"(({j} + 1) * {parts} + {w} - 1) div {w}")
    values = (slot, F.col(idx) % block_rows, F.col(e), F.col(j), release, deadline)
    return long.select(
        *[rows[c] for c in map(quoted, df.columns)], *[v.cast("bigint").alias(x) for v, x in zip(values, names)]
    )
