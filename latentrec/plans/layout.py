"""Physical layout of the pair table, decided once per fit.

The pair table never changes during EM; only the two small parameter tables
(p(z|u) per user, p(s|z) per item) do. So the expensive decisions are made
once, from exact counts, and no layout moves pairs in an iteration:

* a parameter side is **broadcast** only when ``rows x (K+4) x 8`` bytes is
  under ``broadcast_limit``; the counts come from the data, not guesses;
* when only the user side is too big, the pairs are written once as a table
  **bucketed by user** (parquet, under ``spark.checkpoint.dir``), so every
  iteration's join with p(z|u) shuffles only the parameter table into the
  same hash buckets;
* when the item side is too big, the pairs are written once in
  **two-dimensional blocks**, (user block, item block), one bucket each. Stored
  routes say which blocks a user and an item have pairs in; every iteration
  copies parameter rows along them. Block numbers are chosen so that each has a
  bucket of its own, and both parameter sides are dealt by them: the joins on
  (block, user) and (block, item) find all sides in place. Spark deals such
  joins anew by all their keys unless told otherwise, so
  ``CO_PARTITION`` is off in the session until the layout is closed;
* keys holding more than one partition's worth of pairs are **salted**: their
  pairs are spread over ``ceil(deg / target)`` sub-keys (or that many blocks
  of their own side). At most ``partitions`` keys can be hot, so the hot-key
  table has a proven size bound and is broadcast.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from latentrec.functions.columns import ITEM, USER
from latentrec.operators.em import ITEM_ROW, USER_ROW
from latentrec.operators.indexing import dense_index
from latentrec.session import checkpoint_dir

# Defaults sized for executors with a few GB each: a broadcast side of at most
# 64 MiB, pair partitions of ~2M rows (two ids plus K doubles in flight).
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
DEFAULT_ROWS_PER_PARTITION = 2_000_000

USER_SALT = "_su"
ITEM_SALT = "_si"
PAIR_BLOCK = "_b"
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
USER_RANK = "_ur"
ITEM_RANK = "_ir"


# A hash join's build side cannot spill: beyond this many bytes in a partition
# the join is left to the planner (a sort-merge join).
HASH_BUILD_LIMIT = 128 * 1024 * 1024
SALT_ROW_BYTES = 64
STRING_KEY_BYTES = 56


def factor_row_bytes(k: int, integral_ids: bool = True) -> int:
    """Rough in-memory size of one K-wide parameter row (key, K doubles, header)."""
    return 8 * (k + 4) + (0 if integral_ids else STRING_KEY_BYTES)


def cut_lineage(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder, read it back.

    One job computes and writes each partition once; the result is a plain
    file scan, so the next plan starts from it and a lost executor only costs
    re-reading files. A parquet table is used rather than ``Dataset.checkpoint``
    because a checkpoint keeps the size estimate of the plan it replaces: in a
    loop that joins its own output, those estimates multiply every iteration
    until planning itself stalls. A file scan is sized by its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/latentrec-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # the schema is known: reading it back needs no footer inference
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame | None) -> None:
    """Delete the folder behind a table written by ``cut_lineage``.

    Used for iteration states that a newer state has replaced, so a long fit
    leaves one state behind, not one per iteration.
    """
    if df is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "latentrec-" in folder.getName():
            folder.getFileSystem(conf).delete(folder, True)
            return


@dataclass
class PairLayout:
    pairs: DataFrame
    n_pairs: int
    n_users: int
    n_items: int
    partitions: int
    broadcast_users: bool
    broadcast_items: bool
    user_salts: DataFrame | None = None
    item_salts: DataFrame | None = None
    user_keys: list[str] = field(default_factory=lambda: [USER])
    user_rank: str = USER
    item_rank: str = ITEM
    row_bytes: int = 0
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT
    grid: tuple[int, int] | None = None  # user blocks, item blocks
    user_routes: DataFrame | None = None
    item_routes: DataFrame | None = None
    co_partition: str | None = None  # the session's own setting, where it was changed

    def _side(self, factors: DataFrame, salts: DataFrame | None, key: str, salt: str, rows: int) -> DataFrame:
        """A parameter side that is shuffled: hot rows replicated, hashed only if it surely fits."""
        small = self.partitions * SALT_ROW_BYTES <= max(self.broadcast_limit, DEFAULT_BROADCAST_LIMIT)
        side = _replicate_hot(factors, salts, key, salt, small)
        fits = rows * self.row_bytes / max(1, self.partitions) <= HASH_BUILD_LIMIT
        return side.hint("shuffle_hash") if fits else side

    def attach(self, users: DataFrame, items: DataFrame) -> DataFrame:
        """Join the pairs with one parameter row per user and per item."""
        if self.grid is not None:
            return self._attach_blocks(users, items)
        joined = self.pairs
        if self.broadcast_users:
            joined = joined.join(F.broadcast(users), USER)
        else:
            joined = joined.join(self._side(users, self.user_salts, USER, USER_SALT, self.n_users), self.user_keys)
        return joined.join(F.broadcast(items), ITEM)

    def _attach_blocks(self, users: DataFrame, items: DataFrame) -> DataFrame:
        """The joins of two-dimensional blocks: parameter rows are copied to blocks, pairs stay."""
        n_user_blocks, n_item_blocks = self.grid
        if self.broadcast_users:
            joined = self.pairs.join(F.broadcast(users), USER)
        else:
            routed = self._routed(users, self.user_routes, USER, self.n_users / n_user_blocks)
            joined = self.pairs.join(routed, [PAIR_BLOCK, USER])
        routed = self._routed(items, self.item_routes, ITEM, self.n_items / n_item_blocks)
        return joined.join(routed, [PAIR_BLOCK, ITEM])

    def _routed(self, factors: DataFrame, routes: DataFrame, key: str, rows: float) -> DataFrame:
        """A copy of each parameter row for every block with pairs of its key, dealt as the pairs are."""
        copies = routes.join(factors, key).repartition(self.partitions, PAIR_BLOCK)
        # twice: sizes of blocks vary
        return copies.hint("shuffle_hash") if 2 * rows * self.row_bytes <= HASH_BUILD_LIMIT else copies

    def close(self) -> None:
        """Delete the stored pairs, routes and salt tables; the layout cannot be used after that."""
        stored = [df for df in (self.pairs, self.user_routes, self.item_routes) if df is not None]
        spark = self.pairs.sparkSession
        tags = [f.split("/")[-2].removeprefix("latentrec-").replace("-", "_") for df in stored for f in df.inputFiles()[:1]]
        mine = [t.name for t in spark.catalog.listTables() if t.name.removeprefix("latentrec_") in tags]
        for df in (*stored, self.user_salts, self.item_salts):
            drop_written(df)
        for n in mine:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
        if self.co_partition is not None:
            spark.conf.set(CO_PARTITION, self.co_partition)

    def describe(self) -> dict:
        return {
            "n_pairs": self.n_pairs,
            "n_users": self.n_users,
            "n_items": self.n_items,
            "partitions": self.partitions,
            "broadcast_users": self.broadcast_users,
            "broadcast_items": self.broadcast_items,
            "salted_users": self.user_salts is not None,
            "salted_items": self.item_salts is not None,
            "grid": self.grid,
        }


def _replicate_hot(factors: DataFrame, salts: DataFrame | None, key: str, salt: str, small: bool) -> DataFrame:
    """Give every parameter row one copy per sub-key of its (hot) key; ``small``: the hot keys may be broadcast."""
    if salts is None:
        return factors
    last = F.coalesce(F.col("_n"), F.lit(1)).cast("bigint") - 1
    return factors.join(F.broadcast(salts) if small else salts, key, "left").select(
        *factors.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(salt)
    )


def store_pairs(
    laid: DataFrame, parts: int, bucket_keys: list[str] | None, salt: str | None = None, kind: str = "pairs"
) -> DataFrame:
    """Write the laid-out pairs once under the checkpoint folder and read them back.

    With ``bucket_keys`` the table is bucketed into ``parts`` buckets, which
    the planner treats as hash partitioning on those keys: joins and
    aggregations on them need no exchange on this side. Each task writes one
    bucket (the repartition uses the same hash), so there are ``parts`` files.
    Without keys it is plain parquet in ``parts`` files, clustered by user (and
    by ``salt``, which parts the pairs of hot users alone), so that the partial
    sums of an iteration meet few users per task.
    """
    spark = laid.sparkSession
    tag = uuid.uuid4().hex
    path = f"{checkpoint_dir(spark).rstrip('/')}/latentrec-{kind}-{tag}"
    if bucket_keys:
        name = f"latentrec_{kind}_{tag}"
        (
            laid.repartition(parts, *bucket_keys)
            .write.bucketBy(parts, *bucket_keys)
            .option("path", path)
            .format("parquet")
            .saveAsTable(name)
        )
        return spark.table(name)
    laid.repartition(parts, USER, *([salt] if salt else [])).drop(*([salt] if salt else [])).write.parquet(path)
    return spark.read.parquet(path)


def block_grid(parts: int, n_users: int, n_items: int, broadcast_users: bool) -> tuple[int, int]:
    """Numbers of user blocks and item blocks, about ``parts`` blocks in all.

    A user row goes to as many blocks as there are item blocks at most, and the
    other way round, so the numbers are as the square root of users to items.
    """
    if broadcast_users:
        return 1, parts
    rows = round(math.sqrt(parts * n_users / max(1, n_items)))
    rows = max(1, min(parts, rows))
    return rows, max(1, math.ceil(parts / rows))


def block_numbers(spark, parts: int) -> DataFrame:
    """``(_at, _b)``: for every bucket ``_at`` of ``parts`` the least number that Spark's hash puts there.

    Pairs bucketed by these numbers fill every bucket with exactly one block.
    """
    some = math.ceil(parts * (math.log(parts) + 20))
    number = F.col("id").cast("int")
    at = F.pmod(F.hash(number), F.lit(parts)).alias("_at")
    found = spark.range(some).select(number.alias(PAIR_BLOCK), at).groupBy("_at").agg(F.min(PAIR_BLOCK).alias(PAIR_BLOCK))
    return cut_lineage(found, "blocks")


def _salt_of(other: str, copies: str, name: str):
    """Sub-key of a pair of a hot key (more than one copy): by a hash of its other id.

    Not the hash that deals the other id to blocks, so that the two are independent.
    """
    sub = F.pmod(F.xxhash64(F.lit(1), F.col(other)), F.col(copies))
    return F.when(F.col(copies) > 1, sub).otherwise(0).cast("bigint").alias(name)


def _hot_keys(degrees: DataFrame, gid: int, key: str, target: int) -> DataFrame:
    """Keys with more than ``target`` pairs and their number of sub-keys (< P rows)."""
    hot = degrees.where((F.col("gid") == gid) & (F.col("deg") > target)).select(
        key, F.ceil(F.col("deg") / F.lit(target)).cast("int").alias("_n")
    )
    return cut_lineage(hot, "hotkeys")


def plan_layout(
    pairs: DataFrame,
    k: int,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    rows_per_partition: int = DEFAULT_ROWS_PER_PARTITION,
    rank_ids: bool = False,
) -> PairLayout:
    """Count, decide broadcast / partitioning / salting, and checkpoint the pairs.

    ``pairs`` must already be distinct ``(user_id, item_id)`` rows.
    ``rank_ids`` adds the dense ranks of both ids (needed only by the weighted
    start on string ids).
    """
    spark = pairs.sparkSession
    # the source is read once: all that follows starts from the stored pairs
    source = pairs = cut_lineage(pairs.select(USER, ITEM), "source")
    degrees = pairs.groupingSets([[USER], [ITEM]], USER, ITEM).agg(
        F.count(F.lit(1)).alias("deg"), F.grouping_id().alias("gid")
    )
    is_u, is_i = F.col("gid") == USER_ROW, F.col("gid") == ITEM_ROW
    s = degrees.agg(
        F.sum(F.when(is_u, F.col("deg"))).alias("n_pairs"),
        F.count(F.when(is_u, 1)).alias("n_users"),
        F.count(F.when(is_i, 1)).alias("n_items"),
        F.max(F.when(is_u, F.col("deg"))).alias("max_u"),
        F.max(F.when(is_i, F.col("deg"))).alias("max_i"),
    ).first()
    n_pairs = int(s["n_pairs"] or 0)
    n_users, n_items = int(s["n_users"]), int(s["n_items"])
    row_bytes = factor_row_bytes(k, ids_are_integral(pairs))
    bcast_u = n_users * row_bytes <= broadcast_limit
    bcast_i = n_items * row_bytes <= broadcast_limit
    # Bucketed pairs are only reused by a join whose other side is shuffled
    # into as many partitions, so they need at least the shuffle partition
    # count; otherwise the pairs are sized by data (floor: one task per core).
    if bcast_u:
        floor = spark.sparkContext.defaultParallelism
    else:
        floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(floor, math.ceil(n_pairs / rows_per_partition))
    max_buckets = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    if not (bcast_u and bcast_i):  # buckets may hold more than one partition's worth, but not be more than the session allows
        parts = min(parts, max_buckets)
    target = max(1, math.ceil(n_pairs / parts))
    # fewer keys than partitions can be hot
    small = parts * SALT_ROW_BYTES <= max(broadcast_limit, DEFAULT_BROADCAST_LIMIT)

    laid = pairs
    user_keys = [USER]
    user_salts = item_salts = None
    salt = None
    if (s["max_u"] or 0) > target:
        user_salts = _hot_keys(degrees, USER_ROW, USER, target)
        laid = laid.join(F.broadcast(user_salts) if small else user_salts, USER, "left").select(USER, ITEM, _salt_of(ITEM, "_n", USER_SALT))
        user_keys, salt = [USER, USER_SALT], USER_SALT
    if not bcast_i and (s["max_i"] or 0) > target:
        item_salts = _hot_keys(degrees, ITEM_ROW, ITEM, target)
        laid = laid.join(F.broadcast(item_salts) if small else item_salts, ITEM, "left").select(
            *laid.columns, _salt_of(USER, "_n", ITEM_SALT)
        )
    grid = numbers = None
    if not bcast_i:
        grid = block_grid(parts, n_users, n_items, bcast_u)
        if grid[0] * grid[1] > max_buckets:
            grid = grid[0], max_buckets // grid[0]
        parts = grid[0] * grid[1]
        numbers = block_numbers(spark, parts)  # one row a partition
        laid = _with_blocks(laid, grid, F.broadcast(numbers) if small else numbers)

    user_rank, item_rank = USER, ITEM
    if rank_ids:
        laid = _with_ranks(laid, pairs)
        user_rank, item_rank = USER_RANK, ITEM_RANK

    # Co-locate pairs with the parameter rows that cannot be broadcast;
    # otherwise just spread the pairs evenly.
    user_routes = item_routes = None
    if grid is not None:
        laid = store_pairs(laid, parts, [PAIR_BLOCK])
        if not bcast_u:
            user_routes = store_pairs(laid.select(USER, PAIR_BLOCK).distinct(), parts, [USER], kind="routes")
        item_routes = store_pairs(laid.select(ITEM, PAIR_BLOCK).distinct(), parts, [ITEM], kind="routes")
    elif bcast_u:
        laid = store_pairs(laid, parts, None, salt)
    else:
        laid = store_pairs(laid, parts, user_keys)
    drop_written(source)
    drop_written(numbers)
    co_partition = None
    if grid is not None:
        co_partition = spark.conf.get(CO_PARTITION, "true")
        spark.conf.set(CO_PARTITION, "false")
    return PairLayout(
        pairs=laid,
        n_pairs=n_pairs,
        n_users=n_users,
        n_items=n_items,
        partitions=parts,
        broadcast_users=bcast_u,
        broadcast_items=bcast_i,
        user_salts=user_salts,
        item_salts=item_salts,
        user_keys=user_keys,
        user_rank=user_rank,
        item_rank=item_rank,
        row_bytes=row_bytes,
        broadcast_limit=broadcast_limit,
        grid=grid,
        user_routes=user_routes,
        item_routes=item_routes,
        co_partition=co_partition,
    )


def _with_blocks(laid: DataFrame, grid: tuple[int, int], numbers: DataFrame) -> DataFrame:
    """Add the block number of each pair; sub-keys of hot keys lie in neighbouring blocks of their side."""
    n_user_blocks, n_item_blocks = grid

    def side(key: str, salt: str, n: int):
        at = F.pmod(F.xxhash64(key), F.lit(n))
        return F.pmod(at + F.col(salt), F.lit(n)) if salt in laid.columns else at

    at = (side(USER, USER_SALT, n_user_blocks) * n_item_blocks + side(ITEM, ITEM_SALT, n_item_blocks)).cast("int")
    return laid.select(USER, ITEM, at.alias("_at")).join(numbers, "_at").select(USER, ITEM, PAIR_BLOCK)


def _with_ranks(laid: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach the dense ranks of user and item ids (1-based, sorted order)."""
    users = dense_index(pairs, USER, USER_RANK)
    items = dense_index(pairs, ITEM, ITEM_RANK)
    return laid.join(users, USER).join(items, ITEM)


def ids_are_integral(pairs: DataFrame) -> bool:
    fields = {f.name: f.dataType for f in pairs.schema.fields}
    return isinstance(fields[USER], IntegralType) and isinstance(fields[ITEM], IntegralType)
