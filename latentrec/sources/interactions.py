"""Interaction sources: ratings files and the test tables, reduced to pairs.

Every reader selects columns by name (the two documented layouts put the item
in different positions), so the parquet scan only reads the two id columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latentrec.functions.columns import ITEM, USER

def read_interactions(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    header: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Read raw interaction rows (text CSV, or parquet).

    CSV columns are bound by the names of the header line, or by ``columns``
    where there is none, and are strings: ids need not be numbers. Files whose
    headers differ are an error, not a mix-up of columns. A short line has
    nulls for what is missing; ``to_pairs`` drops rows without an id, and
    ``dropped_rows`` counts them.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    rows = spark.read.option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", not header).csv(path)
    return rows.toDF(*columns) if columns else rows


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a dimension table such as a movie list (looked at, never joined)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _ids(df: DataFrame, user_col: str, item_col: str, id_type: str | None) -> DataFrame:
    user, item = F.col(user_col), F.col(item_col)
    if id_type:
        user, item = user.try_cast(id_type), item.try_cast(id_type)
    return df.select(user.alias(USER), item.alias(ITEM))


def to_pairs(
    df: DataFrame, user_col: str = "user_id", item_col: str = "movie_id", id_type: str | None = None
) -> DataFrame:
    """Distinct ``(user_id, item_id)`` pairs; rows with a missing id are dropped.

    Only seen / not seen matters, so ratings and duplicates collapse. The
    distinct is a hash aggregate with a map-side partial step, so a user or
    item holding a large share of the rows costs one row per map task in the
    shuffle, not one row per event. ``id_type`` casts the ids on request; ids
    that cannot be cast count as missing.
    """
    ids = _ids(df, user_col, item_col, id_type)
    return ids.where(F.col(USER).isNotNull() & F.col(ITEM).isNotNull()).distinct()


def dropped_rows(
    df: DataFrame, user_col: str = "user_id", item_col: str = "movie_id", id_type: str | None = None
) -> DataFrame:
    """One row ``(n_rows, n_dropped)``: rows read, and those that ``to_pairs`` drops for a missing id."""
    missing = F.col(USER).isNull() | F.col(ITEM).isNull()
    return _ids(df, user_col, item_col, id_type).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(missing, 1)).alias("n_dropped")
    )


class Account:
    """What became of the rows behind some pairs, counted while the pairs are read.

    ``counts`` waits for the first action on the pairs (``plan_layout`` and
    ``fit`` read them once) and costs no scan of its own. A row is counted
    under the first cause that holds.
    """

    CAUSES = ("no_user", "no_item", "bad_user", "bad_item")

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.observation = Observation()

    @property
    def counts(self) -> dict[str, int]:
        """``n_rows``, ``n_kept`` and the rows dropped by cause."""
        return {k: int(v) for k, v in self.observation.get.items()}

    def table(self) -> DataFrame:
        """The counts as one row."""
        names = ("n_rows", "n_kept", *self.CAUSES)
        counts = self.counts
        return self.spark.createDataFrame([[counts[n] for n in names]], ", ".join(f"{n} bigint" for n in names))


def accounted_pairs(
    df: DataFrame, user_col: str = "user_id", item_col: str = "movie_id", id_type: str | None = None
) -> tuple[DataFrame, Account]:
    """``to_pairs`` and an account of the rows it keeps and drops, from the same scan.

    Causes: no user id, no item id, a user or item id that is not of ``id_type``.
    """
    account = Account(df.sparkSession)
    user, item = F.col(user_col), F.col(item_col)
    ids = df.select(
        (user.try_cast(id_type) if id_type else user).alias(USER),
        (item.try_cast(id_type) if id_type else item).alias(ITEM),
        user.isNull().alias("_no_user"),
        item.isNull().alias("_no_item"),
    )
    cause = (
        F.when(F.col("_no_user"), "no_user")
        .when(F.col("_no_item"), "no_item")
        .when(F.col(USER).isNull(), "bad_user")
        .when(F.col(ITEM).isNull(), "bad_item")
    )
    marked = ids.select(USER, ITEM, cause.alias("_cause"))
    metrics = [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_cause").isNull(), 1)).alias("n_kept")]
    metrics += [F.count(F.when(F.col("_cause") == c, 1)).alias(c) for c in Account.CAUSES]
    seen = marked.observe(account.observation, *metrics)
    return seen.where(F.col("_cause").isNull()).select(USER, ITEM).distinct(), account


def events_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: user_id x the number ``k`` carried in ``props`` (``{"k": 69}``)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.regexp_extract(F.col("props"), "[0-9]+", 0).try_cast("bigint")
    return to_pairs(ev.select("user_id", item.alias("k")), "user_id", "k")


def customer_part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x lineitem: which customer bought which part."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return to_pairs(joined, "o_custkey", "l_partkey")


def customer_brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x lineitem x part: which customer bought which brand (string ids)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(
        part, items.l_partkey == part.p_partkey
    )
    return to_pairs(joined, "o_custkey", "p_brand")


def preview(df: DataFrame, n: int = 10, order: tuple[str, ...] = (USER, ITEM)) -> DataFrame:
    """First ``n`` rows in key order (a top-n sort, not a full collect)."""
    return df.orderBy(*order).limit(n)


def shape(pairs: DataFrame) -> DataFrame:
    """One row: number of pairs, columns, distinct users and distinct items.

    The two distinct counts come from one grouping-sets aggregate, so the
    pairs are read once.
    """
    degrees = pairs.groupingSets([[USER], [ITEM]], USER, ITEM).agg(
        F.count(F.lit(1)).alias("deg"), F.grouping_id().alias("gid")
    )
    return degrees.agg(
        F.sum(F.when(F.col("gid") == 1, F.col("deg"))).cast("bigint").alias("n_rows"),
        F.lit(len(pairs.columns)).cast("bigint").alias("n_columns"),
        F.count(F.when(F.col("gid") == 1, 1)).alias("n_users"),
        F.count(F.when(F.col("gid") == 2, 1)).alias("n_items"),
    )
