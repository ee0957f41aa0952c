"""Dense 1-based index over the sorted distinct values of a column.

Spark has no distributed ``zipWithIndex`` for DataFrames and a global
``dense_rank()`` window pulls every row into one task. Instead: range
partition the rows, sort inside each partition, tag rows with their partition
id and position, and add the size of all earlier partitions. Only the
per-partition counts (one row per partition) are combined in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentrec.session import checkpoint_dir


def dense_index(
    rows: DataFrame, col: str, name: str = "idx", partitions: int | None = None, distinct: bool = True
) -> DataFrame:
    """Return ``rows`` plus ``name BIGINT`` = dense rank of ``col`` (1..n).

    With ``distinct=True`` only ``col`` is kept and duplicates are dropped;
    with ``distinct=False`` every column is kept and ``col`` must already be
    unique (e.g. one parameter row per item). The tags come from
    nondeterministic expressions, so both the tagged rows and the result are
    cut with reliable checkpoints: a recomputation after a lost executor can
    never hand out different numbers, and later actions read the index
    instead of rebuilding it.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    n_part = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = rows.where(F.col(col).isNotNull())
    if distinct:
        base = base.select(col).distinct()
    cols = base.columns
    ranged = base.repartitionByRange(n_part, col).sortWithinPartitions(col)
    tagged = ranged.select(
        *cols,
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().alias("_mid"),
    ).checkpoint(eager=True)
    # One row per partition; the running sum over them is bounded by n_part.
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # monotonically_increasing_id puts the partition id in the upper 31 bits.
    position = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    indexed = tagged.join(F.broadcast(offsets), "_pid").select(
        *cols, (F.col("_off") + position + F.lit(1)).cast("bigint").alias(name)
    )
    return indexed.checkpoint(eager=True)
