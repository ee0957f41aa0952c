"""Vector rows as numpy blocks, and the grid of blocks that searches use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentrec.llm.common import col, shuffle_partitions

QUERY_BLOCK = 256  # queries in a block
QUERY_GROUP = 16  # query blocks that a task of the grid holds


def usable(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vec.isNotNull() & ok


def clean_vectors(df: DataFrame, id_col: str, vec_col: str, change: Callable[[Column], Column]) -> DataFrame:
    """``(id, v array<double>, dim)`` of rows that take part; rows equal in both count once.

    Rows without an id take no part: a result could not name them.
    """
    good = df.where(F.coalesce(usable(col(vec_col)), F.lit(False)) & col(id_col).isNotNull())
    v = F.transform(col(vec_col), lambda x: change(x.cast("double")).cast("double"))
    return good.select(col(id_col).cast("long").alias("id"), v.alias("v")).distinct().withColumn("dim", F.size("v"))


def matrix(rows: pd.Series) -> np.ndarray:
    """One row for each vector of equal length."""
    return np.array([np.asarray(r, np.float64) for r in rows], np.float64).reshape(len(rows), -1)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> DataFrame:
    """``(dim, block, n, ids, mat)``: queries packed as binary blocks of one dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                for at in range(0, len(part), size):
                    p = part.iloc[at : at + size]
                    ids = p["id"].to_numpy(np.int64)
                    yield pd.DataFrame(
                        {"dim": [dim], "n": [len(p)], "first": [int(ids[0])], "ids": [ids.tobytes()], "mat": [matrix(p["v"]).tobytes()]}
                    )

    # few partitions, so that blocks are filled; sorted, so that a retry packs the same blocks
    ordered = queries.repartitionByRange(max(1, min(64, shuffle_partitions(queries.sparkSession))), "id").sortWithinPartitions("id")
    packed = ordered.select("dim", "id", "v").mapInPandas(run, "dim int, n int, first long, ids binary, mat binary")
    return packed


def grid(left: DataFrame, right: DataFrame, left_groups: int, right_groups: int, left_key: Column, right_key: Column) -> DataFrame:
    """Rows of both sides dealt to the cells of a grid, for one stream per cell.

    Every left row goes to the ``right_groups`` cells of its group and the
    other way round, so each pair of rows meets in exactly one cell. ``kind`` 0
    marks left rows, which come first in a cell.
    """
    l_rows = left.withColumn("lg", F.pmod(left_key, F.lit(left_groups)).cast("int")).withColumn(
        "rg", F.explode(F.sequence(F.lit(0), F.lit(right_groups - 1)))
    )
    r_rows = right.withColumn("rg", F.pmod(right_key, F.lit(right_groups)).cast("int")).withColumn(
        "lg", F.explode(F.sequence(F.lit(0), F.lit(left_groups - 1)))
    )
    both = l_rows.withColumn("kind", F.lit(0)).unionByName(r_rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    n = max(1, min(shuffle_partitions(left.sparkSession) * 4, left_groups * right_groups))
    return both.repartition(n, "lg", "rg")


def best(rows: DataFrame, k: int, ascending: bool) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of each query, ties to the smaller id."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy("query_id").orderBy(score, "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
