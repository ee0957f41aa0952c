"""Sinks for predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write predictions, one file per partition.

    The default mode refuses an existing folder, like a text save would; pass
    ``mode="overwrite"`` to replace it. CSV gets a header so it reads back by
    name.
    """
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.format(fmt).save(path)
