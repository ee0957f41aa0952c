"""Column expressions shared by the EM, scoring and layout plans.

Everything here builds ``pyspark.sql.Column`` objects from built-in functions,
so the work stays inside whole-stage code generation; nothing runs in Python
per row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

USER = "user_id"
ITEM = "item_id"

# 13 hexadecimal digits hold 52 bits, which a double represents exactly.
_TWO_POW_52 = float(2**52)


def class_cols(prefix: str, k: int) -> list[str]:
    """Names of the K wide class columns, e.g. ``q_0 .. q_{K-1}``."""
    return [f"{prefix}{z}" for z in range(k)]


def row_sum(cols: list[str]) -> Column:
    """Sum of K columns of one row (a plain ``+`` chain, codegen friendly)."""
    return reduce(add, [F.col(c) for c in cols])


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null instead of failing on a zero denominator."""
    return F.try_divide(num, den)


def unit_uniform(seed: int, *cols: Column) -> Column:
    """Deterministic number in [0, 1) from a hash of ``seed`` and ``cols``.

    Unlike ``F.rand`` the value depends only on the row's content, never on
    partitioning or task retries, so a re-run after a lost executor (or on a
    different cluster size) draws the same start. The hash is md5, which other
    engines have, too.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    digits = F.substring(F.md5(text.cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_TWO_POW_52)


def long_form(df, key_cols: list[str], value_cols: list[str], value_name: str):
    """Turn K wide value columns into rows ``(*keys, z BIGINT, value)``."""
    exploded = df.select(
        *key_cols, F.posexplode(F.array(*[F.col(c) for c in value_cols])).alias("z", value_name)
    )
    return exploded.withColumn("z", F.col("z").cast("bigint"))


def sql_sum(cols: list[str]) -> str:
    """SQL text for the sum of K columns of one row."""
    return "(" + " + ".join(cols) + ")"


def dlit(x: float) -> str:
    """SQL text for an exact double literal (shortest round-trip repr)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"
