"""Small tables and brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Columns that clash with names the operators use inside.
EXTRA = ("score", "key", "root", "n", "t", "i", "rank", "mix_slot", "_idx", "bin_id", "class_id", "a.b", "_x_s", "_n", "_s", "_x", "_p", "__index_level_0__")


def docs_frame(spark, rows, extra: bool = False):
    """``rows`` of (doc_id, text, source); with clashing extra columns if asked for."""
    data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(data, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in EXTRA:
            df = df.withColumn(c, F.lit("x"))
    return df


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def edited(text: str, every: int) -> str:
    """``text`` with every ``every``-th word replaced."""
    w = text.split()
    for i in range(every // 2, len(w), every):
        w[i] = f"edit{i}"
    return " ".join(w)


def odd_rows():
    """Null and empty texts, null ids and sources, repeated rows, blanks, and a very long text."""
    long = words(6_000, 99)
    return [
        (1, "alpha beta gamma delta epsilon zeta", "s1"),
        (1, "alpha beta gamma delta epsilon zeta", "s1"),
        (2, None, "s1"),
        (3, "", None),
        (None, "one two three four five six seven", "s2"),
        (None, None, None),
        (4, "   \n\t ", "s2"),
        (5, long, "s2"),
        (6, "... !!! ---", "s1"),
        (7, "naïve café ßtraße İstanbul 中文 \U0001f600", "s3"),
    ]
