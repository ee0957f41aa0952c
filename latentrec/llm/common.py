"""Helpers shared by the training-data operators.

Tables are exchanged between jobs as Parquet under the session's shared folder
(``spark.checkpoint.dir``): a lost executor then only costs re-reading files.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentrec.session import checkpoint_dir

ENDS = re.compile(r"^\W+|\W+$")
MARKS = ".,;:!?\"'()"
BETWEEN_BLANKS = re.compile(r"\S+")
U64 = np.uint64


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per Spark context.

    Functions that run in Python workers are pickled by reference, so workers
    must be able to import the package wherever the driver found it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_latentrec_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="latentrec-src-"), "latentrec_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("latentrec", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._latentrec_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (so from any store Spark can read)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/latentrec-llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The following jobs start from plain files: what produced them is not run
    again, and values that depend on task placement are fixed for good.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, when nothing reads them any more."""
    for df in tables:
        drop(df.sparkSession, df._stored_at)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block, shuffle files go when their job ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete what ``stored`` writes inside the block when it ends.

    Results that still read those tables must have been written by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder, in whatever store that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_prefix(df: DataFrame) -> str:
    """What no column name of ``df`` starts with (in any letter case)."""
    prefix = "_x"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "x"
    return prefix + "_"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or backticks."""
    return F.col(quoted(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- word hashes and shingles (numpy, inside tasks) -----------------------------


class WordHasher(dict):
    """64-bit hashes of words, remembered while the task meets them again.

    A word is what stands between blanks, in lower case and without the
    punctuation at its ends; what is only punctuation is no word (hash 0). The
    memory is bounded: it is emptied at ``limit`` words and refilled.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word = raw.lower().strip(MARKS)
        if not word.isalnum():
            word = ENDS.sub("", word)
        h = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(raw) <= 64:
            self[raw] = h
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        raw = (text or "").split()
        h = np.fromiter(map(self.__getitem__, raw), U64, len(raw))
        return h[h != 0]

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``hashes`` and the character span of each word, blanks and end punctuation left out."""
        found = [(self[m[0]], m.start(), m.end()) for m in BETWEEN_BLANKS.finditer(text)]
        found = [f for f in found if f[0]]
        return np.array([f[0] for f in found], U64), np.array([f[1:] for f in found], np.int64).reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public-domain splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling 64-bit hash of every run of ``k`` words, by position.

    A text of 1 to ``k - 1`` words has one shingle, of all its words; an empty
    text has none.
    """
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(k, n)
    out = np.zeros(n - width + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * U64(0x9E3779B97F4A7C15) + word_hashes[j : n - width + 1 + j]
        return mix(out + U64(width))


# ---- connected components -------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root: the component's smallest id.

    Each round every node takes the smallest label among itself, its
    neighbours and their labels' labels (pointer jumping), until nothing
    changes; rounds grow with the logarithm of the longest path. Every round
    is a written table, so lineage stays short. Hub nodes do not gather their
    neighbours: labels are reduced with map-side partial minima.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = stored(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("root")), "cc")
    kind = labels.schema["root"].dataType
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "root")
        jump = labels.alias("x").join(
            labels.select(F.col("node").alias("mid"), F.col("root").alias("up")), F.col("x.root") == F.col("mid")
        )
        own = jump.select(F.col("x.node").alias("node"), F.col("up").alias("root"))
        # the old label rides along, so the same pass tells whether anything moved
        marked = (
            near.select("node", "root", F.lit(None).cast(kind).alias("was"))
            .union(own.select("node", "root", F.lit(None).cast(kind)))
            .union(labels.select("node", "root", F.col("root")))
        )
        after = stored(marked.groupBy("node").agg(F.min("root").alias("root"), F.max("was").alias("was")), "cc")
        moved = after.where(F.col("root") != F.col("was")).limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
