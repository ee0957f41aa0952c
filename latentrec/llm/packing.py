"""Best-fit packing of documents into sequences of a fixed length, with conflicts.

A document longer than the capacity is cut into full pieces (a bin each) and a
rest. The remaining pieces are packed by best fit, longest first: bins are
ordered by what is left in them, and the successor search starts at the
tightest bin that holds the piece and goes on to the next until it finds one
that is compatible. A bin carries bitmaps of its sources and of its duplicate
clusters, and is incompatible with a piece

* whose duplicate cluster is in it already, or
* whose source is in it ``per_source`` times already (one bitmap per count).

Pieces are dealt to shards by a hash, so a shard has a bounded expected size
whatever the sizes of sources and clusters; each shard is packed on its own.
With ``ordered`` the rows' order counts: a shard is a run of neighbouring rows,
and bins are numbered by the mean place of what they hold, so that the sequences
in the order of ``bin_id`` follow the order of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentrec.llm.common import col, shuffle_partitions, stored

CAPACITY = 2_048
PER_SOURCE = 4
SHARD_PIECES = 4_096


def word_count(text: Column) -> Column:
    """Runs of characters between blanks; 0 for a null, empty or blank text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def copy_cluster(text: Column) -> Column:
    """Key shared by copies that differ in letter case and blanks at most."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


class Bins:
    """Open bins by what is left in them, with bitmaps of what they hold."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # bit r: there is a bin with r left
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # bitmap c: sources that occur more than c times
        self.used: list[int] = []

    def put(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece; returns its bin and offset. The arguments are bits (0: no conflict)."""
        rests = self.filled >> n
        rest = n
        while rests:
            step = (rests & -rests).bit_length() - 1
            rest += step
            at_rest = self.by_rest[rest]
            for place, b in enumerate(at_rest):
                if not (self.clusters[b] & cluster or self.sources[b][-1] & source):
                    at_rest[place] = at_rest[-1]
                    at_rest.pop()
                    if not at_rest:
                        self.filled &= ~(1 << rest)
                    return self._add(b, n, rest, source, cluster)
            rests >>= step + 1
            rest += 1
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.used.append(0)
        return self._add(len(self.used) - 1, n, self.capacity, source, cluster)

    def _add(self, b: int, n: int, rest: int, source: int, cluster: int) -> tuple[int, int]:
        offset = self.used[b]
        self.used[b] += n
        self.clusters[b] |= cluster
        carry = source
        for c, have in enumerate(self.sources[b]):
            self.sources[b][c], carry = have | carry, have & carry
        self.by_rest[rest - n].append(b)
        self.filled |= 1 << (rest - n)
        return b, offset


def pack_shard(
    pieces: Iterable[tuple[int, object, object]], capacity: int, per_source: int
) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each ``(length, source, cluster)``, in the given order."""
    pieces = list(pieces)
    bins = Bins(capacity, per_source)
    members = Counter(c for n, _, c in pieces if n and c is not None)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, k in members.items() if k > 1)}
    source_bit: dict = {}
    out = []
    for n, source, cluster in pieces:
        if n == 0:  # nothing to separate
            out.append(bins.put(0, 0, 0))
            continue
        bit = source_bit.setdefault(source, 1 << len(source_bit))
        out.append(bins.put(n, bit, cluster_bit.get(cluster, 0)))
    return out


def numbered(docs: DataFrame, columns: list[Column], place: str) -> DataFrame:
    """``columns`` of ``docs`` and ``place``: each row's place in the written order, from 0.

    Tables are written in order part by part, so the order is that of the file
    names and of the rows in a file; one count a file is summed up over files.
    A table that is not plainly read from files is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return numbered(stored(docs, "ordered"), columns, place)
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(*columns, meta["file_name"].alias("file"), meta["row_index"].alias("row"))
    sizes = rows.groupBy(F.col("file").alias("of")).agg((F.max("row") + 1).alias("rows"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("of", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("off"))
    joined = rows.join(F.broadcast(sizes), F.col("file") == F.col("of"))
    return joined.withColumn(place, F.col("off") + F.col("row")).drop("file", "row", "of", "off")


def in_order(bins: list[int], places: np.ndarray) -> np.ndarray:
    """New numbers of ``bins``: by the mean of their pieces' places."""
    b = np.asarray(bins)
    mean = np.bincount(b, places) / np.bincount(b)
    rank = np.empty(len(mean), np.int64)
    rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
    return rank[b]


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_pieces: int = SHARD_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    length: Column | None = None,
    ordered: bool = False,
) -> DataFrame:
    """``(doc_id, source, piece, start, n_words, bin_id, bin_offset)``, a row per piece.

    Lengths are words between blanks unless ``length`` gives another measure;
    duplicate clusters are copies up to letter case and blanks unless
    ``cluster`` gives others (null: in no cluster). Empty and null texts are
    pieces of length 0 that conflict with nothing. A null source is a source;
    null ids and repeated rows are packed like any other row. ``ordered``: runs
    of ``shard_pieces`` neighbouring rows of ``docs``, as they are written, are
    packed together, and bins are numbered in the rows' order.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be at least 1")
    text = col(text_col)
    n = F.coalesce(length if length is not None else word_count(text), F.lit(0)).cast("bigint")
    columns = [
        col(id_col).alias("doc_id"),
        col(source_col).cast("string").alias("source"),
        (cluster if cluster is not None else copy_cluster(text)).alias("c"),
        n.alias("n"),
    ]
    items = numbered(docs, columns, "place") if ordered else docs.select(*columns, F.lit(0).cast("bigint").alias("place"))
    # full pieces, then the rest; a text that fills its pieces exactly has no rest
    last = F.greatest(F.lit(0), F.expr(f"(n + {capacity - 1}) div {capacity}") - 1).cast("bigint")
    pieces = items.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.select(
        "doc_id",
        "source",
        F.when(F.col("n") > 0, F.col("c")).alias("c"),
        "place",
        "piece",
        (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("n_words"),
    )
    total = docs.count()  # sizes the shards; pieces beyond one per row fill whole bins
    shards = max(1, -(-total // shard_pieces))
    hashed = F.pmod(F.xxhash64("doc_id", "source", "piece", "n_words"), F.lit(shards))
    shard = (F.expr(f"place div {shard_pieces}") if ordered else hashed).alias("shard")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        order = ["n_words", "place", "doc_id", "piece", "c"]
        rows = rows.sort_values(order, ascending=[False, True, True, True, True], kind="stable")
        sources = [None if pd.isna(s) else s for s in rows["source"]]
        clusters = [None if missing else c for c, missing in zip(rows["c"], rows["c"].isna())]
        placed = pack_shard(zip(rows["n_words"].tolist(), sources, clusters), capacity, per_source)
        bins = [b for b, _ in placed]
        rows["bin_id"] = int(key[0]) * 2**32 + (in_order(bins, rows["place"].to_numpy()) if ordered else np.array(bins))
        rows["bin_offset"] = [o for _, o in placed]
        return rows[["doc_id", "source", "piece", "start", "n_words", "bin_id", "bin_offset"]]

    # ids and clusters travel as text, for pandas would turn nullable longs into floats
    dealt = pieces.select("*", shard).withColumns({x: F.col(x).cast("string") for x in ("c", "doc_id")})
    parts = min(shards, shuffle_partitions(docs.sparkSession))
    out = dealt.repartition(parts, "shard").groupBy("shard").applyInPandas(
        run, "doc_id string, source string, piece long, start long, n_words long, bin_id long, bin_offset long"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
