"""Near-duplicate classes by improved consistent weighted sampling.

A text is the weighted set of its 5-word shingles. The weight of a shingle is
its count in the text times a damped inverse document frequency::

    idf = (1 + ln((N + 1) / (df + 1)) / ln(N + 1)) ** IDF_POWER

Document frequencies cover every text; they are kept for ``FEATURES`` hashed
features (the hashing trick), so the table that tasks need has a fixed size
whatever the corpus (4 bytes a feature). The damping keeps the similarity of
copies that a large group shares close to that of any other copies.

Signatures are improved consistent weighted samples (Ioffe 2010): two texts
agree on one sample with the probability of their weighted Jaccard similarity.
``BANDS`` bands of ``ROWS`` samples give candidate buckets. In a bucket, pairs
are not listed: all members are compared with one of them, then members that
are still apart from the bucket's largest class (pivots) are compared with the
others, in cells of bounded size, so every pair is either in one class or was
compared. A link needs a weighted Jaccard similarity of ``SIMILARITY`` on whole
texts; classes are the connected components of the links.

A bucket can hold very many texts that are no near duplicates (a passage that
they share). There, members carry a sketch of ``SKETCH`` further samples, of a
byte each. Pivots and members are first compared by their sketches, whole
blocks at a time, and only pairs that agree on ``LEAST_AGREEING`` samples by
their sets: a pair at 0.8 falls short of that, five standard deviations below
its mean, with a probability under one in a million.

Texts that are equal are one class from the start, whatever their number, and
go through the rest as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentrec.llm.common import U64, WordHasher, col, components, free_prefix, mix, quoted, shingles, shuffle_partitions, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 7, 2  # a pair at 0.8 shares a bucket with probability 1 - (1 - 0.8 ** 2) ** 7 = 0.9992
FEATURES = 2**20
IDF_POWER = 0.5
CHUNK = 2**14  # features in one row of counts
PIVOTS = 64  # pivots of a bucket from which on sketches are compared first
PIVOT_CHUNK = 1_024  # of them in one cell, about
MEMBERS = 1_024  # other members in one cell, about
CELL_WEIGHT = 2_000_000  # total weight (shingles, about) of either kind in one cell, about
SKETCH = 256  # samples of a sketch
LEAST_AGREEING = int(SKETCH * SIMILARITY - 5 * (SKETCH * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
GROUP = 256  # texts compared with one copy of a text


# ---- weights --------------------------------------------------------------------


def feature_of(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - (FEATURES.bit_length() - 1))).astype(np.int64)


def feature_counts(texts: DataFrame, k: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Texts that hold each hashed feature, and the number of texts.

    Tasks add up dense counts and send the chunks that are not empty; these are
    summed in two steps, as streams. What reaches the driver is the fixed-size
    table.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, df, n = WordHasher(), np.zeros(FEATURES, np.int32), 0
        for b in batches:
            for t in b["t"]:
                n += 1
                df[np.unique(feature_of(shingles(words.hashes(t), k)))] += 1
        part = TaskContext.get().partitionId()
        yield pd.DataFrame(_chunks(df.astype(np.int64), part) + [(-1, part, zlib.compress(np.array([n]).tobytes()))], columns=["c", "p", "v"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, v in zip(b["c"], b["v"]):
                v = np.frombuffer(zlib.decompress(v), np.int64)
                sums[c] = sums[c] + v if c in sums else v
        rows = [(c, 0, zlib.compress(v.tobytes(), 1)) for c, v in sums.items()]
        yield pd.DataFrame(rows, columns=["c", "p", "v"])

    schema = "c int, p int, v binary"
    spread = min(16, shuffle_partitions(texts.sparkSession))
    counted = texts.mapInPandas(count, schema).withColumn("p", F.col("p") % spread)
    once = counted.repartition("c", "p").mapInPandas(add, schema)
    rows = once.repartition("c").mapInPandas(add, schema).collect()
    df, n = np.zeros(FEATURES, np.int64), 0
    for r in rows:
        v = np.frombuffer(zlib.decompress(bytes(r["v"])), np.int64)
        if r["c"] < 0:
            n = int(v[0])
        else:
            df[r["c"] * CHUNK : (r["c"] + 1) * CHUNK] = v
    return df, n


def _chunks(df: np.ndarray, part: int) -> list[tuple]:
    rows = []
    for c in range(FEATURES // CHUNK):
        v = df[c * CHUNK : (c + 1) * CHUNK]
        if v.any():
            rows.append((c, part, zlib.compress(v.tobytes(), 1)))
    return rows


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Damped inverse document frequency of every feature, between 1 and 2 to the power."""
    norm = np.log(max(n, 1) + 1.0)
    return ((1.0 + np.log((n + 1.0) / (df + 1.0)) / norm) ** IDF_POWER).astype(np.float32)


def weighted_set(word_hashes: np.ndarray, idf: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted) and their weights."""
    h, tf = np.unique(shingles(word_hashes, k), return_counts=True)
    return h, tf * idf[feature_of(h)].astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    both = float(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


# ---- signatures -----------------------------------------------------------------


class Sampler:
    """Improved consistent weighted sampling with hashed variates.

    Every (shingle, sample) pair draws r and c from Gamma(2, 1), by inverse
    distribution tables of 2 ** 12 steps, and beta uniformly, from one 64-bit
    hash; the sample is the shingle of least ``ln c - ln y - r`` together with
    its level t.
    """

    STEPS = 2**12
    BLOCK = 1_024  # shingles at a time: the working arrays stay in the processor's cache

    def __init__(self, samples: int, seed: int = 1):
        p = (np.arange(self.STEPS) + 0.5) / self.STEPS
        lo, hi = np.zeros(self.STEPS), np.full(self.STEPS, 60.0)
        for _ in range(60):  # quantiles of Gamma(2, 1): 1 - (1 + x) exp(-x) = p
            mid = (lo + hi) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < p
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        self.r = hi.astype(np.float32)
        self.inv_r = (1 / hi).astype(np.float32)
        self.ln_c = np.log(hi).astype(np.float32)
        self.seeds = mix(np.arange(1, samples + 1, dtype=U64) + U64(seed * 1_000_003))

    def sample(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One 64-bit sample id for each seed; the set must not be empty."""
        best = np.full(len(self.seeds), np.inf, np.float32)
        out = np.zeros(len(self.seeds), U64)
        ln_w = np.log(w).astype(np.float32)
        k = np.arange(len(self.seeds))
        for at in range(0, len(h), self.BLOCK):
            hb, lw = h[at : at + self.BLOCK], ln_w[at : at + self.BLOCK]
            x = mix(hb[None, :] ^ self.seeds[:, None])
            i = (x & U64(0xFFF)).astype(np.int32)
            j = ((x >> U64(12)) & U64(0xFFF)).astype(np.int32)
            beta = (x >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
            r = self.r[i]
            t = np.floor(lw[None, :] * self.inv_r[i] + beta)
            a = self.ln_c[j] - r * (t - beta + 1)
            pick = a.argmin(1)
            least = a[k, pick]
            new = least < best
            ids = mix(hb[pick] ^ mix(t[k, pick].astype(np.int64).astype(U64) + self.seeds))
            best, out = np.where(new, least, best), np.where(new, ids, out)
        return out

    def bands(self, h: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        s = self.sample(h, w).reshape(-1, rows)
        out = np.zeros(len(s), U64)
        for j in range(rows):
            out = mix(out * U64(31) + s[:, j])
        return mix(out + np.arange(len(s), dtype=U64)).view(np.int64)


def signatures(texts: DataFrame, idf, bands: int, rows: int, k: int) -> DataFrame:
    """``(key, i, bands, weight)``: bucket keys (none for a text without words) and the total weight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sampler = WordHasher(), Sampler(bands * rows)
        for b in batches:
            found, weight = [], []
            for t in b["t"]:
                h, w = weighted_set(words.hashes(t), idf.value, k)
                found.append(sampler.bands(h, w, rows).tolist() if len(h) else [])
                weight.append(float(w.sum()))
            yield pd.DataFrame({"key": b["key"], "i": b["i"], "bands": found, "weight": weight})

    return texts.select("key", "i", "t").mapInPandas(run, "key string, i string, bands array<long>, weight double")


# ---- verification ---------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float, k: int) -> DataFrame:
    """Those ``(a, b)`` whose texts have a weighted Jaccard similarity of ``threshold``.

    ``texts`` has one ``(key, t)`` for each key. A text with many partners is
    sent once for each ``GROUP`` of them; tasks read a group as a stream and
    hold one weighted set at a time.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("n"))
    salted = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), "n").cast("int").alias("salt"))
    firsts = n.join(texts, n.a == texts.key).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(None).cast("string").alias("b"), "t"
    )
    others = salted.join(texts, salted.b == texts.key).select("a", "salt", "b", "t")
    dealt = firsts.union(others).repartition(shuffle_partitions(pairs.sparkSession), "a", "salt")
    ordered = dealt.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, now, own = WordHasher(), None, None
        for batch in batches:
            out = []
            for a, salt, b, t in zip(batch["a"], batch["salt"], batch["b"], batch["t"]):
                s = weighted_set(words.hashes(t), idf.value, k)
                if b is None:
                    now, own = (a, salt), s
                elif now == (a, salt) and similarity(own, s) >= threshold - 1e-9:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return ordered.mapInPandas(run, "a string, b string")


# ---- classes --------------------------------------------------------------------


def text_key(text_col: str):
    """Equal texts have equal keys; a null text has that of the empty one."""
    return F.md5(F.coalesce(col(text_col), F.lit("")))


def links(docs: DataFrame, threshold: float, bands: int, rows: int, k: int, id_col: str, text_col: str):
    """Signature rows ``(key, i, ...)`` of all documents, and the classes ``(node, root)`` of linked keys."""
    spark = docs.sparkSession
    texts = docs.select(
        text_key(text_col).alias("key"), col(id_col).cast("string").alias("i"), F.coalesce(col(text_col), F.lit("")).alias("t")
    )
    idf = spark.sparkContext.broadcast(idf_table(*feature_counts(texts.select("t"), k)))
    sig = stored(signatures(texts, idf, bands, rows, k), "sig")
    # one node for each distinct text; its smallest id orders the members of a bucket
    id_type = docs.schema[id_col].dataType
    nodes = sig.groupBy("key").agg(
        F.min(F.col("i").cast(id_type)).alias("id"), F.first("bands").alias("bands"), F.first("weight").alias("weight")
    )
    members = nodes.select("key", "id", "weight", "bands", F.posexplode("bands").alias("band", "h"))
    bucket = members.groupBy("band", "h").agg(F.min(F.struct("id", "key")).alias("first"), F.count(F.lit(1)).alias("n"))
    bucket = bucket.where("n > 1").select("band", "h", F.col("first.key").alias("pivot"))
    members = stored(members.join(bucket, ["band", "h"]).drop("id"), "buckets")
    involved = members.select("key").distinct()
    distinct_texts = stored(
        texts.join(involved, "key", "left_semi").select("key", "t").dropDuplicates(["key"]), "texts"
    )
    pairs = members.where("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    found = stored(verified(pairs, distinct_texts, idf, threshold, k), "links")
    roots = components(found)
    # the first member of a bucket has met all others; who is still apart from whom?
    apart = members.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    by_root = apart.groupBy("band", "h", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = by_root.groupBy("band", "h").agg(
        F.max(F.struct("n", "w", "root")).alias("most"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("w").alias("w")
    )
    parts = lambda n, w, most: F.ceil(F.greatest(n / most, w / CELL_WEIGHT)).cast("int")
    sizes = sizes.where("classes > 1").select(
        "band", "h", F.col("most.root").alias("main"),
        (F.col("n") - F.col("most.n") >= PIVOTS).alias("hot"),
        parts(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"), PIVOT_CHUNK).alias("chunks"),
        parts(F.col("n"), F.col("w"), MEMBERS).alias("salts"),
    )
    apart = stored(apart.select("band", "h", "key", "weight", "bands", "root").join(sizes, ["band", "h"]), "apart")
    needed = apart.groupBy("key").agg(F.max("hot").alias("hot"))
    sets = stored(described(needed.join(distinct_texts, "key"), idf, k), "sets")
    merged = components(stored(met(apart, sets, idf, threshold), "links"))
    own = roots.union(merged.select("node", F.col("node").alias("root"))).distinct()
    return sig, stored(renamed(own, merged), "roots")


def renamed(df: DataFrame, merged: DataFrame) -> DataFrame:
    """``df`` with roots replaced by those of the classes they were merged into."""
    new = merged.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    joined = df.join(new, F.col("root") == F.col("_from"), "left")
    return joined.select(*[c for c in df.columns if c != "root"], F.coalesce("_to", "root").alias("root"))


def described(texts: DataFrame, idf, k: int) -> DataFrame:
    """``(key, sketch, ids, tf)`` of ``(key, hot, t)``: the set of a text as bytes, and its sketch if it is in a hot bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sampler = WordHasher(), Sampler(SKETCH, seed=2)
        sampler.BLOCK = 64  # as many samples as these fill the cache with fewer shingles
        for b in batches:
            out = []
            for key, hot, t in zip(b["key"], b["hot"], b["t"]):
                h, tf = np.unique(shingles(words.hashes(t), k), return_counts=True)
                sketch = b""
                if hot:
                    sketch = sampler.sample(h, tf * idf.value[feature_of(h)].astype(np.float64)).astype(np.uint8).tobytes()
                out.append((key, sketch, h.tobytes(), tf.astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["key", "sketch", "ids", "tf"])

    return texts.select("key", "hot", "t").mapInPandas(run, "key string, sketch binary, ids binary, tf binary")


def cells(members: DataFrame) -> DataFrame:
    """Rows of the cells in which pivots (kind 0) and members (kind 1) of a bucket meet.

    Pivots are the members that are not in the bucket's largest class. They are
    dealt to ``chunks``, all members to ``salts``: a pivot has a row for each salt,
    a member for each chunk, so copies grow with the cells of a bucket, not its rows.
    """
    zero = F.lit(0)
    common = ("band", "h", "key", "weight", "bands", "root")
    lone = F.col("root") != F.col("main")
    first = members.where(lone).select(
        *common, F.pmod(F.xxhash64(F.lit(1), F.col("key")), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), lone.alias("lone"),
    )
    other = members.select(
        *common, F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), lone.alias("lone"),
    )
    return first.unionByName(other)


def met(members: DataFrame, sets: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of classes (roots) that a pivot and another member of its bucket link.

    A cell holds some pivots of a bucket and streams some of its members past
    them. Two pivots meet in one of their two cells, a pair of several buckets
    in its first band. A pivot that was linked to a class in the cell is not
    compared with the rest of it.
    """
    both = cells(members).join(sets, "key")
    cell = ("band", "h", "chunk", "salt")
    ordered = both.repartition(shuffle_partitions(members.sparkSession), *cell).sortWithinPartitions(*cell, "kind", "key")
    names = (*cell, "kind", "key", "weight", "bands", "root", "lone", "sketch", "ids", "tf")

    def weighted(h: bytes, tf: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(h, U64)
        return h, np.frombuffer(tf, np.uint32) * idf.value[feature_of(h)].astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            out = []
            for *at, kind, key, weight, bands, root, lone, sketch, ids, tf in zip(*(batch[c] for c in names)):
                if now != at:
                    now, held = at, Pivots(at[0])
                if kind == 0:
                    held.add(key, weight, bands, root, sketch, (ids, tf))
                    continue
                own = None
                for i in held.candidates(key, weight, bands, lone, sketch, threshold):
                    a = held.top(held.roots[i])
                    if a == held.top(root):
                        continue
                    if own is None:
                        own = weighted(ids, tf)
                    if similarity(held.set_of(i, weighted), own) >= threshold - 1e-9:
                        out.append((held.roots[i], root))
                        held.up[a] = held.top(root)
            yield pd.DataFrame(out, columns=["a", "b"])

    return ordered.select(*names).mapInPandas(run, "a string, b string").distinct()


class Pivots:
    """The pivots of one cell, and the classes linked there."""

    def __init__(self, band: int):
        self.band = band
        self.keys, self.weights, self.bands, self.roots, self.sketches, self.sets = [], [], [], [], [], []
        self.up: dict[str, str] = {}
        self.ready = None

    def add(self, key, weight, bands, root, sketch, own) -> None:
        self.keys.append(key)
        self.weights.append(weight)
        self.bands.append(bands)
        self.roots.append(root)
        self.sketches.append(sketch)
        self.sets.append(own)

    def top(self, root: str) -> str:
        while root in self.up:
            root = self.up[root]
        return root

    def set_of(self, i: int, weighted) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(self.sets[i][0], bytes):
            self.sets[i] = weighted(*self.sets[i])
        return self.sets[i]

    def candidates(self, key, weight, bands, lone, sketch, threshold) -> np.ndarray:
        """Pivots that a member may be similar to and that it does not meet elsewhere."""
        if self.ready is None:
            sketches = [np.frombuffer(x, np.uint8) for x in self.sketches]
            hot = bool(sketches) and all(len(x) for x in sketches)
            self.ready = (
                np.array(self.weights, np.float64),
                np.array([b[: self.band] for b in self.bands], np.int64).reshape(len(self.bands), self.band),
                np.array(self.keys, object),
                np.stack(sketches) if hot else None,
            )
        weights, earlier, keys, sketches = self.ready
        fits = np.minimum(weights, weight) >= (threshold - 1e-6) * np.maximum(weights, weight)
        fits &= keys > key if lone else keys != key
        if self.band:
            fits &= ~(earlier == np.asarray(bands[: self.band], np.int64)).any(1)
        some = np.flatnonzero(fits)
        if len(some) and sketches is not None and len(sketch):
            agreeing = np.count_nonzero(sketches[some] == np.frombuffer(sketch, np.uint8), axis=1)
            some = some[agreeing >= LEAST_AGREEING]
        return some


def near_duplicate_classes(
    docs: DataFrame,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    k: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, class_id, class_size)``, one row per row of ``docs``.

    ``class_id`` is the smallest id of the class, ``class_size`` its number of
    rows. Null and empty texts are equal to each other; texts without words
    are in a class with equal texts only. Null ids stay null, and a class that
    has no other id has a null ``class_id``. Repeated rows are copies. Other
    columns are ignored; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    sig, roots = links(docs, threshold, bands, rows, k, id_col, text_col)
    by_key = sig.groupBy("key").agg(F.min(F.col("i").cast(id_type)).alias("id"), F.count(F.lit(1)).alias("n"))
    rooted = by_key.join(roots, by_key.key == roots.node, "left").select("key", "id", "n", F.coalesce("root", "key").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    of_key = rooted.select("key", "root").join(classes.where("class_size > 1"), "root").select("key", "class_id", "class_size")
    rows_ = sig.select("key", F.col("i").cast(id_type).alias("doc_id"))
    joined = rows_.join(of_key, "key", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
    )


def keep_one(
    docs: DataFrame,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    k: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest id.

    All columns stay. Among rows of that id the smallest text stays; rows that
    are equal in both are interchangeable.
    """
    _, roots = links(docs, threshold, bands, rows, k, id_col, text_col)
    key, root, rank, node = (free_prefix(docs) + x for x in ("key", "root", "rank", "node"))
    keyed = docs.withColumn(key, text_key(text_col))
    side = roots.select(F.col("node").alias(node), F.col("root").alias(root))
    rooted = keyed.join(side, F.col(key) == F.col(node), "left").withColumn(root, F.coalesce(F.col(root), F.col(key)))
    order = Window.partitionBy(root).orderBy(col(id_col).asc_nulls_last(), F.col(key))
    kept = rooted.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return kept.select(*[kept[quoted(c)] for c in docs.columns])
