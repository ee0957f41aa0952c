"""Ranked lexical search: the best documents for each item of a query table.

Scores are integers: a term's weight times a saturated term frequency, summed
over the terms that an item and a document share (``saturation``, ``weights``).

Documents are tokenised once per block of items, into rows of (id, length,
query terms, frequencies) that are written and read again for the corpus
statistics and for the search. Inside a task, each batch of documents is
searched by presence masks: one bit per term of the item tells which documents
hold it, documents with the same mask form a group, and a group's score cannot
exceed the sum of its terms' largest contributions. Groups are scored by
descending bound until the next bound is below the score of the item's k-th
document so far, so what is left out cannot be among the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from latentrec.llm.common import col, stored

# A block of items is searched in one pass over the documents; what tasks get
# of it is bounded by these.
BLOCK_PAIRS = 400_000  # (item, term) pairs
BLOCK_BYTES = 16 << 20  # of distinct terms
MASK_BITS = 1 << 22  # of the masks worked on at a time
SALTS = 64  # first step of the final ranking

# Bytes of terms (digits, letters, all of UTF-8 beyond ASCII) with
# capitals lowered; all others separate terms.
TERM_BYTES = bytes(
    b + 32 if ord("A") <= b <= ord("Z") else b if b >= 0x80 or chr(b).isalnum() else ord(" ") for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order, with repeats."""
    return text.translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, all_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // all_terms


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Block:
    """Some items, and the numbers of their terms."""

    items: list  # ids
    terms: list[np.ndarray]  # of each item, ascending
    numbers: dict[bytes, int]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The items in blocks of bounded size, read one partition at a time.

    Rows with one id make one item of all their terms; rows without id are none.
    """
    rows = items.where(col(id_col).isNotNull()).select(
        col(id_col).alias("i"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("t")
    )
    block, size, pairs = Block([], [], {}), 0, 0
    last, held = None, set()

    def close() -> None:
        nonlocal size, pairs
        size += sum(len(t) for t in held if t not in block.numbers)
        found = [block.numbers.setdefault(t, len(block.numbers)) for t in sorted(held)]
        block.items.append(last)
        block.terms.append(np.array(sorted(found), np.int64))
        pairs += len(found)

    for key, text in rows.orderBy("i").toLocalIterator():
        if key != last:
            if held:
                close()
            if pairs >= BLOCK_PAIRS or size >= BLOCK_BYTES:
                yield block
                block, size, pairs = Block([], [], {}), 0, 0
            last, held = key, set()
        held.update(terms_of(bytes(text)))
    if held:
        close()
    if block.items:
        yield block


def postings(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """``(i, n, v, f)``: id, number of terms, query terms and their frequencies; texts without terms have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(block.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            lengths, ends, ids, tfs = [], [0], [], []
            for text in b["t"]:
                words = terms_of(text.as_py())
                lengths.append(len(words))
                for word, tf in Counter(words).items():
                    at = number(word)
                    if at is not None:
                        ids.append(at)
                        tfs.append(tf)
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            columns = [
                b["i"],
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", "v", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("i"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"i {kind}, n long, v array<int>, f array<int>").where("n > 0")


class Documents:
    """A batch of documents: their query terms, and what each contributes before its weight."""

    def __init__(self, ids, lengths, ends, terms, tfs, n_docs: int, all_terms: int, n_terms: int):
        self.ids, self.ends, self.terms = ids, ends, terms
        m = np.array([length_factor(int(n), n_docs, all_terms) for n in lengths], np.int64)
        held = np.diff(ends)
        self.parts = saturation(tfs, np.repeat(m, held))
        order = np.argsort(terms, kind="stable")
        self.holders = np.repeat(np.arange(len(held)), held)[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)  # largest part of each term here
        np.maximum.at(self.most, terms, self.parts)

    def groups(self, terms: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Presence masks over ``terms`` of the documents from ``first`` to ``last - 1``.

        The distinct masks as rows of 0 and 1, and the number of each document's.
        """
        words = -(-len(terms) // 64)
        masks = np.zeros((last - first, words), np.uint64)
        for i, t in enumerate(terms):
            held = self.holders[self.bounds[t] : self.bounds[t + 1]]
            if last - first < len(self.ids):
                held = held[np.searchsorted(held, first) : np.searchsorted(held, last)] - first
            masks[held, i // 64] |= np.uint64(1 << i % 64)
        flat = masks[:, 0] if words == 1 else masks.view(f"V{8 * words}").ravel()
        distinct, group = np.unique(flat, return_inverse=True)
        distinct = distinct.view(np.uint64).reshape(-1, words)
        bits = (distinct[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return bits.reshape(len(distinct), -1)[:, : len(terms)].astype(np.int64), group

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of some documents; ``weights`` is 0 for terms that do not count."""
        held = self.ends[rows + 1] - self.ends[rows]
        first = np.cumsum(held) - held
        at = np.repeat(self.ends[rows] - first, held) + np.arange(held.sum())
        sums = np.concatenate([[0], np.cumsum(weights[self.terms[at]] * self.parts[at])])
        return sums[first + held] - sums[first]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(docs: Documents, terms: np.ndarray, weights: np.ndarray, found: tuple, k: int) -> tuple:
    """``found`` (scores, ids; best first) with this batch's documents taken in."""
    terms = terms[weights[terms] > 0]
    if not len(terms):
        return found
    own = np.zeros_like(weights)
    own[terms] = weights[terms]
    size = max(1, MASK_BITS // (64 * -(-len(terms) // 64)))
    for first in range(0, len(docs.ids), size):
        found = search_slice(docs, terms, own, found, k, first, min(first + size, len(docs.ids)))
    return found


def search_slice(docs: Documents, terms: np.ndarray, own: np.ndarray, found: tuple, k: int, first: int, last: int) -> tuple:
    bits, group = docs.groups(terms, first, last)
    bound = bits @ (own[terms] * docs.most[terms])
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[members], np.arange(len(bound) + 1))
    at, step = 0, 32
    while at < len(order):
        least = found[0][-1] if len(found[0]) == k else 1  # a score of 0 is no result
        some = order[at : at + step]
        some = some[bound[some] >= least]
        if not len(some):
            break
        rows = first + np.concatenate([members[begin[g] : begin[g + 1]] for g in some])
        scores = docs.scores(rows, own)
        good = scores >= least
        found = best_of(np.concatenate([found[0], scores[good]]), np.concatenate([found[1], docs.ids[rows[good]]]), k)
        at += step
        step *= 2
    return found


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0.

    Equal scores rank by ascending id. Every row of ``docs`` is a document of
    its own, repeated rows too; rows without id count in the statistics but are
    never returned. Item rows with one id are one item; those without id are
    none. Null texts have no terms; items without terms, and all items over an
    empty table, have no rows. Other columns are ignored.

    Items are searched in blocks of bounded size, each in one pass over all documents.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"item_id {item_kind.simpleString()}, doc_id {kind.simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    for block in blocks(items, item_col, item_text_col):
        rows = stored(postings(docs, block, id_col, text_col), "postings")
        n_docs, all_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        weights = np.zeros(len(block.numbers), np.int64)
        held = rows.select(F.explode("v").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("df"))
        for term, df in held.collect():  # as many as the block has terms, at most
            weights[term] = weight(n_docs, df)
        part = rows.where(F.col("i").isNotNull()).mapInArrow(searcher(spark, block, to_arrow_type(item_kind), weights, n_docs, all_terms, k), schema)
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc("doc_id")]
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("item_id").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def searcher(spark, block: Block, item_kind: pa.DataType, weights: np.ndarray, n_docs: int, all_terms: int, k: int):
    """Task function: the ``k`` best of all its documents, for every item of the block."""
    shared = spark.sparkContext.broadcast((block.items, block.terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights = shared.value
        best: list = [None] * len(items)
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("i").type
            ids = np.array(b["i"].to_pylist())
            v, f = b["v"], b["f"]
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (v, f)]
            here = Documents(ids, b["n"].to_numpy(zero_copy_only=False), ends, *flat, n_docs, all_terms, len(weights))
            for i, own in enumerate(terms):
                best[i] = search(here, own, weights, best[i] or (np.zeros(0, np.int64), ids[:0]), k)
        rows = [(i, found) for i, found in zip(items, best) if found is not None and len(found[0])]
        if rows:
            item_col = pa.array([i for i, (s, _) in rows for _ in s], item_kind)
            doc_col = pa.array([x for _, (_, d) in rows for x in d.tolist()], kind)
            score_col = pa.array(np.concatenate([s for _, (s, _) in rows]), pa.int64())
            yield pa.RecordBatch.from_arrays([item_col, doc_col, score_col], ["item_id", "doc_id", "score"])

    return run


RANK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), n AS (
  SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), c AS (
  SELECT p.r, p.term, f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * n.n * s.docs) // s.all_terms))) AS part
  FROM p JOIN n USING (r) JOIN f USING (term), s
), z AS (
  SELECT q.item_id, n.r, n.doc_id, CAST(sum(c.part) AS BIGINT) AS score
  FROM q JOIN c USING (term) JOIN n USING (r) WHERE n.doc_id IS NOT NULL GROUP BY q.item_id, n.r, n.doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM z WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
