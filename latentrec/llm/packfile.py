"""Token-id files with Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector (low bits) and up to 60 bits of ids of one
width. The selector says how many ids the word packs::

    selector  0    1    2    3   4   5   6   7   8  9  10  11  12  13
    width     1    2    3    4   5   6   7   8  10 12  15  20  30  60
    ids      60   30   20   15  12  10   8   7   6  5   4   3   2   1

Selector 14 is the escape: its payload holds the low 32 bits and 28 bits of
the high half of one value, and the next word's payload the rest, so any
unsigned 64-bit value can be stored. Selector 15 is never written; a reader
rejects it.

A *segment* holds consecutive whole documents::

    magic  4 bytes  "S8b1"
    n_docs, n_ids, n_blocks, n_words   4 x uint32, little endian
    word offset of each block          n_blocks x uint32
    ids in each block                  n_blocks x uint32
    ids of each document               n_docs x uint32
    words                              n_words x uint64, little endian

Blocks hold ``BLOCK_IDS`` ids (the last may hold fewer) and start at a word of
their own, so each can be decoded alone; decoding is vectorised by selector.
The segments are rows of a Parquet table that Spark writes (task retries and
lost executors leave whole files only, in any store that Spark can write),
ordered by ``(part, seq)``, which is the ascending order of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentrec.llm.common import shared_path
from latentrec.llm.counts import encoder

MAGIC = b"S8b1"
BLOCK_IDS = 16_384
SEGMENT_IDS = 262_144
BYTES_PER_PARTITION = 32 * 2**20

# Bits per id of selectors 0 to 13, and ids per word.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 14
U64 = np.uint64
LIMITS = np.array([2**w - 1 for w in WIDTHS], U64)
STEPS = np.array([*COUNTS, 1])


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words of one block of unsigned ids."""
    ids = np.ascontiguousarray(ids, U64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, U64)
    # selector each id needs on its own: the narrowest width that holds it
    need = np.searchsorted(LIMITS, ids, "left").astype(np.int8)  # 14: escape
    # the selector that packs most ids from each start: all of them must fit
    widest = int(need.max())
    best = np.full(n, widest, np.int8)
    for sel in range(min(widest, len(WIDTHS)) - 1, int(need.min()) - 1, -1):
        wide = np.zeros(n + 1, np.int32)
        np.cumsum(need > sel, out=wide[1:])
        # a word is full, or takes what is left of the block (the reader knows the number)
        inner = max(0, n + 1 - COUNTS[sel])
        best[:inner][wide[COUNTS[sel] :] == wide[:inner]] = sel
        best[inner:][wide[inner:n] == wide[n]] = sel
    follow = (np.arange(n) + STEPS[best]).tolist()
    begins, i = [], 0
    while i < n:
        begins.append(i)
        i = follow[i]
    start = np.array(begins)
    sel = best[start].astype(np.int64)
    # escapes take two words
    place = np.arange(len(sel)) + np.concatenate([[0], np.cumsum(sel == ESCAPE)[:-1]])
    out = np.zeros(len(sel) + int((sel == ESCAPE).sum()), U64)
    padded = np.concatenate([ids, np.zeros(60, U64)])
    for s in np.unique(sel):
        at, to = start[sel == s], place[sel == s]
        if s == ESCAPE:
            v = ids[at]
            out[to] = U64(ESCAPE) | ((v & U64(2**60 - 1)) << U64(4))
            out[to + 1] = U64(ESCAPE) | ((v >> U64(60)) << U64(4))
            continue
        k, w = COUNTS[s], WIDTHS[s]
        shifts = (U64(4) + np.arange(k, dtype=U64) * U64(w)).astype(U64)
        out[to] = U64(s) | np.bitwise_or.reduce(padded[at[:, None] + np.arange(k)] << shifts, axis=1)
    return out


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    words = np.ascontiguousarray(words, U64)
    sel = (words & U64(15)).astype(np.int64)
    if (sel > ESCAPE).any():
        raise ValueError("unknown selector: not a block of this format")
    esc = np.flatnonzero(sel == ESCAPE)[::2]  # first words of the pairs
    size = np.array([*COUNTS, 0, 0])[sel]
    size[esc] = 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), U64)
    for s in np.unique(sel):
        if s == ESCAPE:
            out[at[esc]] = (words[esc] >> U64(4)) | ((words[esc + 1] >> U64(4)) << U64(60))
            continue
        k, w = COUNTS[s], WIDTHS[s]
        which = np.flatnonzero(sel == s)
        shifts = (U64(4) + np.arange(k, dtype=U64) * U64(w)).astype(U64)
        out[at[which][:, None] + np.arange(k)] = (words[which][:, None] >> shifts) & U64(2**w - 1)
    if len(out) < n:
        raise ValueError("block is cut short")
    return out[:n]


def encode_segment(doc_ids: list[np.ndarray], block_ids: int = BLOCK_IDS) -> bytes:
    """One segment of whole documents, given the ids of each."""
    lengths = np.array([len(x) for x in doc_ids], np.uint32)
    ids = np.concatenate([np.zeros(0, U64), *[np.asarray(x, U64) for x in doc_ids]])
    cuts = range(0, len(ids), block_ids)
    blocks = [encode_block(ids[c : c + block_ids]) for c in cuts]
    offsets = np.cumsum([0, *[len(b) for b in blocks]]).astype(np.uint32)
    sizes = np.array([min(block_ids, len(ids) - c) for c in cuts], np.uint32)
    head = np.array([len(lengths), len(ids), len(blocks), offsets[-1]], "<u4")
    words = np.concatenate([np.zeros(0, U64), *blocks]).astype("<u8")
    parts = (head, offsets[:-1].astype("<u4"), sizes.astype("<u4"), lengths.astype("<u4"), words)
    return MAGIC + b"".join(p.tobytes() for p in parts)


def decode_segment(data: bytes) -> list[np.ndarray]:
    """Ids of each document of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of this format")
    n_docs, n_ids, n_blocks, n_words = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
    at = 20
    offsets = np.frombuffer(data, "<u4", n_blocks, at)
    sizes = np.frombuffer(data, "<u4", n_blocks, at + 4 * n_blocks)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_blocks)
    words = np.frombuffer(data[at + 8 * n_blocks + 4 * n_docs :], "<u8", n_words)
    ends = [*offsets[1:], n_words]
    ids = np.concatenate(
        [np.zeros(0, U64), *[decode_block(words[a:b], int(n)) for a, b, n in zip(offsets, ends, sizes)]]
    )
    if len(ids) != n_ids:
        raise ValueError("segment is cut short")
    return np.split(ids, np.cumsum(lengths)[:-1]) if n_docs else []


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write segments to ``path``.

    Documents are range-partitioned by id (nulls first, then ascending; rows
    of equal ids by a hash of the text), so the files are in that order and one part is one
    task's rows whatever the sizes of sources. A null text is an empty one: it
    gets the end id alone. Returns the written table.
    """
    spark = docs.sparkSession
    dtype = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, arrays, held = [], [], 0

        def flush():
            row = {"part": part, "seq": seq, "before": before, "n_ids": held, "ids": ids, "payload": encode_segment(arrays)}
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for b in batches:
            for at in range(0, len(b), 256):
                piece = b.iloc[at : at + 256]
                for i, tokens in zip(piece["i"], enc.ids_many(list(piece["t"]))):
                    arrays.append(np.append(tokens, end_id).astype(U64))
                    ids.append(None if pd.isna(i) else i)
                    held += len(tokens) + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        ids, arrays, held, seq, before = [], [], 0, seq + 1, before + held
        if ids:
            yield flush()

    # a hash of the text, for bounds of the ranges are sampled on the driver
    order = (F.col("i").asc_nulls_first(), F.xxhash64("t"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "t")
    # ids travel as text, for pandas has no nullable long
    ordered = ordered.withColumn("i", F.col("i").cast("string"))
    out = ordered.mapInPandas(run, "part int, seq int, before long, n_ids long, ids array<string>, payload binary")
    out = out.withColumn("ids", F.col("ids").cast(f"array<{dtype}>"))
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document, from the files.

    ``start`` counts the ids of all documents before it: a segment knows those
    of its part, and parts (one for each task that wrote, so as many as the
    writer's partitions) are summed up in order.
    """
    ids_type = files.schema["ids"].dataType.elementType.simpleString()
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(parts), "part").select(
        (F.col("base") + F.col("before")).alias("at"), F.col("ids").cast("array<string>").alias("ids"), "payload"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, ids, payload in zip(b["at"], b["ids"], b["payload"]):
                docs = decode_segment(payload)
                n = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                yield pd.DataFrame({"i": list(ids), "s": at + np.cumsum(n) - n, "n": n, "c": crc})

    out = placed.mapInPandas(run, "i string, s long, n long, c long")
    out = out.toDF("doc_id", "start", "n_tokens", "ids_crc32")
    return out.withColumn("doc_id", F.col("doc_id").cast(ids_type))


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, tokenizer, end_id))
