"""How document filters interact: what each removes in every order of application.

Five filters look at whole texts:

* A: under 50 words; B: under 65 % distinct words; C: over 5 % capitals;
  D: a symbol of ``#$%&*|``; E: the text of a smaller id, anywhere in the table.

A to D need the text alone. E is decided with compressed radix tries. Texts are
range-partitioned by prefixes that are as long as the data demand: where one
prefix holds more than a partition's share, its texts are told apart by longer
prefixes (``Ranges``). Every batch is first inserted into a trie of its own
whose terminals hold the smallest id met; whatever is not smallest there is a
copy for certain and travels on without its text. One row a text and batch goes
to its range, where a trie of whole texts gives the smallest id of the table.

What the five filters say of a document is a mask of five bits. Documents are
reduced to counts by (part, mask), and all 120 orders are read off those.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentrec.llm.common import col, shuffle_partitions, stored

# The filters, in the order of their bits, and their limits.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65  # per cent of the words
MAX_CAPITALS = 5  # per cent of the code points
SYMBOLS = b"#$%&*|"

COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))

PART_BYTES = 64 << 20
SAMPLES = 16  # sampled texts a partition
FIRST_DEPTH = 64  # bytes; four times as many for each further level


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a UTF-8 text fails.

    ``bytes.split`` cuts at 0x20 and 0x09 to 0x0D, which is how words are defined.
    """
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, CONTINUATION)))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * n) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


# ---- compressed trie --------------------------------------------------------------


class Node:
    __slots__ = ("label", "children", "least", "rows")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.least = None  # smallest id of the text that ends here
        self.rows: list | None = None  # what was inserted for that text


class Trie:
    """Radix trie of byte strings with compressed edges."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends; made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            label = child.label
            if not text.startswith(label, at):
                k = common_length(label, text, at)
                upper = Node(label[:k])
                upper.children[label[k]] = child
                child.label = label[k:]
                node.children[text[at]] = child = upper
            node, at = child, at + len(child.label)
        return node

    def insert(self, text: bytes, key, row) -> Node:
        node = self.terminal(text)
        if key is not None and (node.least is None or key < node.least):
            node.least = key
        if node.rows is None:
            node.rows = []
        node.rows.append(row)
        return node

    def terminals(self) -> Iterator[Node]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.rows is not None:
                yield node
            stack.extend(node.children.values())


def common_length(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


# ---- ranges of adaptive prefixes --------------------------------------------------


class Ranges:
    """Partition numbers of texts by ranges of prefixes of ``depth`` bytes.

    A prefix with more than one partition's share of the texts has ranges of
    its own, of longer prefixes.
    """

    def __init__(self, depth: int):
        self.depth = depth
        self.bounds: list[bytes] = []
        self.parts = [0]
        self.longer: dict[bytes, Ranges] = {}

    def part(self, text: bytes) -> int:
        prefix = text[: self.depth]
        deeper = self.longer.get(prefix)
        return self.parts[bisect.bisect_right(self.bounds, prefix)] if deeper is None else deeper.part(text)


def adaptive_ranges(texts: DataFrame, n: int) -> tuple[Ranges, int]:
    """Ranges for about ``n`` partitions over the binary column ``t``, and their number.

    They follow a sample of ``SAMPLES`` distinct texts a partition, drawn by a
    hash of the text, and decide only where a text is worked on. The driver
    holds their prefixes, not the texts: longer ones only below a prefix that
    more than a partition's share of them have.
    """
    rows = texts.count()
    every = max(1, rows // (SAMPLES * n))
    sample = stored(texts.where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).select("t").distinct(), "ranges")
    share = max(1.0, sample.count() / n)
    used = 0

    def next_part() -> int:
        nonlocal used
        used += 1
        return used - 1

    root = Ranges(FIRST_DEPTH)
    level = {b"": root}
    depth = FIRST_DEPTH
    above = 0
    while level:
        drawn = sample
        if above:
            keys = [p for p in level]
            drawn = sample.where(F.substring("t", 1, above).isin(*keys))
        prefixes: dict[bytes, list[bytes]] = {p: [] for p in level}
        counted = drawn.groupBy(F.substring("t", 1, depth).alias("p")).count().orderBy("p")
        for p, count in counted.toLocalIterator():
            p = bytes(p)
            prefixes[p[:above]].append((p, count))
        deeper = {}
        for parent, found in prefixes.items():
            ranges = level[parent]
            ranges.parts = [next_part()]
            filled = 0
            for p, count in found:
                if count > 1.5 * share and len(p) == depth:
                    ranges.longer[p] = deeper[p] = Ranges(4 * depth)
                    continue
                if filled and filled + count > share:
                    ranges.bounds.append(p)
                    ranges.parts.append(next_part())
                    filled = 0
                filled += count
        level, above, depth = deeper, depth, 4 * depth
    return root, used


# ---- masks ------------------------------------------------------------------------


def filter_masks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``(doc_id, part, mask, n)``: ``n`` rows of a document fail the filters of ``mask``.

    Bit 0 is filter A, bit 4 is E. A null text is an empty one, a null part the
    empty string. A row without an id is no copy and nothing is a copy of it;
    rows that repeat the smallest id of a text are no copies. Other columns are
    ignored; an empty table has no masks.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(
        F.coalesce(col(text_col), F.lit("")).cast("binary").alias("t"),
        col(id_col).alias("i"),
        F.coalesce(col(part_col).cast("string"), F.lit("")).alias("p"),
    )
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges, n_parts = adaptive_ranges(rows.select("t"), max(shuffle_partitions(spark), -(-size // PART_BYTES)))
    shared = spark.sparkContext.broadcast(ranges)

    def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        spread = 0
        for b in batches:
            trie = Trie()
            for text, key, part in zip(b["t"].to_pylist(), b["i"].to_pylist(), b["p"].to_pylist()):
                trie.insert(text, key, (key, part, text))
            out = []
            for node in trie.terminals():
                text = node.rows[0][2]
                mask = own_failures(text)
                first: dict = {}
                for key, part, _ in node.rows:
                    if key is None or key != node.least:
                        out.append((spread % n_parts, None, key, part, mask | (COPY if key is not None else 0), 1))
                        spread += 1
                    else:
                        first[part] = first.get(part, 0) + 1
                if first:
                    at = ranges.part(text)
                    out += [(at, text, node.least, part, mask, n) for part, n in first.items()]
            yield record_batch(out, b.schema.field("i").type, "btipmn")

    def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        id_type = None
        for b in batches:
            id_type = b.schema.field("i").type
            text = b["t"]
            yield b.filter(text.is_null()).select(["i", "p", "m", "n"])
            b = b.filter(text.is_valid())
            for t, *row in zip(*[b[c].to_pylist() for c in ("t", "i", "p", "m", "n")]):
                trie.insert(t, row[0], row)
        out = []
        for node in trie.terminals():
            out += [(key, part, mask | (COPY if node.least < key else 0), n) for key, part, mask, n in node.rows]
            if len(out) > 10_000:
                yield record_batch(out, id_type, "ipmn")
                out = []
        if out:
            yield record_batch(out, id_type, "ipmn")

    name = kind.simpleString()
    dealt = rows.mapInArrow(in_batches, f"b int, t binary, i {name}, p string, m int, n long")
    dealt = dealt.repartitionById(n_parts, F.col("b"))
    return dealt.mapInArrow(in_ranges, f"i {name}, p string, m int, n long").select(
        F.col("i").alias("doc_id"), F.col("p").alias("part"), F.col("m").alias("mask"), "n"
    )


def record_batch(rows: list[tuple], id_type: pa.DataType, names: str) -> pa.RecordBatch:
    kinds = {"b": pa.int32(), "t": pa.binary(), "i": id_type, "p": pa.string(), "m": pa.int32(), "n": pa.int64()}
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, names)], list(names))


# ---- all orders -------------------------------------------------------------------


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """What every filter does at every step of every order, by part.

    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``. Documents and parts as in ``filter_masks``;
    a document is good (toxic) if any of its rows in ``labels`` says 1. Label
    rows without an id are ignored. No documents, no rows.
    """
    masks = filter_masks(docs, id_col, text_col, part_col)
    # one row an id, part and mask before the join, however often rows repeat
    masks = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    amount = lambda mark: F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0))
    counts = (
        masks.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), amount("good").alias("g"), amount("toxic").alias("x"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "n", "g", "x")).alias("c"))  # 32 masks at most
    )
    return all_orders(counts)


def all_orders(counts: DataFrame) -> DataFrame:
    """Rows of ``audit`` from ``(part, c)``: an array of (mask, n, g, x) a part."""
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = counts.select("part", "c", F.explode(F.split(F.lit(orders), ",")).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    bits = " + ".join(f"CAST(instr({{}}, '{f}') > 0 AS INT) * {1 << i}" for i, f in enumerate(FILTERS))
    steps = steps.selectExpr(
        "*",
        f"{bits.replace('{}', 'substr(filter_order, 1, step - 1)')} AS before",
        f"{bits.replace('{}', 'substr(filter_order, step, 1)')} AS bit",
    )
    here, earlier = "(e.mask & bit) <> 0", "(e.mask & before) <> 0"

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(c, 0L, (s, e) -> s + IF({condition}, {value}, 0L))")

    fails = len(FILTERS)
    every = 1
    for i in range(1, fails + 1):
        every *= i
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("e.n", f"NOT ({here}) AND NOT ({earlier})").alias("kept"),
        total("e.n", f"{here} AND NOT ({earlier})").alias("removed"),
        total("e.n", f"{here} AND {earlier}").alias("redundant"),
        total("e.n", "e.mask = bit").alias("unique_fails"),
        total("e.g", f"{here} AND NOT ({earlier})").alias("good_lost"),
        total("e.x", f"{here} AND NOT ({earlier})").alias("toxic_lost"),
        # of all orders, a filter comes first among the failed ones in one of as many as have failed
        total(f"e.n * ({every} DIV bit_count(e.mask))", here).alias("shapley"),
    )


AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY t) AS least
  FROM d
), f AS (
  SELECT doc_id, part,
    (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN least < doc_id THEN 16 ELSE 0 END) AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), b AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM b a, b b, b c, b d, b e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT o.filter_order, CAST(k.step AS INTEGER) AS step, b.bit,
    (SELECT coalesce(sum(y.bit), 0) FROM b y WHERE instr(o.filter_order, y.letter) < k.step) AS before
  FROM o, range(1, 6) AS k(step), b WHERE b.letter = substr(o.filter_order, k.step, 1)
), r AS (
  SELECT m.part, s.filter_order, s.step, s.bit,
    sum(CASE WHEN m.mask & s.bit = 0 AND m.mask & CAST(s.before AS INTEGER) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m.mask & s.bit <> 0 AND m.mask & CAST(s.before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m.mask & s.bit <> 0 AND m.mask & CAST(s.before AS INTEGER) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m.mask = s.bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m.mask & s.bit <> 0 AND m.mask & CAST(s.before AS INTEGER) = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN m.mask & s.bit <> 0 AND m.mask & CAST(s.before AS INTEGER) = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
