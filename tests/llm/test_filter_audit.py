"""Filter interaction audit against a plain version, and its tries and ranges by themselves."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from helpers import DOCS, EXTRA, docs_frame, odd_rows, words

from latentrec.llm import filteraudit as fa

LABELS = "doc_id long, quality int, toxic int"


def plain_masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        mask += 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * (i is not None and least.get(t, i) < i)
        out[i, p or "", mask] += 1
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    masks = plain_masks(rows)
    out, shapley = [], Counter()
    for part in {p for _, p, _ in masks}:
        own = [(i, m, k) for (i, p, m), k in masks.items() if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                bit = 1 << "ABCDE".index(order[step - 1])
                before = sum(1 << "ABCDE".index(x) for x in order[: step - 1])
                gone = [(i, k) for i, m, k in own if m & bit and not m & before]
                values = [
                    sum(k for _, m, k in own if not m & (before | bit)),
                    sum(k for _, k in gone),
                    sum(k for _, m, k in own if m & bit and m & before),
                    sum(k for _, m, k in own if m == bit),
                    sum(k for i, k in gone if i in good),
                    sum(k for i, k in gone if i in toxic),
                ]
                shapley[part, bit] += values[1]
                out.append((part, order, step, values, bit))
    return {(p, order, step, tuple(values), shapley[p, bit]) for p, order, step, values, bit in out}


def mixed_rows():
    """Copies, a large group, near copies with a long common start, and what filters look for."""
    rng = random.Random(5)
    base = words(120, 1)
    rows = odd_rows()
    rows += [(100 + i, base, rng.choice(["s1", "s2", None])) for i in range(60)]
    rows += [(300 + i, base + f" end{i % 40}", "s2") for i in range(80)]
    rows += [(500 + i, words(rng.randint(1, 90), i % 25), rng.choice(["s3", ""])) for i in range(60)]
    rows += [(700, "A" * 30, "s1"), (701, "word " * 60, "s1"), (702, words(70, 3) + " $5 # x", "s1"), (703, "É É Ü " * 30, "s1")]
    rows += [(704, "a b c " * 30, "s1"), (705, words(80, 8) + "\x1c\x0b\x0cend", "s1"), (706, "\x00", "s1"), (-5, base, "s3")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def mixed():
    rows = mixed_rows()
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows[::2]] + [(None, 1, 1), (100, 1, 0), (9999, 1, 1)]
    return rows, labels


def test_masks_and_audit_equal_the_plain_version(spark, mixed, monkeypatch):
    monkeypatch.setattr(fa, "FIRST_DEPTH", 8)
    rows, labels = mixed
    docs = docs_frame(spark, rows, extra=True).repartition(5)
    for c in ("mask", "part", "n", "b", "m", "p", "good", "toxic", "step"):
        docs = docs.withColumn(c, docs["lang"])
    found = Counter()
    for r in fa.filter_masks(docs).collect():
        found[r.doc_id, r.part, r["mask"]] += r["n"]
    assert found == plain_masks(rows)
    marks = spark.createDataFrame(labels, LABELS)
    for c in EXTRA:
        marks = marks.withColumn(c, marks["doc_id"])
    out = fa.audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    values = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    got = [(r.part, r.filter_order, r.step, tuple(r[v] for v in values), r.shapley) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, labels)


def test_empty_tables(spark, mixed):
    none = spark.createDataFrame([], DOCS)
    assert fa.filter_masks(none).count() == 0
    assert fa.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    rows = mixed[0][:20]
    out = fa.audit(docs_frame(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert sum(r.good_lost + r.toxic_lost for r in out) == 0 and len(out) % 600 == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", "s"), ("a", "x", "s"), (None, "x", "s")], "doc_id string, text string, source string")
    assert {(r.doc_id, r["mask"]) for r in fa.filter_masks(docs).collect()} == {("a", 1), ("b", 17), (None, 1)}


def test_trie_keeps_texts_apart():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randint(0, 12))) for _ in range(3_000)]
    trie = fa.Trie()
    for i, t in enumerate(texts):
        trie.insert(t, i, t)
    nodes = list(trie.terminals())
    assert len(nodes) == len(set(texts))
    assert {n.rows[0]: n.least for n in nodes} == {t: texts.index(t) for t in set(texts)}
    assert all(len(set(n.rows)) == 1 for n in nodes)


def test_ranges_split_a_common_start(spark):
    """Texts that share 1,000 bytes still spread over the partitions; equal texts stay together."""
    rows = [(b"x" * 1_000 + b"%d" % i,) for i in range(4_000)] + [(b"%d" % i,) for i in range(4_000)]
    ranges, n = fa.adaptive_ranges(spark.createDataFrame(rows, "t binary"), 16)
    sizes = Counter(ranges.part(t) for (t,) in rows)
    assert 12 <= n <= 32 and max(sizes) < n
    assert max(sizes.values()) < 3 * 8_000 / 16
