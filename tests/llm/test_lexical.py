"""Ranked lexical search against a plain version."""

import math
import random
import re

import pytest
from helpers import DOCS, EXTRA, docs_frame, odd_rows

from latentrec.llm import lexical

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_rank(rows, items, k):
    docs = [(i, plain_terms(t)) for i, t, _ in rows]
    docs = [d for d in docs if d[1]]
    total, n_docs = sum(len(t) for _, t in docs), len(docs)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(plain_terms(t))
    df = {q: sum(q in t for _, t in docs) for q in set().union(*queries.values())}
    out = set()
    for item, terms in queries.items():
        scores = []
        for i, t in docs:
            m = 100 - 90 + (90 * len(t) * n_docs) // total
            score = 0
            for q in terms & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1)))
                score += w * ((1_000_000_000 * t.count(q)) // (1000 * t.count(q) + 8 * m))
            if score > 0 and i is not None:
                scores.append((-score, i))
        out |= {(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [w + rng.choice(["", "É", "7", "X"]) for w in "alpha beta gamma delta rho tau phi chi psi omega über ñandú 中文".split()]
    vocabulary += [f"w{i}" for i in range(150)]
    share = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = odd_rows()
    for i in range(n):
        text = rng.choice([" ", "-", "_, "]).join(rng.choices(vocabulary, share, k=rng.randint(0, 60)))
        rows.append((i % 250 + 10, text, "s"))
    rows += [(1_000 + i, "same words here alpha", "s") for i in range(40)]  # ties
    items = [(j, " ".join(rng.choices(vocabulary, share, k=rng.choice([1, 5, 20])))) for j in range(25)]
    items += [(30, " ".join(vocabulary)), (31, "same WORDS here"), (32, None), (33, ""), (34, "nowhere"), (None, "alpha"), (1, "tau phi"), (35, "... !")]
    return rows, items


@pytest.mark.parametrize("seed,pairs,bits,k", [(1, 10**6, 1 << 22, 10), (2, 40, 1 << 22, 3), (3, 10**6, 192 * 50, 10)])
def test_ranking_equals_plain_version(spark, monkeypatch, seed, pairs, bits, k):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical, "MASK_BITS", bits)
    rows, items = corpus(seed)
    table = spark.createDataFrame(items, ITEMS)
    for c in EXTRA:
        table = table.withColumn(c, table["text"])
    out = lexical.rank_documents(docs_frame(spark, rows, extra=True).repartition(6), table, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert out.schema["rank"].dataType.simpleString() == "int"
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set((i, r) for i, r, _, _ in got))
    assert set(got) == plain_rank(rows, items, k)


def test_groups_that_cannot_win_are_not_scored(monkeypatch):
    """The search stops early, over batches too, and still finds the best."""
    import numpy as np

    rng = np.random.default_rng(0)
    n, v = 4_000, 12
    held = rng.random((n, v)) < rng.random(v) * 0.5
    ends = np.concatenate([[0], np.cumsum(held.sum(1))])
    terms = np.nonzero(held)[1]
    tfs = rng.integers(1, 4, len(terms))
    lengths = rng.integers(20, 40, n)
    scored = []
    real = lexical.Documents.scores
    monkeypatch.setattr(lexical.Documents, "scores", lambda self, rows, w: scored.append(len(rows)) or real(self, rows, w))
    docs = lexical.Documents(np.arange(n), lengths, ends, terms, tfs, n, int(lengths.sum()), v)
    weights = rng.integers(1, 5_000, v)
    found = lexical.search(docs, np.arange(v), weights, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    plain = np.bincount(np.repeat(np.arange(n), held.sum(1)), weights[terms] * docs.parts, n).astype(np.int64)
    order = np.lexsort((np.arange(n), -plain))[:10]
    assert found[1].tolist() == order.tolist() and found[0].tolist() == plain[order].tolist()
    assert sum(scored) < n / 2


def test_empty_tables(spark):
    rows, items = corpus(4, 20)
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.rank_documents(no_docs, spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.rank_documents(docs_frame(spark, rows), no_items).count() == 0
    assert lexical.rank_documents(docs_frame(spark, [(1, None, "s"), (2, "..", "s")]), spark.createDataFrame(items, ITEMS)).count() == 0


def test_very_long_item_and_text(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"t{rng.randrange(30_000)}" for _ in range(n)), "s") for i, n in enumerate([50, 60_000, 3, 500, 2_000])]
    items = [(1, " ".join(f"t{i}" for i in range(5_000))), (2, "t1 t2")]
    got = {tuple(r) for r in lexical.rank_documents(docs_frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == plain_rank(rows, items, 10)
