"""Language identification: held-out accuracy, codes, whole texts and odd input."""

import itertools
import random
import zlib

import numpy as np
import pytest
from conftest import SF_MID
from helpers import DOCS, docs_frame, odd_rows, words

from latentrec.llm import language
from latentrec.llm.common import table


def out_rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_held_out_accuracy(spark):
    docs = table(spark, SF_MID, "documents")
    out = out_rows(language.predict(docs, language.fit(docs)))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert out.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert len(held) > 100
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) >= 0.98
    assert all(0 <= r.score <= 1 and r.ambiguous == (r.score < language.AMBIGUOUS) for r in out.values())


def test_held_out_rows_do_not_train(spark):
    """Labels of held-out rows, and the order of rows, change nothing."""
    docs = table(spark, SF_MID, "documents").limit(150).collect()
    changed = [(r.doc_id, r.text, "xx" if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.lang, r.source, r.n_chars) for r in docs]
    a = language.fit(spark.createDataFrame(docs, DOCS))
    b = language.fit(spark.createDataFrame(random.Random(1).sample(changed, len(changed)), DOCS))
    assert a.names == b.names and np.array_equal(a.weights, b.weights) and np.array_equal(a.reliability, b.reliability)


def made_language(seed):
    """Sentences over a few syllables of their own."""
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöñé", k=rng.randint(2, 3))) for _ in range(40)]

    def text(n, rng):
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))

    return text


@pytest.mark.parametrize("n", [1, 2, 11])
def test_few_and_many_languages(spark, n):
    rng, kinds = random.Random(n), [made_language(s) for s in range(n)]
    rows = [(i, kinds[i % n](rng.randint(3, 80), rng), f"l{i % n:02d}") for i in range(60 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = out_rows(language.predict(docs, language.fit(docs)))
    held = [(out[i].lang_pred, lang) for i, _, lang in rows if out[i].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_whole_text_counts(spark):
    """The language of a long text is that of most of it, wherever that stands."""
    a, b = made_language(1), made_language(2)
    rng = random.Random(0)
    rows = [(i, (a, b)[i % 2](60, rng), "ab"[i % 2]) for i in range(120)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = a(3_000, rng) + " " + b(9_000, rng)
    assert model.identify([text, b(3_000, rng) + " " + a(9_000, rng)]) != []
    assert [x for x, _ in model.identify([text, b(3_000, rng) + " " + a(9_000, rng)])] == ["b", "a"]
    mixed = model.identify([" ".join(f"{x} {y}" for x, y in zip(a(400, rng).split(), b(400, rng).split()))])
    assert mixed[0][1] < model.identify([a(800, rng)])[0][1]


def test_odd_input(spark):
    rows = odd_rows() + [(20, "12345 67", "s"), (21, "x", "s"), (22, "½ ² ٣", "s"), (23, "中文字", "s"), (24, words(200_000, 1), "s")]
    docs = docs_frame(spark, rows, extra=True)
    for c in ("l", "t", "h", "k", "p", "held_out", "lang_pred"):
        docs = docs.withColumn(c, docs["source"])
    model = language.fit(docs)
    assert model.names == ["en"]
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    got = out.collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got if r.doc_id in (2, 3, 4, 6, 20, 22)] == ["und"] * 6
    assert all(r.lang_pred == "en" for r in got if r.doc_id in (1, 5, 7, 21, 23, 24))
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    model = language.fit(none)
    assert model.names == [] and language.predict(none, model).count() == 0
    assert [r.lang_pred for r in language.predict(docs_frame(spark, [(1, "abc", "s")]), model).collect()] == ["und"]


def test_ngrams_are_counted_across_pieces(monkeypatch):
    data = language.normal(words(500, 2))
    whole = language.count_ngrams(data)
    assert whole.sum() == sum(len(data) - n + 1 for n in range(1, language.ORDERS + 1))
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.array_equal(language.count_ngrams(data), whole)


@pytest.mark.parametrize("n", [2, 4, 7, 8, 40])
def test_codewords_are_far_apart(n):
    code = language.codewords(n)
    assert np.isin(code, (-1, 1)).all() and (np.abs(code.sum(0)) < n).all()
    least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
    assert least >= (2 ** (n - 2) if n <= language.EXHAUSTIVE else code.shape[1] // 5)


def test_nearest_codeword_mends_wrong_bits():
    """A text is still decoded where one classifier in seven is wrong."""
    code = language.codewords(4)
    bits = code.shape[1]
    model = language.Languages(list("abcd"), code, np.eye(bits, dtype=np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32))
    for row, j in itertools.product(range(4), range(bits)):
        x = 3 * code[row].copy()
        x[j] *= -1
        nearest, score = model.decode(x[None])
        assert nearest[0] == row and score[0] < model.decode(3 * code[row][None])[1][0]
