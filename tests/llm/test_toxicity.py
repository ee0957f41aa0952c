"""The toxicity network: gradients, windows, held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pytest
from helpers import docs_frame, odd_rows

from latentrec.llm import toxicity as tox

STEMS = ["wand", "lore", "mist", "pale", "grun", "tiva", "sole", "kren", "bora", "dusk"]
BAD = "zugrak"  # toxic words share only their first letters


def text(rng, n, bad=0):
    w = [rng.choice(STEMS) + rng.choice(["er", "en", "ing", "al", "o"]) for _ in range(n)]
    for _ in range(bad):
        w.insert(rng.randrange(len(w) + 1), BAD + rng.choice(["en", "ir", "osh", "al", "ut", "emm"]))
    return " ".join(w)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randint(5, 200), bad=3 if i % 4 == 0 else 0), "s") for i in range(400)]
    return rows, [(i, 1, int(i % 4 == 0)) for i, _, _ in rows]


@pytest.fixture(scope="module")
def net(labelled):
    rows, marks = labelled
    train = [(t, y) for (i, t, _), (_, _, y) in zip(rows, marks) if zlib.crc32(str(i).encode()) % 5]
    return tox.train([t for t, _ in train], [y for _, y in train], steps=120)


def test_gradients_are_those_of_the_loss():
    net = tox.Network.start(seed=2)
    for k in ("w", "b", "u", "att", "att_v", "out", "bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 7, 6 * tox.HIDDEN)).astype(np.float32)
    mask = np.arange(7) < np.array([7, 4, 1])[:, None]
    want = rng.standard_normal(3)
    _, saved = tox.forward(net, x, mask, keep=True)
    grads, d_x = tox.backward(net, saved, want, 7)
    loss = lambda: float(tox.forward(net, x, mask).astype(np.float64) @ want)
    for k in ("u", "att", "att_v", "out", "bias"):
        v, step = getattr(net, k), 1e-2
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 6)]:
            old = v[at]
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert grads[k][at] == pytest.approx((up - down) / (2 * step), abs=3e-3, rel=3e-2), (k, at)
    for at in [(0, 0, 0), (0, 6, 30), (1, 3, 47), (2, 0, 5), (1, 2, 20)]:
        old = x[at]
        x[at] = old + 1e-2
        up = loss()
        x[at] = old - 1e-2
        down = loss()
        x[at] = old
        assert d_x[at] == pytest.approx((up - down) / 2e-2, abs=3e-3, rel=3e-2), at
    assert np.abs(d_x[1, 4:]).max() == 0  # padding has no influence


def test_windows_cover_and_overlap():
    for n in [0, 1, tox.WINDOW, tox.WINDOW + 1, 5 * tox.WINDOW + 3]:
        w = tox.windows(n)
        assert set(range(n)) == {i for a, b in w for i in range(a, b)}
        assert all(c < b for (_, b), (c, _) in zip(w, w[1:]))


def test_score_is_the_highest_window(net):
    rng = random.Random(9)
    long = text(rng, 400, bad=2)
    w = long.split()
    reader = tox.Reader(net)
    parts = [" ".join(w[a:b]) for a, b in tox.windows(len(w))]
    assert tox.score_texts(reader, [long])[0] == pytest.approx(max(tox.score_texts(reader, parts)), abs=1e-5)
    # neighbours in a batch and a cleared memory change nothing
    alone = tox.score_texts(tox.Reader(net), [long, "", "x"])
    assert tox.score_texts(reader, ["", long, text(rng, 30), "x"])[[1, 0, 3]] == pytest.approx(alone, abs=1e-5)


def test_runs_without_blanks_are_read_whole(net):
    rng = random.Random(4)
    clean, tail = text(rng, 150), f"{text(rng, 100)} {BAD}en {BAD}osh {BAD}al"
    score = lambda t: tox.score_texts(tox.Reader(net), [t])[0]
    for mark in "-./":
        assert score(clean.replace(" ", mark)) == pytest.approx(score(clean), abs=1e-5)
        assert score(tail.replace(" ", mark)) == pytest.approx(score(tail), abs=1e-5)
    assert score(clean) < 0.5 < score(tail)
    # no marks at all: letters near the end still decide
    run = clean.replace(" ", "")
    assert score(run) < 0.5 < score(run + f"{BAD}en{BAD}osh{BAD}al" * 4)
    for n in (1, 40, 41, 77, 78, 1_000):
        run = "".join(rng.choices("abcdefgh", k=n))
        pieces = tox.read_words(run)
        assert max(map(len, pieces)) <= tox.MAX_WORD
        for k in tox.GRAMS:
            inside = {p[i : i + k] for p in pieces for i in range(len(p) - k + 1)}
            assert inside == {run[i : i + k] for i in range(n - k + 1)}
    assert tox.read_words("a_b " + "x" * 50 + "," + "y" * 3) == ["a_b", "x" * 40, "x" * 13 + ",", "yyy"]


def test_held_out_accuracy(spark, net, labelled):
    rows, marks = labelled
    out = tox.score(docs_frame(spark, rows), net).collect()
    truth = {i: y for i, _, y in marks}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_fit_never_sees_held_out_rows(spark, labelled):
    rows, marks = labelled
    marks = marks + [(None, 1, 1), (10_000, 1, None), (10_001, 1, 7), marks[0]]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    seen = tox.training_sample(docs_frame(spark, rows, extra=True), labels, rows=50).collect()  # what the task trains on
    texts, values = [r["t"] for r in seen], [r["y"] for r in seen]
    allowed = {t: y for (i, t, _), (_, _, y) in zip(rows, labelled[1]) if zlib.crc32(str(i).encode()) % 5}
    assert all(allowed[t] == y for t, y in zip(texts, values))
    assert values.count(0) == values.count(1) == 50


def test_odd_rows_are_scored(spark, net):
    rows = odd_rows()
    df = docs_frame(spark, rows, extra=True)
    out = tox.score(df, net).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_text = {}
    for r in out:
        by_text.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert by_text[2] == by_text[3]  # null and empty
    assert len(by_text[1]) == 1  # repeated rows
    kept = tox.drop_toxic(df, net)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted == 0 for r in out)
    empty = docs_frame(spark, [])
    assert tox.score(empty, net).count() == 0


def test_one_label_only_is_no_crash():
    assert tox.score_texts(tox.Reader(tox.train(["a b", "c"], [0, 0])), ["a", ""]).max() < 0.5
    assert tox.score_texts(tox.Reader(tox.train(["a b"], [1])), ["a"]).min() > 0.5
    assert tox.score_texts(tox.Reader(tox.train([], [])), ["a"]).max() < 0.5
