"""Near-duplicate classes and shared passages against brute force."""

import math
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import docs_frame, edited, odd_rows, words

from latentrec.llm import minhash, passages
from latentrec.llm.common import WordHasher, components, shingles


def plain_words(text):
    import re

    return [w for w in (re.sub(r"^\W+|\W+$", "", x.lower()) for x in (text or "").split()) if w]


def plain_sets(texts, k=5):
    """Weighted shingle sets by dictionaries; features as the operator hashes them."""
    hasher = WordHasher()
    sets = [Counter(shingles(hasher.hashes(t), k).tolist()) for t in texts]
    df = Counter()
    bits = 64 - (minhash.FEATURES.bit_length() - 1)
    for s in sets:
        df.update({h >> bits for h in s})
    n = len(texts)
    weight = lambda h: (1 + math.log((n + 1) / (df[h >> bits] + 1)) / math.log(n + 1)) ** minhash.IDF_POWER
    return [{h: c * weight(h) for h, c in s.items()} for s in sets]


def plain_similarity(a, b):
    if not a or not b:
        return 0.0
    both = sum(min(w, b[h]) for h, w in a.items() if h in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def plain_classes(rows, threshold=0.8):
    """Classes by comparing all pairs; also the pairs so near the threshold that either answer is right."""
    texts = [t or "" for _, t, _ in rows]
    sets = plain_sets(texts)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for i in range(len(rows)):
        for j in range(i):
            s = 1.0 if texts[i] == texts[j] else plain_similarity(sets[i], sets[j])
            close += abs(s - threshold) < 1e-6
            if s >= threshold:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {tuple(sorted(g)) for g in groups.values()}, close


def corpus():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = words(rng.choice([30, 80, 200]), g)
        rows.append(base)
        for every in rng.choices([9, 25, 60, 120, 0], k=4):
            rows.append(edited(base, every) if every else base)
    common = words(60, 77)  # a passage of many otherwise different texts
    rows += [f"{words(80, 200 + i)} {common}" for i in range(25)]
    hot = words(300, 500)  # a large group of near copies and one of exact ones
    for i in range(60):
        w = hot.split()
        for at in rng.sample(range(300), rng.choice([2, 5, 9])):
            w[at] = f"x{i}y{at}"
        rows.append(" ".join(w))
    rows += [words(40, 900)] * 30
    rng.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("pivots", [64, 3])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "PIVOT_CHUNK", 2)
    monkeypatch.setattr(minhash, "MEMBERS", 7)
    rows = corpus()
    want, close = plain_classes(rows)
    assert not close
    # more bands than in production: nothing is left to chance
    out = minhash.near_duplicate_classes(docs_frame(spark, rows, extra=True), bands=30, rows=2).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
    assert {tuple(sorted(g)) for g in groups.values()} == want
    assert all(c == min(g) for c, g in groups.items())
    assert all(r.class_size == len(groups[r.class_id]) for r in out)


def test_keep_one_of_each_class(spark):
    rows = corpus()
    want, _ = plain_classes(rows)
    df = docs_frame(spark, rows, extra=True)
    out = minhash.keep_one(df, bands=30, rows=2)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(min(g) for g in want)


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    h.sort()
    w = rng.random(300) * 3 + 0.1
    v = w * rng.choice([1.0, 1.0, 0.5, 2.0], 300)
    keep_a, keep_b = rng.random(300) < 0.9, rng.random(300) < 0.9
    a, b = (h[keep_a], w[keep_a]), (h[keep_b], v[keep_b])
    sampler = minhash.Sampler(3_000)
    rate = (sampler.sample(*a) == sampler.sample(*b)).mean()
    assert abs(rate - minhash.similarity(a, b)) < 0.035
    assert minhash.similarity(a, a) == pytest.approx(1.0)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    out = minhash.near_duplicate_classes(docs_frame(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.class_id, r.class_size))
    assert by[1] == [(1, 2), (1, 2)]
    assert by[2] == [(2, 3)] and by[3] == [(2, 3)]  # null and empty are equal texts
    assert sorted(by[None], key=str) == [(2, 3), (None, 1)]
    assert all(by[i] == [(i, 1)] for i in (4, 5, 6, 7))
    assert minhash.near_duplicate_classes(docs_frame(spark, [])).count() == 0
    kept = minhash.keep_one(docs_frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, 4, 5, 6, 7, None], key=str)
    assert minhash.keep_one(docs_frame(spark, [])).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(200, 200), (300, 299)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(51)}, 200: 200, 299: 299, 300: 299}


# ---- passages -------------------------------------------------------------------


def test_runs_share_a_seed():
    rng = random.Random(3)
    hasher = WordHasher()
    for s in range(40):
        run = words(passages.K + passages.WINDOW - 1, s)
        a = hasher.hashes(f"{words(rng.randint(0, 30), 100 + s)} {run} {words(rng.randint(0, 30), 200 + s)}")
        b = hasher.hashes(f"{words(rng.randint(0, 30), 300 + s)} {run} {words(rng.randint(0, 30), 400 + s)}")
        assert set(passages.seeds(a)[0].tolist()) & set(passages.seeds(b)[0].tolist())


def plain_chain_score(pb, pa, k):
    """Best chain by comparing all pairs of matches."""
    m = sorted(zip(pa, pb))
    best = []
    for j, (x, y) in enumerate(m):
        gains = [best[i] - passages.GAP_COST * ((x - m[i][0]) + (y - m[i][1])) for i in range(j) if m[i][0] < x and m[i][1] < y]
        best.append(k + max([0.0, *gains]))
    return max(best)


@pytest.mark.parametrize("seed", range(10))
def test_chains_are_best(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    pb, pa = np.array([rng.randint(0, 150) for _ in range(n)]), np.array([rng.randint(0, 150) for _ in range(n)])
    pairs = sorted(set(zip(pb.tolist(), pa.tolist())))
    pb, pa = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    found = passages.chains(pb, pa)
    assert sorted(m for c in found for m in c) == pairs
    for c in found:
        assert all(x < y and u < v for (x, u), (y, v) in zip(c, c[1:]))
    top = found[0]
    score = passages.K * len(top) - passages.GAP_COST * ((top[-1][0] - top[0][0]) + (top[-1][1] - top[0][1]))
    assert score == pytest.approx(plain_chain_score(pb.tolist(), pa.tolist(), passages.K))


@pytest.mark.parametrize("seed", range(20))
def test_common_words_is_the_longest_common_subsequence(seed):
    rng = random.Random(seed)
    x, y = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert passages.common_words(np.array(x, np.uint64), np.array(y, np.uint64)) == table[-1][-1]


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(8)
    exact, fuzzy, short = words(55, 1), words(120, 2), words(35, 3)
    rows, has = [], defaultdict(list)
    for i in range(120):
        parts = [words(rng.randint(20, 90), 1_000 + i)]
        if i % 3 == 0:
            parts.append(exact)
            has["exact"].append(i)
        if i % 5 == 0:
            parts.append(edited(fuzzy, 30 + i % 7))
            has["fuzzy"].append(i)
        if i % 7 == 0:
            parts.append(short)
        parts.append(words(rng.randint(0, 60), 2_000 + i))
        rows.append((i, " ".join(parts), "s"))
    out = passages.shared_passages(docs_frame(spark, rows, extra=True)).collect()
    text = {i: t for i, t, _ in rows}
    covered = defaultdict(list)
    for r in out:
        covered[r.doc_id].append(text[r.doc_id][r.start : r.end])
        assert r.doc_id != r.other_id
        assert len(text[r.doc_id][r.start : r.end].split()) >= 40
    assert set(covered) == set(has["exact"]) | set(has["fuzzy"])
    for i in has["exact"]:
        assert any(exact in c for c in covered[i])
    for i in has["fuzzy"]:
        inside = edited(fuzzy, 30 + i % 7).split()
        assert any(" ".join(inside[14:106]) in c for c in covered[i])
    assert len(out) <= 6 * len(rows)  # in proportion to the documents, not to their pairs


def passages_of(spark, texts):
    """Pairs of documents with a row, and the words that each document's spans cover."""
    out = passages.shared_passages(docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    pairs, covered = set(), defaultdict(set)
    for r in out:
        pairs.add((r.doc_id, r.other_id))
        before = len(texts[r.doc_id][: r.start].split())
        covered[r.doc_id] |= set(range(before, before + len(texts[r.doc_id][r.start : r.end].split())))
    return pairs, covered


@pytest.mark.parametrize("holders", [2, 30])
def test_partial_quotes_hide_no_passage(spark, holders):
    whole = words(64, 50).split()
    parts = [whole[:38], whole[24:], whole[:30], whole[30:], whole[12:52]] * 6  # whichever ids hash first
    texts = [" ".join([words(25, 3_000 + i), *p, words(25, 4_000 + i)]) for i, p in enumerate(parts)]
    full = range(len(texts), len(texts) + holders)
    texts += [f"{words(25, 3_000 + i)} {' '.join(whole)} {words(25, 4_000 + i)}" for i in full]
    pairs, covered = passages_of(spark, texts)
    assert set(covered) == set(full)
    assert all(set(range(25, 89)) <= covered[i] for i in full)
    # one class: who is not listed with each other is listed by way of others
    near, ahead = {full[0]}, [full[0]]
    while ahead:
        i = ahead.pop()
        new = {b for a, b in pairs if a == i} - near
        near |= new
        ahead += new
    assert near == set(full)
    assert len(pairs) <= 4 * len(texts)


def test_pairs_beside_a_frequent_line_are_found(spark):
    line, own = words(24, 60), [words(30, 70 + i) for i in range(15)]
    # pairs (i, i + 15) share 54 words, all others the line alone, which is frequent
    texts = [f"{words(20, 5_000 + i)} {line} {own[i % 15]} {words(20, 6_000 + i)}" for i in range(30)]
    pairs, _ = passages_of(spark, texts)
    assert pairs == {(i, (i + 15) % 30) for i in range(30)}


def test_variants_under_the_threshold_hide_no_passage(spark):
    whole = words(60, 80)
    kinds = [edited(whole, 6), whole, edited(whole, 7).replace("edit", "other")]
    texts = [f"{words(20, 7_000 + i)} {kinds[i % 3]} {words(20, 8_000 + i)}" for i in range(60)]
    pairs, covered = passages_of(spark, texts)
    for kind in range(3):
        assert {i for i in covered if i % 3 == kind} in (set(range(kind, 60, 3)), set())
    assert set(range(1, 60, 3)) <= set(covered)


def test_all_pairs_are_listed_where_few_share(spark):
    rng = random.Random(12)
    blocks = [words(rng.randint(52, 80), 9_000 + b) for b in range(6)]
    held = [sorted(rng.sample(range(6), 2)) for _ in range(8)]
    texts = [f"{words(20, 9_100 + i)} {blocks[x]} {words(20, 9_200 + i)} {blocks[y]}" for i, (x, y) in enumerate(held)]
    pairs, covered = passages_of(spark, texts)
    assert pairs == {(i, j) for i in range(8) for j in range(8) if i != j and set(held[i]) & set(held[j])}


def test_a_passage_held_twice_is_matched_in_both_places(spark):
    block = words(60, 90)
    twice = f"{words(20, 91)} {block} {words(30, 92)} {block} {words(20, 93)}"
    _, covered = passages_of(spark, [twice, *[f"{words(20, 9_300 + i)} {block} {words(20, 9_400 + i)}" for i in range(3)]])
    assert set(range(20, 80)) | set(range(110, 170)) <= covered[0]


def test_words_said_again_and_again_are_a_passage(spark):
    texts = [f"{words(20, 9_500 + i)} {'the ' * n}{words(20, 9_600 + i)}" for i, n in enumerate([70, 300, 12, 55] + [20] * 20)]
    pairs, covered = passages_of(spark, texts)
    assert set(covered) == {0, 1, 3}
    assert pairs in ({(i, j) for i in (0, 1, 3) for j in (0, 1, 3) if i != j}, {(0, 1), (1, 0), (1, 3), (3, 1)})


def test_runs_and_their_matches():
    h, u, p = np.array([5] * 60 + [7, 7, 7, 9]), np.zeros(64, np.int64), np.array([*range(60), 70, 75, 99, 80])
    got = [tuple(int(v[i]) for v in passages.runs(h, u, p)) for i in range(5)]
    assert got == [(5, 0, 0, 1, 60), (7, 0, 70, 0, 1), (7, 0, 75, 0, 1), (7, 0, 99, 0, 1), (9, 0, 80, 0, 1)]
    of = lambda *rows: tuple(np.array(x) for x in zip(*rows))
    _, pb, pa = passages.matches(of((5, 0, 1, 100)), of((5, 10, 1, 60)))
    assert {(0, 10), (59, 69), (99, 69), (40, 10)} <= set(zip(pb.tolist(), pa.tolist()))
    _, pb, pa = passages.matches(of((5, 0, 0, 1), (5, 40, 0, 1)), of((5, 7, 0, 1), (5, 90, 0, 1)))
    assert set(zip(pb.tolist(), pa.tolist())) == {(0, 7), (0, 90), (40, 7), (40, 90)}


def test_pairs_of_a_frequent_line_alone_are_not_aligned(spark, monkeypatch):
    """Holders of a line in one or two places, or of one word said again, share no passage: cells pass over them."""
    line, own = words(24, 60), words(30, 61)
    texts = [f"{words(20, 5_100 + i)} {line} {words(700, 6_100 + i)} {line if i % 2 else ''} {words(20, 7_100 + i)}" for i in range(30)]
    texts += [f"{words(20, 8_100 + i)} {'so ' * (12 + i % 9)}{words(20, 9_100 + i)}" for i in range(20)]
    texts += [f"{words(20, 5_200 + i)} {line} {own} {words(20, 6_200 + i)}" for i in range(2)]
    looked, before = [], passages.apart_pairs
    monkeypatch.setattr(passages, "apart_pairs", lambda *a: looked.append(before(*a).distinct().cache()) or looked[-1])
    pairs, _ = passages_of(spark, texts)
    assert pairs == {(50, 51), (51, 50)}
    assert {(r.b, r.a) for r in looked[0].collect()} == set()


def test_seeds_of_one_class_get_no_lists(spark, monkeypatch):
    whole = words(200, 62)
    texts = [f"{words(10, 5_300 + i)} {whole} {words(10, 5_400 + i)}" for i in range(12)]
    kept, before = {}, passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, name: kept.setdefault(name, []).append(before(df, name)) or kept[name][-1])
    pairs, covered = passages_of(spark, texts)
    assert set(covered) == set(range(12)) and len(pairs) >= 22
    assert kept["members"][0].count() > 0 and kept["members"][-1].count() == 0


def test_disk_is_freed_as_passages_are_found(spark, monkeypatch):
    """Shuffle files go with their job, and what was stored for a step goes with the step."""
    whole, files = words(80, 63), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if f.startswith("shuffle_")}
    kept, before, earlier = {}, passages.stored, shuffles()
    monkeypatch.setattr(passages, "stored", lambda df, name: kept.setdefault(name, []).append(before(df, name)) or kept[name][-1])
    out = passages.shared_passages(docs_frame(spark, [(i, f"{words(10, 5_500 + i)} {whole}", "s") for i in range(4)]))
    for _ in range(50):
        if not (left := shuffles() - earlier):
            break
        time.sleep(0.2)
    assert not left
    for name in ("seeds", "lists", "hot", "chains", "groups", "texts"):
        assert kept[name] and not any(os.path.exists(df._stored_at.removeprefix("file:")) for df in kept[name])
    assert out.count() == 12


def test_a_line_far_from_its_repeat_reaches_no_passage():
    """One word said 58 times, and 35 times twice with other words between: no 50 words match, though both have as many."""
    hasher, rows = WordHasher(), []
    for text in (f"{words(20, 1)} {'so ' * 58}{words(20, 2)}", f"{words(20, 3)} {'so ' * 35}{words(35, 4)} {'so ' * 35}{words(20, 5)}", f"{'so ' * 35}{words(400, 6)} {'so ' * 35}"):
        w = hasher.hashes(text)
        h, at = passages.seeds(w)
        h, _, p, step, times = passages.runs(h, np.zeros(len(h), np.int64), at)
        e = p + step * np.maximum(times - 1, 0)
        rows.append((h, p, e, passages.beside_places(w, p, e, step, passages.K)))
    h, p, e, x = rows[0]
    for g, q, f, y in rows[1:]:
        i, j = np.nonzero(h[:, None] == g[None, :])
        assert len(i) > 1
        assert not passages.may_reach(np.zeros(len(i), np.int64), (p[i], e[i], x[i]), (q[j], f[j], y[j]), 50, 0.8, passages.K)[0]


@pytest.mark.parametrize("seed", range(6))
def test_passed_over_pairs_make_no_passage(seed):
    """``may_reach`` against chaining and aligning two texts, made of few lines and repeated words."""
    rng = random.Random(seed)
    lines = [words(n, 700 + n).split() for n in (18, 26, 34, 45)] + [["la"] * n for n in (9, 24, 46)] + [["ti", "to"] * 10]
    hasher, decided = WordHasher(), 0
    for t in range(60):
        two = []
        for side in range(2):
            parts = [edited(" ".join(rng.choice(lines)), rng.choice((9, 14, 90))).split() for _ in range(rng.randint(1, 3))]
            two.append(hasher.hashes(" ".join(w for i, x in enumerate(parts) for w in [*words(rng.choice((0, 1, 2, 12, 60)), 31 * t + 3 * side + i).split(), *x])))
        rows = []
        for w in two:
            h, at = passages.seeds(w)
            h, _, p, step, times = passages.runs(h, np.zeros(len(h), np.int64), at)
            e = p + step * np.maximum(times - 1, 0)
            rows.append((h, p, step, times, e, passages.beside_places(w, p, e, step, passages.K)))
        (h, p, step, times, e, x), (g, q, step2, times2, f, y) = rows
        i, j = np.nonzero(h[:, None] == g[None, :])
        if not 1 <= len(i) <= passages.HELD:
            continue
        hit = passages.may_reach(np.zeros(len(i), np.int64), (p[i], e[i], x[i]), (q[j], f[j], y[j]), 50, 0.8, passages.K)[0]
        _, pb, pa = passages.matches((h, p, step, times), (g, q, step2, times2))
        found = False
        for c in passages.chains(pb, pa):
            if c[-1][0] - c[0][0] + passages.K >= passages.LEAST_SPAN:
                b0, b1, a0, a1, same = passages.align(c, *two)
                length = max(b1 - b0, a1 - a0)
                found |= min(b1 - b0, a1 - a0) >= 40 and length >= 50 and same >= 0.8 * length
        assert hit or not found
        decided += not hit
    assert decided > 0


def test_passages_of_odd_rows(spark):
    long = words(3_000, 5)
    rows = odd_rows() + [(20, long, "s"), (21, edited(long, 200), "s"), (21, edited(long, 200), "s"), (None, long, "s")]
    out = passages.shared_passages(docs_frame(spark, rows, extra=True)).collect()
    assert {r.doc_id for r in out} == {20, 21, None}
    assert all(r.end - r.start > 10_000 for r in out)
    assert passages.shared_passages(docs_frame(spark, [])).count() == 0
    assert passages.shared_passages(docs_frame(spark, odd_rows())).count() == 0


def family():
    """160 texts of which most pairs are 0.4 to 0.75 similar, some near copies among them, and texts that share a line."""
    rng = random.Random(9)
    base = words(150, 41).split()
    rows = []
    for i in range(160):
        w = list(base)
        for at in rng.sample(range(150), 7):
            w[at] = f"v{i}q{at}"
        rows.append(" ".join(w))
    for i in range(0, 160, 20):
        w = rows[i].split()
        w[rng.randrange(150)] = "changed"
        rows.append(" ".join(w))
    line = words(45, 43)
    rows += [f"{line} {words(12, 600 + i)}" for i in range(90)]
    rng.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def found_classes(out):
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
    return {tuple(sorted(g)) for g in groups.values()}


@pytest.mark.parametrize("rows", [corpus, family])
def test_registered_settings_against_all_pairs(spark, rows):
    rows = rows()
    want, close = plain_classes(rows)
    assert not close and len(want) < len(rows)
    assert found_classes(minhash.near_duplicate_classes(docs_frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("n", [1_000, 2_500])
def test_copies_of_a_member_follow_the_cells_of_its_bucket(spark, n):
    """A bucket of dissimilar texts: a row for each cell of pivots or members, all cells of bounded size."""
    cells = -(-n // minhash.MEMBERS)
    rows = [(0, 7, f"k{i}", 100.0, [7], f"k{i}", "k0", cells, cells) for i in range(n)]
    members = spark.createDataFrame(
        rows, "band int, h long, key string, weight double, bands array<long>, root string, main string, chunks int, salts int"
    )
    dealt = minhash.cells(members)
    assert {r["kind"]: r["count"] for r in dealt.groupBy("kind").count().collect()} == {0: (n - 1) * cells, 1: n * cells}
    sizes = dealt.groupBy("chunk", "salt", "kind").count().collect()
    assert len(sizes) == 2 * cells * cells and max(r["count"] for r in sizes) < 1.2 * minhash.MEMBERS
    # every pivot meets every other member in exactly one cell
    pivots, others = (dealt.where(f"kind = {x}").select("chunk", "salt", F.col("key").alias(f"k{x}")) for x in (0, 1))
    assert pivots.join(others, ["chunk", "salt"]).select("k0", "k1").distinct().count() == (n - 1) * n


def test_sketches_keep_pairs_at_the_threshold():
    """Pairs a little over 0.8 agree on enough samples, pairs at 0.6 mostly do not."""
    rng = np.random.default_rng(3)
    sampler = minhash.Sampler(minhash.SKETCH, seed=2)
    passed = {0.81: 0, 0.6: 0}
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
        for s in passed:
            both = int(400 * s)
            alone = (400 - both) // 2
            w = np.ones(400)
            a, b = (np.concatenate([h[:both], h[both + i * alone : both + (i + 1) * alone]]) for i in (0, 1))
            a, b = (sampler.sample(x, w[: len(x)]).astype(np.uint8) for x in (a, b))
            passed[s] += (a == b).sum() >= minhash.LEAST_AGREEING
    assert passed[0.81] == 60 and passed[0.6] <= 10
