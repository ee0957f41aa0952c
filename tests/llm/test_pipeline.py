"""The pipeline, stage by stage, against brute-force versions."""

import os
import random

import pytest
from helpers import docs_frame, edited, odd_rows, words
from test_mix_pack import check_pack
from test_near import plain_classes
from test_tokens import plain_base
from test_toxicity import text as toy_text

import corpus_pipeline
from latentrec.llm import minhash, toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, toy_text(rng, rng.randint(20, 120), bad=3 if i % 5 == 0 else 0), f"s{i % 3}") for i in range(240)]
    for i in range(240, 300):
        base = words(80, i % 20)
        rows.append((i, edited(base, 45) if i % 3 else base, "hot"))
    rows += [(300 + i, f"{words(20, 500 + i)} password=531ccd051a92ebcb{i:04x} {words(5, i)}", "s1") for i in range(20)]
    rows += [(330, None, None), (331, "", "s2"), (332, words(5_000, 7), "s2"), (333, words(5_000, 7), "s1")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs_frame(spark, rows).write.parquet(os.path.join(folder, "documents.parquet"))
    # some documents of every vocabulary are labelled, or the classifier cannot know it
    labels = [(i, 1, int(i < 240 and i % 5 == 0)) for i in range(320)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    return rows, folder


def triples(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_do_what_they_say(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 120)
    monkeypatch.setattr(toxicity.train, "__defaults__", (120, 5))
    monkeypatch.setattr(minhash.keep_one, "__defaults__", (0.8, 30, 2, 5, "doc_id", "text"))
    rows, folder = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mix", "pack"]
    docs, columns, results = spark.read.parquet(f"{folder}/documents.parquet"), None, []
    columns = docs.columns
    for n, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = os.path.join(folder, f"out_{n}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results.append(docs)
        assert n == "pack" or docs.columns == columns
    clean = triples(results[0])
    gone = {r[0] for r in rows} - {r[0] for r in clean}
    assert len(gone & set(range(0, 240, 5))) >= 45 and len(gone - set(range(0, 240, 5))) <= 3
    single = triples(results[1])
    want, close = plain_classes(clean)
    assert not close
    assert sorted(r[0] for r in single) == sorted(min(clean[i][0] for i in g) for g in want)
    redacted = triples(results[2])
    assert sorted(r[0] for r in redacted) == sorted(r[0] for r in single)
    assert not any(plain_base(t or "") for _, t, _ in redacted)
    before = {i: t for i, t, _ in single}
    assert all(t == before[i] or "[SECRET]" in t for i, t, _ in redacted)
    assert all(r.n_chars == len(r.text) for r in results[2].collect() if r.text is not None)
    mixed = triples(results[3])
    assert set(mixed) == set(redacted) and len(mixed) <= 2 * len(redacted)
    check_pack(mixed, results[4].collect(), 2_048, 4)


def test_stages_take_odd_rows_and_empty_tables(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity.train, "__defaults__", (5, 5))
    _, folder = corpus
    for rows in (odd_rows(), []):
        for n, stage in corpus_pipeline.STAGES:
            df = docs_frame(spark, rows, extra=True)
            out = stage(spark, df, folder)
            assert n == "pack" or out.columns == df.columns
            got = out.collect()
            if n in ("secrets", "mix", "pack"):
                assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_packed_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.packing.pack, "__defaults__", (100, 4, 128, *corpus_pipeline.packing.pack.__defaults__[3:]))
    rng = random.Random(12)
    rows = [(i, words(rng.randint(5, 60), i), rng.choice("aaaaabbbc")) for i in range(3_000)]
    mixed = corpus_pipeline.mix(spark, docs_frame(spark, rows), "")
    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    for frame in (spark.read.parquet(path), mixed):  # read from files, and not
        plan = corpus_pipeline.mixing.mix(docs_frame(spark, rows)).orderBy("mix_slot", "mix_place").collect()
        order = {}  # of each document: its places in the mix
        for at, r in enumerate(plan):
            order.setdefault(r.doc_id, []).append(at)
        out = corpus_pipeline.pack(spark, frame, "").orderBy("bin_id", "bin_offset").collect()
        assert len(out) == len(plan)
        # a piece is near its place in the mix: in its run of 128 rows
        at = [min(abs(p - i) for p in order[r.doc_id]) for i, r in enumerate(out)]
        assert max(at) < 128
        # shares of the sources over any prefix are those of the mix, but for a run
        shares = lambda found: [sum(s == x for s in found) for x in "abc"]
        for n in range(0, len(out), 50):
            want, got = shares([r.source for r in plan[:n]]), shares([r.source for r in out[:n]])
            assert max(abs(a - b) for a, b in zip(want, got)) < 64, n
        # bins are numbered by their mean places, run by run
        means = {}
        for i, r in enumerate(out):
            means.setdefault(r.bin_id, []).append(min(order[r.doc_id], key=lambda p: abs(p - i)))
        means = [sum(m) / len(m) for _, m in sorted(means.items())]
        assert sum(x <= y for x, y in zip(means, means[1:])) > 0.95 * (len(means) - 1)


def test_run_applies_all_stages(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity.train, "__defaults__", (20, 5))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = lambda: {s.getPath().getName() for s in fs.listStatus(folder) if "latentrec-llm-" in s.getPath().getName()}
    before = tables()
    out = corpus_pipeline.run(spark, corpus[1])
    assert {"doc_id", "bin_id", "n_words"} <= set(out.columns) and out.count() > 50
    # the tables of earlier stages are gone
    kinds = {name.split("-")[2] for name in tables() - before}
    assert "mix" in kinds and not kinds & {"toxicity", "near_duplicates", "secrets", "sig", "buckets", "texts", "links", "sets", "schedule"}
