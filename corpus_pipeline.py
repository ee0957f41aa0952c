"""Corpus pipeline: from raw documents to packed training sequences.

Stages, in order; each takes ``(spark, docs, sf_dir)`` and works on all rows
that the one before it kept:

1. ``toxicity``: documents that the classifier scores at 0.5 or more go. It is
   trained on the labelled documents that are not held out.
2. ``near_duplicates``: of each near-duplicate class one document stays.
3. ``secrets``: every secret found is replaced by a mark; all documents stay.
4. ``mix``: sources are interleaved by their target weights. All documents
   stay; those of sources that are short of their weight come again in later
   epochs, as rows of their own. Rows are written in the order of the mix.
5. ``pack``: documents are cut and packed into sequences, run by run of the mix.
   The order of the mix is that of the written rows; sequences in the order of
   ``bin_id`` follow it. Repeats of a document are one duplicate cluster, so they
   never share a sequence.

All stages but the last return the columns of ``documents``. SQL can express
neither the classifier nor the near-duplicate classes, so there is no
``ORACLE_SQL``; the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latentrec.llm import minhash, mixing, packing, secrets
from latentrec.llm import toxicity as tox
from latentrec.llm.common import drop, free_prefix, intermediates, shared_path, ship, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    net = tox.fit(docs, table(spark, sf_dir, "labels"))
    return tox.drop_toxic(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = free_prefix(docs) + "mix_"
    mixed = mixing.mix(docs, prefix=prefix).orderBy(prefix + "slot", prefix + "place")
    return mixed.drop(*[prefix + x for x in mixing.ADDED])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, ordered=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written and read again.

    A stage's own tables go when its result is written, and that goes when the
    next one's is; the tables behind the last result stay with it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
