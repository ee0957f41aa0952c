"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit, a binary classifier over
hashed character n-grams learns which languages have it set. A text's language
is the codeword of least loss: the logistic losses of its bits, weighted by how
reliable their classifiers are. A text whose two best codewords are about as
near is flagged as ambiguous.

N-grams are runs of 1 to 4 bytes of the text in lower case, with every stretch
of ASCII characters that are no letters read as one blank. They are counted in
``SLOTS`` slots over the whole text, in pieces, so memory does not follow the
length of a text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentrec.llm.common import col
from latentrec.llm.toxicity import held_out

SLOTS_BITS = 13
SLOTS = 1 << SLOTS_BITS
ORDERS = 4
PIECE = 1 << 16  # bytes counted at a time
ROWS = 256  # texts scored at a time

TRAIN_TEXTS = 2_400  # texts that train, of all languages together
LEAST_TEXTS = 24  # of each language that has as many, however many languages there are
CUTS = (240, 48)  # bytes of the parts that train beside each whole text
EPOCHS = 40
BATCH = 128

EXHAUSTIVE = 7  # languages up to which the code holds every split of them
AMBIGUOUS = 0.6  # scores below are flagged
UNKNOWN = "und"

# Letters stay; ASCII characters that are no letters are blanks; bytes beyond ASCII stay.
LETTER_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else ord(" ") for b in range(256))


# ---- n-grams ----------------------------------------------------------------------


def normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(LETTER_BYTES).split()) + b" "


def slots(data: bytes) -> np.ndarray:
    """Slots of all n-grams of ``data`` that start in it."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] + np.uint32(n << 8))
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS_BITS))
    return np.concatenate(out)


def count_ngrams(data: bytes) -> np.ndarray:
    total = np.zeros(SLOTS, np.int64)
    for a in range(0, len(data), PIECE):
        total += np.bincount(slots(data[a : a + PIECE + ORDERS - 1]), minlength=SLOTS)
        if a + PIECE < len(data):  # n-grams of the overlap start in the next piece
            total -= np.bincount(slots(data[a + PIECE : a + PIECE + ORDERS - 1]), minlength=SLOTS)
    return total


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares, a unit vector a row."""
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


# ---- codes ------------------------------------------------------------------------


def codewords(n: int) -> np.ndarray:
    """Codewords of ``n`` languages, a row of -1 and 1 each.

    For few languages the columns are all splits into two groups; for more,
    the best of some seeded random codes: the largest least distance of rows.
    """
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.float32).T
    bits, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(n), None
    for _ in range(20):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = code @ code.T - np.diag(np.full(n, np.inf))
        split = np.abs(code.sum(0)).max() < n  # every bit must tell some apart
        if split and (best is None or apart.max() < best[0]):
            best = apart.max(), code
    return best[1]


@dataclass
class Languages:
    """Languages, their codewords, and the weights, bias and reliability of each bit's classifier."""

    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest codeword and its share of likelihood, for rows of features."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.reliability
        nearest = loss.argmin(1)
        return nearest, 1 / np.exp(loss.min(1, keepdims=True) - loss).sum(1)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and self.names and any(map(str.isalpha, t))]
        for a in range(0, len(known), ROWS):
            some = known[a : a + ROWS]
            x = features(np.stack([count_ngrams(normal(texts[i])) for i in some]))
            for i, best, score in zip(some, *self.decode(x)):
                out[i] = self.names[best], min(1.0, float(score))
        return out


def train(names: list[str], label: np.ndarray, sample: list[tuple[np.ndarray, np.ndarray]]) -> Languages:
    """Classifiers from n-gram counts (slots, counts) with the numbers of their languages.

    Logistic regression with all bits side by side, by Adam over seeded
    batches; languages weigh the same, however many rows they have.
    """
    code = codewords(len(names))
    bits = code.shape[1]
    model = Languages(names, code, np.zeros((SLOTS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32))
    if not bits:
        return model
    share = len(label) / (len(names) * np.bincount(label, minlength=len(names)).astype(np.float32))

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), SLOTS), np.float32)
        for at, r in enumerate(rows):
            x[at, sample[r][0]] = sample[r][1]
        return features(x)

    rng, step = np.random.default_rng(len(label)), 0
    params = [model.weights, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    steps = EPOCHS * -(-len(label) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            x, c = dense(rows), code[label[rows]]
            margin = x @ model.weights + model.bias
            d = -c / (1 + np.exp(np.clip(c * margin, -50, 50))) * share[label[rows]][:, None] / len(rows)
            step += 1
            rate = 0.1 * (1 - step / (steps + 1))
            for p, g, (m1, m2) in zip(params, (x.T @ d + 1e-5 * model.weights, d.sum(0)), moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    right = np.zeros(bits)
    for a in range(0, len(label), BATCH):
        rows = np.arange(a, min(a + BATCH, len(label)))
        c = code[label[rows]]
        right += (((dense(rows) @ model.weights + model.bias) * c > 0) * share[label[rows]][:, None]).sum(0)
    gain = np.maximum(2 * right / len(label) - 1, 0.01)
    model.reliability = (gain / gain.mean()).astype(np.float32)
    return model


# ---- Spark ------------------------------------------------------------------------


def fit(
    docs: DataFrame,
    texts: int = TRAIN_TEXTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Languages:
    """Model of all values of ``lang_col``, from documents that are not held out.

    It learns from at most ``texts`` distinct whole texts, shared alike by the
    languages (but ``LEAST_TEXTS`` of each): a threshold on a hash of the text
    leaves about twice as many, and of these the smallest hashes are taken. Rows
    without id, text or language, and texts without a letter, do not train. One
    task trains on their n-gram counts: at most ``SLOTS`` numbers for a text and
    for each of its parts.
    """
    rows = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull() & col(lang_col).isNotNull()).where(~held_out(col(id_col)))
    rows = rows.select(col(lang_col).cast("string").alias("l"), col(text_col).alias("t"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return train([], np.zeros(0, np.int64), [])
    limit = max(LEAST_TEXTS, texts // len(sizes))
    shares = [x for l, n in sizes.items() for x in (F.lit(l), F.lit(int(min(1.0, 2 * limit / n) * 2**40)))]
    rows = rows.withColumn("h", F.xxhash64("t"))
    some = rows.where(F.pmod("h", F.lit(2**40)) < F.element_at(F.create_map(*shares), F.col("l")))
    some = some.groupBy("l", "h").agg(F.min("t").alias("t"))
    order = Window.partitionBy("l").orderBy("h")
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("l", "h", "t")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, h, text in zip(*[b[c].to_pylist() for c in "lht"]):
                if not any(map(str.isalpha, text)):
                    continue
                data = normal(text)
                for part, piece in enumerate([data, *parts(data)]):
                    n = count_ngrams(piece)
                    held = np.flatnonzero(n)
                    out.append((lang, h, part, held, n[held]))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list("lhpvn"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for b in batches:
            arrays = [[x.values.to_numpy() for x in b[c]] for c in "vn"]
            sample += zip(*[b[c].to_pylist() for c in "lhp"], *arrays)
        sample.sort(key=lambda r: r[:3])
        names = sorted({r[0] for r in sample})  # languages of which some text has a letter
        label = np.searchsorted(names, [r[0] for r in sample]) if sample else np.zeros(0, np.int64)
        model = train(names, label, [(v, n.astype(np.float32)) for *_, v, n in sample])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # in a task, which has the memory for it; the driver gets the model alone
    sample = some.mapInArrow(counted, "l string, h long, p int, v array<int>, n array<int>").repartition(1)
    found = sample.mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else train([], np.zeros(0, np.int64), [])


def parts(data: bytes) -> list[bytes]:
    """Parts of a text, each at a place that a hash of the text chooses, cut at blanks."""
    out = []
    for size in CUTS:
        if len(data) > 2 * size:
            at = xxhash.xxh3_64_intdigest(data, seed=size) % (len(data) - size)
            begin = data.rfind(b" ", 0, at + 1)
            end = data.find(b" ", at + size)
            out.append(data[max(0, begin) : end + 1 or None])
    return out


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)``, one row per row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no
    letter, or where no language was learned. Null ids (not held out) and
    repeated rows are kept; other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = []
            for a in range(0, b.num_rows, ROWS):
                found += model.identify(b["t"].slice(a, ROWS).to_pylist())
            langs, scores = zip(*found) if found else ((), ())
            columns = [b["i"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "l", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(col(id_col).alias("i"), col(text_col).alias("t")).mapInArrow(run, f"i {kind}, l string, s double")
    return out.select(
        F.col("i").alias("doc_id"),
        held_out(F.col("i")).alias("held_out"),
        F.col("l").alias("lang_pred"),
        F.col("s").alias("score"),
        (F.col("s") < AMBIGUOUS).alias("ambiguous"),
    )
