"""Toxicity scores by a bidirectional gated recurrent network with attention.

A text is read in overlapping windows of ``WINDOW`` words. What stands between
blanks is a word; a run of more than ``MAX_WORD`` characters (unspaced scripts,
joined or minified text) is read as many words, see ``read_words``, so all of its
characters are in windows. A word enters as the sum of a word embedding and the mean of the embeddings of its character
n-grams (both hashed), so unseen words are judged by their letters. Two gated
recurrent units read a window forwards and backwards, attention pools their
states into one vector, and a logistic output scores the window. The score of
a text is that of its highest window, over all windows of the whole text.

The network is trained in numpy on a bounded sample of labelled texts
(``TRAIN_ROWS`` of each label, texts of at most ``TRAIN_CHARS``), from text
labels alone: the soft maximum over a text's windows is fitted to its label.
The number of steps is fixed. Scoring needs no shuffle: texts are scored where
they are read; the network's tables (a few MB, fixed) are broadcast.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentrec.llm.common import U64, col, mix

WINDOW, STRIDE = 48, 36
HIDDEN, EMBED = 8, 16
WORD_SLOTS, GRAM_SLOTS = 2**13, 2**14
GRAMS = (3, 4)
TRAIN_ROWS = 3_000  # texts of each label, at most
CALIBRATION = 3  # every third of them sets the threshold instead of training
TRAIN_CHARS = 4_000  # characters of a training text, at most
STEPS, POSITIVE, NEGATIVE = 300, 8, 24
MAX_WORD = 40  # characters of a run without blanks that is read as one word

ENDS = re.compile(r"^\W+|\W+$")
PARTS = re.compile(r"[^\W_]+[\W_]*|[\W_]+")


# ---- input: words and their character n-grams ------------------------------------


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in one array, and the number of each word's.

    A word is read with a mark before and after it.
    """
    marked = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(c))  # characters to the word's end
    found, whose = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.zeros(len(c) - n + 1, U64)
            for j in range(n):
                h = h * U64(0x100000001B3) + c[j : len(c) - n + 1 + j]
            # n-grams inside the word; a word shorter than n has one of what it is
            inside = left[: len(h)] >= n
            found.append((mix(h[inside] + U64(n)) % U64(GRAM_SLOTS)).astype(np.int64))
            whose.append(owner[: len(h)][inside])
    slots, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return slots[order], np.bincount(whose, minlength=len(words))


def word_slots(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % WORD_SLOTS for w in words], np.int64)


def read_words(text: str) -> list[str]:
    """Words of a text, in order: what stands between blanks, long runs in pieces.

    A run longer than ``MAX_WORD`` is cut after punctuation and underscores, and
    what is longer still into pieces of ``MAX_WORD`` that overlap, so that every
    n-gram of the run lies whole in a piece.
    """
    found = text.split()
    if max(map(len, found), default=0) <= MAX_WORD:
        return found
    out, step = [], MAX_WORD - max(GRAMS) + 1
    for w in found:
        for p in PARTS.findall(w) if len(w) > MAX_WORD else (w,):
            out += [p[a : a + MAX_WORD] for a in range(0, max(1, len(p) - MAX_WORD + step), step)]
    return out


def normal(raw: str) -> str:
    return ENDS.sub("", raw.lower()) or raw


# ---- network ----------------------------------------------------------------------


@dataclass
class Network:
    """Parameters; directions are stacked on the first axis of ``u`` and ``un``."""

    word: np.ndarray  # (WORD_SLOTS, EMBED)
    gram: np.ndarray  # (GRAM_SLOTS, EMBED)
    w: np.ndarray  # (EMBED, 2 * 3 * HIDDEN) input to gates of both directions
    b: np.ndarray  # (2 * 3 * HIDDEN,)
    u: np.ndarray  # (2, HIDDEN, 3 * HIDDEN) state to gates
    att: np.ndarray  # (2 * HIDDEN, 2 * HIDDEN)
    att_v: np.ndarray  # (2 * HIDDEN,)
    out: np.ndarray  # (2 * HIDDEN,)
    bias: np.ndarray  # (1,)
    shift: float = 0.0  # of the text's logit, so that 0.5 is the threshold

    NAMES = ("word", "gram", "w", "b", "u", "att", "att_v", "out", "bias")

    @classmethod
    def start(cls, seed: int = 3) -> "Network":
        rng = np.random.default_rng(seed)
        f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        h = HIDDEN
        return cls(
            f(0.1, WORD_SLOTS, EMBED), f(0.1, GRAM_SLOTS, EMBED), f(EMBED**-0.5, EMBED, 6 * h), f(0, 6 * h),
            f(h**-0.5, 2, h, 3 * h), f((2 * h) ** -0.5, 2 * h, 2 * h), f((2 * h) ** -0.5, 2 * h), f(0.3, 2 * h), f(0, 1),
        )

    def gates(self, words: list[str]) -> np.ndarray:
        """Gate inputs of each word, ``(n, 6 * HIDDEN)``."""
        slots, n = gram_slots(words)
        sums = np.add.reduceat(self.gram[slots], np.cumsum(n) - n, axis=0)
        return (self.word[word_slots(words)] + sums / n[:, None].astype(np.float32)) @ self.w + self.b


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def forward(net: Network, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window. ``x``: gate inputs ``(n, len, 6 H)``; ``mask``: ``(n, len)``.

    Both directions run in one loop; the backward one reads the steps from the end.
    """
    n, steps, _ = x.shape
    h_size = HIDDEN
    both = np.empty((steps, 2, n, 3 * h_size), np.float32)
    both[:, 0] = x[:, :, : 3 * h_size].transpose(1, 0, 2)
    both[:, 1] = x[:, ::-1, 3 * h_size :].transpose(1, 0, 2)
    full = bool(mask.all())
    m = np.stack([mask.T, mask.T[::-1]], 1).astype(np.float32)[..., None]
    h = np.zeros((2, n, h_size), np.float32)
    states = np.empty((steps, n, 2 * h_size), np.float32)
    trace = []
    for t in range(steps):
        g = both[t]
        s = h @ net.u
        rz = sigmoid(g[:, :, : 2 * h_size] + s[:, :, : 2 * h_size])
        r, z = rz[:, :, :h_size], rz[:, :, h_size:]
        c = np.tanh(g[:, :, 2 * h_size :] + r * s[:, :, 2 * h_size :])
        step = (1 - z) * (c - h)
        new = h + (step if full else m[t] * step)
        if keep:
            trace.append((h, r, z, c, s[:, :, 2 * h_size :], m[t]))
        h = new
        states[t, :, :h_size] = h[0]
        states[steps - 1 - t, :, h_size:] = h[1]
    hidden = np.tanh(states @ net.att)
    e = np.where(mask.T, hidden @ net.att_v, np.float32(-1e9))
    a = np.exp(e - e.max(0)) * mask.T
    a /= np.maximum(a.sum(0), np.float32(1e-9))
    pooled = np.einsum("tn,tnk->nk", a, states)
    logit = pooled @ net.out + net.bias[0]
    return (logit, (states, hidden, a, pooled, trace)) if keep else logit


def backward(net: Network, saved, d_logit: np.ndarray, steps: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters but the embeddings', and of the gate inputs."""
    states, hidden, a, pooled, trace = saved
    h_size = HIDDEN
    g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * net.out
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(2)
    d_e = a * (d_a - (a * d_a).sum(0))
    g["att_v"] = np.einsum("tn,tnk->k", d_e, hidden)
    d_hid = d_e[:, :, None] * net.att_v * (1 - hidden**2)
    g["att"] = np.einsum("tnk,tnl->kl", states, d_hid)
    d_states = d_states + d_hid @ net.att.T
    n = states.shape[1]
    d_x = np.zeros((steps, 2, n, 3 * h_size), np.float32)
    g["u"] = np.zeros_like(net.u)
    d_h = np.zeros((2, n, h_size), np.float32)
    ut = net.u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        h, r, z, c, sn, live = trace[t]
        d_h = d_h + np.stack([d_states[t, :, :h_size], d_states[back, :, h_size:]])
        d_new = d_h * live
        d_c = d_new * (1 - z) * (1 - c**2)
        d_z = -d_new * (c - h) * z * (1 - z)
        d_r = d_c * sn * r * (1 - r)
        d_s = np.concatenate([d_r, d_z, d_c * r], 2)
        g["u"] += h.transpose(0, 2, 1) @ d_s
        gate = np.concatenate([d_r, d_z, d_c], 2)
        d_x[t, 0], d_x[back, 1] = gate[0], gate[1]
        d_h = d_h - d_new * (1 - z) + d_s @ ut
    return g, d_x.transpose(2, 0, 1, 3).reshape(n, steps, 6 * h_size)


# ---- windows ----------------------------------------------------------------------


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover ``n`` words; an empty text has one without words."""
    if n <= WINDOW:
        return [(0, n)]
    cuts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(c, c + WINDOW) for c in cuts]


class Reader:
    """Numbers of words, with their gate inputs, in a bounded memory."""

    LIMIT = 150_000

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((4_096, 6 * HIDDEN), np.float32)

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of each text's words, rows of ``table``."""
        if len(self.number) > self.LIMIT:
            self.clear()
        split = [read_words(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self.number]
        at = len(self.number)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((at + 2 * len(new), 6 * HIDDEN), np.float32)])
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.table[at + lo : at + lo + len(part)] = self.net.gates([normal(w) for w in part])
        self.number.update(zip(new, range(at, at + len(new))))
        return [np.fromiter(map(self.number.__getitem__, s), np.int64, len(s)) for s in split]


def score_texts(reader: Reader, texts: list[str], block: int = 1_024) -> np.ndarray:
    """Score of each text: that of its highest window."""
    numbers = reader.read(texts)
    spans = [(len(numbers[i][a:b]), i, a) for i in range(len(texts)) for a, b in windows(len(numbers[i]))]
    spans.sort()  # windows of like length together: little padding
    best = np.full(len(texts), -np.inf)
    for at in range(0, len(spans), block):
        part = spans[at : at + block]
        steps = max(1, part[-1][0])
        n = np.array([p[0] for p in part])
        mask = np.arange(steps) < n[:, None]
        idx = np.zeros((len(part), steps), np.int64)
        for row, (k, i, a) in enumerate(part):
            idx[row, :k] = numbers[i][a : a + k]
        np.maximum.at(best, [p[1] for p in part], forward(reader.net, reader.table[idx], mask))
    return sigmoid(best + reader.net.shift)


# ---- training ---------------------------------------------------------------------


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 5) -> Network:
    """Fit the network to text labels; the same samples give the same network."""
    net = Network.start()
    y = np.asarray(labels)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # with few toxic texts all of them train, and set the threshold, too
    fresh = np.concatenate([x[:: CALIBRATION] if len(pos) >= 200 else x for x in (pos, neg)])
    if len(pos) >= 200:
        pos, neg = np.setdiff1d(pos, fresh), np.setdiff1d(neg, fresh)
    if not len(pos) or not len(neg):
        net.out[:], net.bias[:] = 0, 4.0 if len(pos) else -4.0  # one label only: nothing to tell apart
        return net
    rng = np.random.default_rng(seed)
    split = [[normal(w) for w in read_words(t)] for t in texts]
    vocabulary = sorted(set().union(*split))
    number = {w: i for i, w in enumerate(vocabulary)}
    docs = [np.array([number[w] for w in s], np.int64) for s in split]
    slots, grams = gram_slots(vocabulary)
    begin = np.cumsum(grams) - grams
    ids = word_slots(vocabulary)
    moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in Network.NAMES}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(pos, POSITIVE), rng.choice(neg, NEGATIVE)])
        wins, owner = [], []
        for j, d in enumerate(chosen):
            for a, b in windows(len(docs[d])):
                wins.append(docs[d][a:b])
                owner.append(j)
        owner = np.array(owner)
        mask = np.arange(WINDOW) < np.array([len(w) for w in wins])[:, None]
        idx = np.zeros((len(wins), WINDOW), np.int64)
        idx[mask] = np.concatenate(wins)
        used, place = np.unique(idx, return_inverse=True)
        place = place.reshape(idx.shape)
        # gate inputs of the words of this step; word embeddings are left out now and
        # then, so that letters alone must do
        known = (rng.random(len(used)) < 0.5).astype(np.float32)[:, None]
        length = grams[used]
        at = np.repeat(begin[used] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        g_slots, first = slots[at], np.cumsum(length) - length
        mean = np.add.reduceat(net.gram[g_slots], first, axis=0) / length[:, None].astype(np.float32)
        e = net.word[ids[used]] * known + mean
        table = e @ net.w + net.b
        logit, saved = forward(net, table[place], mask, keep=True)
        # soft maximum over the windows of a text
        top = np.full(len(chosen), -np.inf)
        np.maximum.at(top, owner, logit)
        weight = np.exp(logit - top[owner])
        total = np.bincount(owner, weight, len(chosen))
        share = weight / total[owner]
        text_logit = np.bincount(owner, share * logit, len(chosen))
        error = (sigmoid(text_logit) - y[chosen]) / len(chosen)
        d_logit = (error[owner] * share * (1 + logit - text_logit[owner])).astype(np.float32)
        g, d_x = backward(net, saved, d_logit, WINDOW)
        d_table = np.zeros_like(table)
        np.add.at(d_table, place[mask], d_x[mask])
        g["w"], g["b"] = e.T @ d_table, d_table.sum(0)
        d_e = d_table @ net.w.T
        g["word"], g["gram"] = np.zeros_like(net.word), np.zeros_like(net.gram)
        np.add.at(g["word"], ids[used], d_e * known)
        np.add.at(g["gram"], g_slots, np.repeat(d_e / length[:, None].astype(np.float32), length, axis=0))
        rate = 0.01 * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.05)
        for k in Network.NAMES:
            v, (m1, m2) = getattr(net, k), moment[k]
            m1 *= 0.9
            m1 += 0.1 * g[k]
            m2 *= 0.99
            m2 += 0.01 * g[k] ** 2
            v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    s = np.clip(score_texts(Reader(net), [texts[i] for i in fresh]).astype(np.float64), 1e-12, 1 - 1e-12)
    net.shift = -threshold(np.log(s / (1 - s)), y[fresh])
    return net


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among cuts of the fewest training errors."""
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(t == 1)]) + (t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])
    inner = np.arange(1, len(s))
    if not len(inner):
        return 0.0
    least = inner[wrong[inner] == wrong[inner].min()]
    cut = least[(s[least] - s[least - 1]).argmax()]
    return float((s[cut] + s[cut - 1]) / 2)


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: checksum of the id's text divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h, i, y, t)``: labelled texts that are not held out, in no order.

    Of each label at most ``rows`` texts are taken, by a threshold on a hash of
    the id that leaves about twice as many and then by the smallest hashes.
    Rows without id, text or label, and with other labels, are left out.
    """
    y = F.col("toxic").cast("int")
    known = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("string").alias("i"), y.alias("y"), F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2**40)).alias("h")
    )
    known = known.where(~held_out(F.col("i"))).distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # texts that are too long for training leave room for others
    short = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS))
    short = short.select(col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    parts = []
    for label in (0, 1):
        share = min(1.0, 2 * rows / max(1, sizes.get(label, 0)))
        some = known.where((F.col("y") == label) & (F.col("h") < int(share * 2**40)))
        parts.append(short.join(some, "i").groupBy("h", "i", "y").agg(F.min("t").alias("t")).orderBy("h", "i").limit(rows))
    return parts[0].union(parts[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Network trained on the texts of ``training_sample``, by one task: they are bounded in number and length."""
    settings = train.__defaults__

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [row for b in batches for row in zip(b["y"], b["h"], b["i"], b["t"])]
        sample.sort(key=lambda row: row[:3])
        net = train([t for *_, t in sample], [y for y, *_ in sample], *settings)
        yield pd.DataFrame({"net": [pickle.dumps(net)]})

    # in a task, which has the memory for it; the driver gets the network alone
    sample = training_sample(docs, labels, rows, id_col, text_col)
    found = sample.repartition(1).mapInPandas(learn, "net binary").collect()
    return pickle.loads(bytes(found[0]["net"])) if found else train([], [], *settings)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    A null text is scored as an empty one. Null ids (not held out) and repeated
    rows are kept; other columns are ignored.
    """
    dtype = docs.schema[id_col].dataType
    udf = scorer(docs, net)
    out = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), udf(F.col(text_col)).alias("score"))
    return out.withColumn("doc_id", F.col("doc_id").cast(dtype)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scorer(docs: DataFrame, net: Network):
    """Column function: score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b]
            yield pd.Series(np.concatenate([np.zeros(0), *[score_texts(reader, texts[a : a + 256]) for a in range(0, len(texts), 256)]]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def drop_toxic(docs: DataFrame, net: Network, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``limit``; all columns stay."""
    return docs.where(scorer(docs, net)(F.col(text_col)) < limit)
