"""Secret scans: fixed patterns, and random-looking strings found by Markov models.

Two character models (order ``ORDER``) are trained from labelled samples: one
on random strings, one on ordinary identifiers and words. A candidate string
is a secret if its log-likelihood ratio per character is over ``threshold``.

Labels come from the corpus itself and a seeded generator, both bounded:

* random: values that the fixed patterns match in the sampled texts, and
  ``GENERATED`` strings drawn from the alphabets that keys use;
* ordinary: the words of the sampled texts outside of any fixed match, and
  identifiers made by joining those words.

A text over ``SAMPLE_CHARS`` is sampled by ``EXCERPTS`` excerpts, spread by a hash
over the whole of it. The models judge every candidate, of one letter case or
several. One that a fixed match covers in part is judged as a whole, too.

The models are two small tables (``N_SYMBOLS ** (ORDER + 1)`` numbers), so they
are sent to the tasks as they are; every whole text is scanned where it is
read, with no shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2_000  # texts the models are trained on, at most
SAMPLE_CHARS = 4_000  # of each of them, and the runs without blanks at the excerpts' ends
FAR, LONGEST = 8_500, 16_000  # characters to the next blank; of all parts of a text, about
EXCERPTS = 8
GENERATED = 20_000
THRESHOLD = 0.9  # nats per character
MIN_RANDOM = 16  # characters of a candidate
ORDER = 2

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
KEYWORDS = ("passw", "secret", "token", "api")

SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
N_SYMBOLS = len(SYMBOLS) + 2  # any other character, and the start
CODE = np.full(128, len(SYMBOLS), np.int64)
CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def codes(s: str) -> np.ndarray:
    raw = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    return CODE[np.minimum(raw, 127)]


class MarkovModel:
    """Character model of a fixed order with additive smoothing."""

    def __init__(self, samples: list[str], order: int = ORDER, smooth: float = 0.5):
        self.order = order
        counts = np.zeros((N_SYMBOLS**order, N_SYMBOLS))
        for s in samples:
            np.add.at(counts, self.contexts(s), 1.0)
        # contexts that were not met fall back on the plain distribution
        plain = counts.sum(0) + smooth
        counts += smooth * N_SYMBOLS * plain / plain.sum()
        self.log_p = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)

    def contexts(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        c = codes(s)
        padded = np.concatenate([np.full(self.order, N_SYMBOLS - 1), c])
        ctx = np.zeros(len(c), np.int64)
        for j in range(self.order):
            ctx = ctx * N_SYMBOLS + padded[j : j + len(c)]
        return ctx, c

    def log_likelihood(self, s: str) -> float:
        return float(self.log_p[self.contexts(s)].sum())


# Words that names in programs and configuration are made of.
NAME_WORDS = (
    "access account action address agent alert allow amount annotation app application archive argument array "
    "attribute audio author backend background batch before block body boolean bottom branch browser buffer build "
    "button bytes cache callback cancel category change channel character check child class client cluster color "
    "column command comment common component config connection console container content context controller "
    "count create current custom data database date debug default delete description detail device dialog "
    "directory document domain download driver edit element email enable encode endpoint engine entity environment "
    "error event example exception execute export extension factory feature field file filter folder format "
    "function generator global group handler header height history http identifier image implementation import "
    "index input install instance integer interface internal item iterator java job keyboard label language layer "
    "length library license limit list listener local location logger login manager mapping maximum message method "
    "minimum model module monitor name network node number object of option output package page parameter parent"
).split()


def identifiers(n: int, seed: int = 7) -> list[str]:
    """Labelled ordinary strings: names, paths and constants in the usual styles."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choices(NAME_WORDS, k=rng.randint(2, 5))
        camel = "".join(x.capitalize() for x in w)
        out.append(("_".join(w), camel, "-".join(w), "/".join(w), "_".join(w).upper(), camel[0].lower() + camel[1:])[i % 6])
    return out


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled random strings over the alphabets that keys use."""
    rng = random.Random(seed)
    kinds = (
        "0123456789abcdef",
        string.ascii_letters + string.digits,
        string.ascii_letters + string.digits + "+/",
        string.ascii_uppercase + string.digits,
        string.ascii_letters + string.digits + "_-",
        string.ascii_lowercase,
        string.ascii_uppercase,
    )
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 48))) for i in range(n)]


def labelled(texts: list[str], seed: int = 7) -> tuple[list[str], list[str]]:
    """Random and ordinary strings, from texts that the fixed patterns label."""
    rng = random.Random(seed)
    secret, plain = random_strings(GENERATED, seed), []
    for t in texts:
        rest, at = [], 0
        for start, kind, end in base_spans(t):
            value = t[start:end]
            if kind == 0:
                value = ASSIGN.match(t, start)[2]
            secret.append(value)
            rest.append(t[at:start])
            at = max(at, end)
        words = re.findall(r"[A-Za-z]{3,}", " ".join([*rest, t[at:]]))
        for i in range(0, len(words) - 3, 3):
            style = rng.randrange(6)
            w = words[i : i + 3]
            plain += w
            camel = "".join(x.capitalize() for x in w)
            low = "".join(w).lower()
            plain.append(("_".join(w), camel, "-".join(w).lower(), "/".join(w), low.upper(), low)[style])
    plain += identifiers(GENERATED, seed)
    # file names, versions, constants and numbered names are ordinary, too
    plain += [f"{rng.choice(plain)}_{rng.randrange(100)}" for _ in range(500 if plain else 0)]
    plain += [f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}" for _ in range(100)]
    plain += [c * rng.randrange(16, 60) for c in "-=_/+" for _ in range(10)]
    return secret, plain


class RandomStringDetector:
    """Log-likelihood ratio of the two models, per character."""

    def __init__(self, texts: list[str], threshold: float = THRESHOLD):
        secret, plain = labelled(texts)
        self.random, self.ordinary = MarkovModel(secret), MarkovModel(plain or ["the"])
        self.threshold = threshold

    def ratio(self, s: str) -> float:
        return (self.random.log_likelihood(s) - self.ordinary.log_likelihood(s)) / max(1, len(s))

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates over the threshold that no known span holds whole."""
        out = []
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            for a, kind, b in known:
                if kind == 0 and a < end and start < b:
                    end = max(a, start)  # an assignment's value reaches as far as a candidate can
            if end - start < MIN_RANDOM or any(a <= start and end <= b for a, _, b in known):
                continue
            if self.ratio(text[start:end]) > self.threshold:
                out.append((start, 3, end))
        return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def excerpt(text: str) -> str:
    """The text, or ``EXCERPTS`` parts of it: one at a hashed place of each of as many stretches.

    Parts begin and end at blanks, so no word is cut, unless none is within
    ``FAR`` characters; where that has made the parts ``LONGEST`` long, the
    others are cut hard.
    """
    if len(text) <= SAMPLE_CHARS:
        return text
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    size, stretch, out, at, held = SAMPLE_CHARS // EXCERPTS, len(text) / EXCERPTS, [], 0, 0
    for i in range(EXCERPTS):
        lo = max(at, int(i * stretch + rng.random() * (stretch - size)))
        far = FAR if held < LONGEST else 0
        blank = max(text.rfind(c, max(at, lo - far), lo) for c in " \n\t")
        if blank >= 0:
            lo = blank + 1
        elif lo - at <= far:
            lo = at
        hi = min(len(text), lo + size)
        ends = [e for e in (text.find(c, hi, hi + far) for c in " \n\t") if e >= 0]
        at = min(ends, default=len(text) if len(text) - hi <= far else hi)
        out.append(text[lo:at])
        held += at - lo
        if at == len(text):
            break
    return "\n".join(out)


def train(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> RandomStringDetector:
    """Detector trained on at most ``rows`` texts.

    Distinct texts are taken by a threshold on their hash that leaves about
    twice as many, and of these the smallest hashes: the same texts whatever
    the partitioning, and no task or driver receives more than that.
    """
    share = min(1.0, 2 * rows / max(1, docs.count()))
    h = F.xxhash64(text_col)
    some = docs.where(F.col(text_col).isNotNull() & (F.pmod(h, F.lit(2**40)) < int(share * 2**40)))

    def excerpts(texts: pd.Series) -> pd.Series:
        return texts.map(excerpt)

    t = F.pandas_udf(excerpts, "string")(F.col(text_col))
    sample = some.select(h.alias("h"), t.alias("t")).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(rows).collect()
    return RandomStringDetector([r["t"] for r in sample])


def scan(
    docs: DataFrame, detector: RandomStringDetector | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans)``, one row per row.

    A null text is an empty one: no spans, the hash of the empty string. Null
    ids and repeated rows are kept; other columns are ignored.
    """
    detector = detector or train(docs, text_col)
    dtype = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                t = t if isinstance(t, str) else ""
                base = base_spans(t)
                every = base + detector.spans(t, base)
                n = [sum(k == j for _, k, _ in every) for j in range(4)]
                rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(every)))
            out = pd.DataFrame(rows, columns=["na", "nc", "nh", "nr", "sha", "sp"])
            out.insert(0, "i", b["i"].values)
            yield out

    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    out = rows.mapInPandas(run, "i string, na long, nc long, nh long, nr long, sha string, sp string")
    names = ("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")
    return out.toDF(*names).withColumn("doc_id", F.col("doc_id").cast(dtype))


def redact(docs: DataFrame, detector: RandomStringDetector | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; all rows and columns stay.

    Overlapping spans are replaced as one. ``n_chars``, where the table has
    it, follows the new text. Null texts stay null.
    """
    detector = detector or train(docs, text_col)

    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, detector, mark) if isinstance(t, str) else None)

    udf = F.pandas_udf(clean, "string")
    out = docs.withColumn(text_col, udf(F.col(text_col)))
    if "n_chars" in docs.columns:
        changed = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(changed))
    return out


def redact_text(text: str, detector: RandomStringDetector, mark: str) -> str:
    base = base_spans(text)
    spans = sorted(base + detector.spans(text, base))
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
