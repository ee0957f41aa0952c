"""Token counts of whole texts, exact, by overlap resynchronisation.

A text is encoded with the given public tokenizer. A huge text (over
``chunk_chars``) is cut into chunks that overlap; every chunk is encoded on its
own, with the character offset of each token. Neighbouring chunks are spliced
at a *proven stable common boundary*: a position inside the overlap where

* the character before it is an ASCII blank and the one at it is an ASCII
  letter or digit (the tokenizer drops blanks before merging, and neither its
  normaliser nor a special string reaches over one, so no token and no merge
  can cross the position), and
* both encodings start a token there, and agree on every token from there to
  the end of the earlier chunk's trusted part (or on ``AGREE`` tokens).

If the overlap holds no such position it is widened (doubled) and the later
chunk encoded again, up to the whole remaining text.

Words between blanks recur, so their encodings are remembered in a bounded
memory per Python worker. The pieces are still encoded by the library itself:
splitting at a blank changes nothing, for the reason above. This needs a
tokenizer that lower-cases and drops blanks (``drops_blanks`` reads that from
its file); texts are given whole to any other.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
AGREE = 4
MEMORY_CHARS = 24_000_000  # of remembered pieces, per Python worker

STABLE = re.compile(r"(?<=[ \t\n\r])(?=[A-Za-z0-9])")
# str.split() takes these as blanks, the tokenizer does not
NOT_BLANK = "\x1c\x1d\x1e\x1f"
BLANK = re.compile(r"[ \t\n\r]+")
# Fixed value: the word pattern of the tokenizers whose pieces may be encoded alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Letters up to here are one code point in normal form and in lower case, but for one.
MARKS = ".,;:!?"
LATIN, DOTTED = "\u024f", "\u0130"


def _byte_symbols() -> dict[int, int]:
    """Byte-level symbols: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in keep]
    return {b: 256 + i for i, b in enumerate(other)}


BYTE_SYMBOLS = _byte_symbols()

_loaded: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """The tokenizer at ``path``, loaded once per Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def drops_blanks(config: dict) -> bool:
    """Whether what stands between blanks is encoded by itself, in lower case."""
    parts = (config.get("normalizer") or {}).get("normalizers") or []
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = config.get("model") or {}
    return (
        [x.get("type") for x in parts] == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in config.get("added_tokens", []))
    )


class PieceEncoder:
    """Ids, counts and token starts of texts, piece by piece between blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            self.by_pieces = drops_blanks(json.load(f))
        self.forget()

    def forget(self) -> None:
        # ids are kept as packed 32-bit integers: lists of them would take several times the memory
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.pieces = Numbered()
        self.flat, self.ends, self.chars = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def learn(self) -> None:
        """Encode the pieces that were met for the first time.

        Sentence marks at the end of a piece that follow a letter or digit are
        encoded apart from it: the word pattern cuts there, too. Latin letters,
        which neither normaliser nor pre-tokenizer changes once they are lower
        case, go straight to the library's merges; all else is given to it whole.
        """
        new, self.pieces.new = self.pieces.new, []
        collects = gc.isenabled()
        gc.disable()  # none of the many small lists below is garbage
        try:
            self._learn(new)
        finally:
            if collects:
                gc.enable()

    def _learn(self, new: list[str]) -> None:
        words, rest, split, tokenize = self.words, {}, [], self.tokenizer.model.tokenize
        for p in new:
            core = p.rstrip(MARKS)
            word = core.lower()
            if word in words:
                split.append((words, word, p[len(core) :]))
                continue
            if core and core.isalpha() and (core.isascii() or (max(core) <= LATIN and DOTTED not in core)):
                symbols = word if core.isascii() else word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
                words[word] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
                self.chars += len(word)
                split.append((words, word, p[len(core) :]))
                continue
            if not core or not core[-1].isalnum() or core[-1] > LATIN or core[-1] == DOTTED:
                core = p
            rest[core] = ()
            split.append((rest, core, p[len(core) :]))
        tails = {t: () for _, _, t in split if t not in self.tails}
        for found in (rest, tails):
            todo = list(found)
            for at in range(0, len(todo), 4096):
                part = todo[at : at + 4096]
                for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    found[x] = array("I", e.ids).tobytes()
        self.tails |= tails
        tails = self.tails
        packed = [found[core] + tails[tail] if tail else found[core] for found, core, tail in split]
        self.chars += sum(map(len, new))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(packed), np.uint32)])

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all pieces of the texts: begin and length in ``flat``; and pieces of each text."""
        if self.chars > MEMORY_CHARS:
            self.forget()
        split = [BLANK.sub(" ", t).split(" ") if any(c in t for c in NOT_BLANK) else t.split() for t in (x or "" for x in texts)]
        n = np.array([len(s) for s in split], np.int64)
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.pieces.new:
            self.learn()
        return self.ends[at], self.ends[at + 1] - self.ends[at], n

    def ids_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text is an empty one."""
        if not self.by_pieces:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, np.int64) for e in found]
        begin, length, n = self._places(texts)
        done = np.cumsum(length)
        ids = self.flat[np.arange(done[-1] if len(done) else 0) + np.repeat(begin - (done - length), length)]
        cuts = np.concatenate([[0], done])[np.cumsum(n)]
        return np.split(ids, cuts[:-1]) if len(texts) else []

    def count_many(self, texts: list[str | None]) -> np.ndarray:
        if not self.by_pieces:
            return np.array([len(x) for x in self.ids_many(texts)], np.int64)
        _, length, n = self._places(texts)
        done, last = np.concatenate([[0], np.cumsum(length)]), np.cumsum(n)
        return done[last] - done[last - n]

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and start offsets (code points) of the tokens of ``text``."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.int64), np.array([a for a, _ in e.offsets], np.int64)


class Numbered(dict):
    """Numbers pieces in the order in which they are met; ``new`` lists those to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def splice_count(
    enc: PieceEncoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> tuple[int, int, int]:
    """Tokens of one huge text by overlapping chunks; also chunks and widenings.

    ``kept`` counts tokens that start before ``cut``, the boundary up to which
    the result is final.
    """
    n = len(text)
    kept, cut, chunks, widened = 0, 0, 1, 0
    end = min(n, chunk)
    ids, at = enc.starts(text[:end])
    while end < n:
        width = overlap
        while True:
            begin = max(cut, end - width)
            stop = min(n, begin + chunk + width)
            ids2, at2 = enc.starts(text[begin:stop])
            at2 = at2 + begin
            chunks += 1
            p = common_boundary(text, ids, at, ids2, at2, begin, end)
            if p is not None or begin == cut:
                break
            width *= 2
            widened += 1
        if p is None:  # nothing left to widen: the new encoding starts at the final cut itself
            p = begin
        kept += int(np.searchsorted(at, p, "left"))
        cut = p
        keep = at2 >= p
        ids, at, end = ids2[keep], at2[keep], stop
    return kept + len(ids), chunks, widened


def common_boundary(text, ids, at, ids2, at2, begin: int, end: int) -> int | None:
    """The first stable position in ``[begin, end)`` where both encodings agree.

    The tokens of the earlier chunk are compared up to its last blank: what
    follows may be a cut word.
    """
    last = max(text.rfind(c, begin, end) for c in " \t\n\r")
    for m in STABLE.finditer(text, begin + 1, max(begin + 1, last)):
        p = m.start()
        i, j = int(np.searchsorted(at, p)), int(np.searchsorted(at2, p))
        if i >= len(at) or j >= len(at2) or at[i] != p or at2[j] != p:
            continue
        k = min(int(np.searchsorted(at, last)) - i, AGREE)
        if k >= 1 and np.array_equal(ids[i : i + k], ids2[j : j + k]) and np.array_equal(at[i : i + k], at2[j : j + k]):
            return p
    return None


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened)``, one row per row.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows
    are kept as they are; other columns are ignored. No shuffle: texts are
    counted where they are read, in batches, one chunk of a huge text at a time.
    """
    dtype = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["t"]]
            n = np.zeros((len(texts), 3), np.int64)
            # chunks can only be spliced where blanks are boundaries; other tokenizers get texts whole
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars or not enc.by_pieces]
            for at in range(0, len(short), 512):
                n[short[at : at + 512], 0] = enc.count_many([texts[i] for i in short[at : at + 512]])
            n[short, 1] = 1
            for i, t in enumerate(texts):
                if len(t) > chunk_chars and enc.by_pieces:
                    n[i] = splice_count(enc, t, chunk_chars, overlap_chars)
            yield pd.DataFrame({"i": b["i"], "b": b["b"], "n": n[:, 0], "c": n[:, 1], "w": n[:, 2]})

    rows = docs.select(
        F.col(id_col).cast("string").alias("i"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("b"),
    )
    out = rows.mapInPandas(run, "i string, b long, n long, c long, w long")
    return out.select(
        F.col("i").cast(dtype).alias("doc_id"),  # as text, for pandas has no nullable long
        F.col("b").alias("n_bytes"),
        F.col("n").alias("n_tokens"),
        (F.col("n") > limit).alias("over_limit"),
        F.col("c").alias("n_chunks"),
        F.col("w").alias("n_widened"),
    )
