"""Exact quantiles and equal-width histograms of a column in two scans, together.

The first scan counts the values in fixed bins: sign and logarithm, cut into
``STEPS`` steps for a factor of e, with the number of values, the least and the
greatest of each bin. That is a mergeable sketch with a proven error: a bin's
values differ by a factor of exp(1 / STEPS) at most, ranks of bins are exact,
and the number of bins is bounded by the range of doubles, whatever the number
of rows. The wanted order statistics lie in known bins, and all bins but those
that hold an edge of the histogram lie in one bar each.

Only if some rank or edge falls inside a bin of several values, a second scan
reads the values of those few bins: a table of (value, number) that is written
once. Anything further reads that table. Values are never gathered beyond
``max_candidates`` on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentrec.functions.columns import dlit
from latentrec.plans.layout import cut_lineage, drop_written

STEPS = 512
DEFAULT_MAX_CANDIDATES = 4_096
FEW = 4  # bins up to which their rows are fetched by bounds, where that can be done
PARTS = 1_024  # equal parts of a bin that is cut further

_X = "_x"
_KEY = "_key"

HISTOGRAM_SCHEMA = "bin bigint, bin_lo double, bin_hi double, n bigint"


def bin_sql(x: str, steps: int) -> str:
    """Number of the bin of ``x``, ascending with ``x``: 0 for 0, below 0 for negative values.

    Logarithms of doubles lie between -745 and 710; infinities are in bins of
    their own, null and NaN in none (null). Conditions on ``x`` are part of the
    number, not filters before it: those would work ``x`` out once more.
    """
    first = 750 * steps + 1
    level = "CAST(floor(least(ln({}), 720D) * {}) AS INT)"
    return (
        f"CASE WHEN isnan({x}) THEN NULL WHEN {x} > 0 THEN {first} + {level.format(x, steps)} "
        f"WHEN {x} < 0 THEN -({first} + {level.format(f'-{x}', steps)}) WHEN {x} = 0 THEN 0 END"
    )


@dataclass
class Bins:
    """Counts, least and greatest values of the bins that hold values, in order."""

    keys: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def total(self) -> int:
        return int(self.n.sum())

    def place(self, rank: int) -> tuple[int, int]:
        """Bin and place in it of the value of 0-based ``rank``."""
        ends = np.cumsum(self.n)
        b = int(np.searchsorted(ends, rank, "right"))
        return b, rank - int(ends[b] - self.n[b])

    def value(self, b: int, place: int) -> float | None:
        """The value at a place of a bin, where the bin alone tells it."""
        if place == 0 or self.lo[b] == self.hi[b]:
            return float(self.lo[b])
        return float(self.hi[b]) if place == self.n[b] - 1 else None


@dataclass
class Summary:
    """``quantiles`` by p (None without values), and the histogram, if one was wanted."""

    n: int
    lo: float | None
    hi: float | None
    quantiles: dict[float, float | None] = field(default_factory=dict)
    histogram: DataFrame | None = None


def count_bins(x: DataFrame, steps: int) -> Bins:
    rows = (
        x.selectExpr(_X, f"{bin_sql(_X, steps)} AS {_KEY}")
        .groupBy(_KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.min(_X).alias("lo"), F.max(_X).alias("hi"))
        .collect()
    )
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    keys, n, lo, hi = zip(*rows) if rows else ((), (), (), ())
    return Bins(np.array(keys, np.int64), np.array(n, np.int64), np.array(lo, float), np.array(hi, float))


def summarize(
    df: DataFrame,
    col: str,
    ps: list[float] | tuple[float, ...] = (),
    bins: int | None = None,
    steps: int = STEPS,
    max_candidates: int = DEFAULT_MAX_CANDIDATES,
    within: Callable[[list[tuple[float, float]]], DataFrame] | None = None,
) -> Summary:
    """Quantiles ``ps`` and a histogram of ``bins`` bars of ``col``, in at most two scans of ``df``.

    Nulls and NaN are ignored. Quantiles interpolate linearly between the two
    order statistics around rank ``(n - 1) * p``. ``within`` may give the rows
    of ``df`` with values in some closed intervals at less cost than a scan.
    """
    if any(not 0.0 <= p <= 1.0 for p in ps):
        raise ValueError("p must be within [0, 1]")
    values = lambda frame: frame.select(F.col(col).cast("double").alias(_X))
    found = count_bins(values(df), steps)
    n = found.total
    if not n:
        none = df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA) if bins else None
        return Summary(0, None, None, dict.fromkeys(ps), none)
    lo, hi = float(found.lo[0]), float(found.hi[-1])
    bars = Bars(lo, hi, bins) if bins else None

    ranks = {r: found.place(r) for p in ps for r in _ranks(n, p)}
    known = {r: found.value(*at) for r, at in ranks.items()}
    inside = sorted({ranks[r][0] for r, v in known.items() if v is None})
    straddling = [] if bars is None else [b for b in range(len(found.n)) if bars.of(found.lo[b]) != bars.of(found.hi[b])]
    counts = np.zeros(bins or 0, np.int64)
    if bars is not None:
        whole = np.setdiff1d(np.arange(len(found.n)), straddling)
        for b in whole:
            counts[bars.of(found.lo[b])] += found.n[b]
    if inside or straddling:
        wanted = sorted({*inside, *straddling})
        pruned = within is not None and len(wanted) <= FEW
        source = within([(float(found.lo[b]), float(found.hi[b])) for b in wanted]) if pruned else df
        keys = lambda some: ", ".join(str(int(found.keys[b])) for b in some) or "NULL"
        rows = values(source).selectExpr(_X, f"{bin_sql(_X, steps)} AS {_KEY}").where(f"{_KEY} IN ({keys(wanted)})")
        counted = rows.selectExpr(
            _KEY,
            f"CASE WHEN {_KEY} IN ({keys(inside)}) THEN {_X} END AS v",
            f"CASE WHEN {_KEY} IN ({keys(straddling)}) THEN {bars.sql(_X) if straddling else 'NULL'} END AS bar",
        )
        narrow = cut_lineage(counted.groupBy(_KEY, "v", "bar").agg(F.count(F.lit(1)).alias("n")), "bins")
        if straddling:
            for r in narrow.where("bar IS NOT NULL").groupBy("bar").agg(F.sum("n").alias("n")).collect():
                counts[r["bar"]] += r["n"]
        for b in inside:
            own = narrow.where((F.col(_KEY) == int(found.keys[b])) & F.col("v").isNotNull()).groupBy("v").agg(F.sum("n").alias("n"))
            places = {r: at[1] for r, at in ranks.items() if at[0] == b and known[r] is None}
            values_at = order_statistics(own, float(found.lo[b]), float(found.hi[b]), sorted(places.values()), max_candidates)
            known |= {r: values_at[place] for r, place in places.items()}
        drop_written(narrow)
    out = Summary(n, lo, hi)
    for p in ps:
        low, frac = math.floor((n - 1) * p), (n - 1) * p - math.floor((n - 1) * p)
        out.quantiles[p] = known[low] if frac == 0 else known[low] + frac * (known[low + 1] - known[low])
    if bars is not None:
        out.histogram = bars.table(df.sparkSession, counts)
    return out


def _ranks(n: int, p: float) -> list[int]:
    """0-based ranks that a quantile is interpolated from."""
    h = (n - 1) * p
    return [math.floor(h)] if h == math.floor(h) else [math.floor(h), math.floor(h) + 1]


@dataclass
class Bars:
    """Equal-width bars over [lo, hi]; a single value gets a unit-wide range around it."""

    lo: float
    hi: float
    bins: int

    def __post_init__(self):
        if self.hi == self.lo:
            self.lo, self.hi = self.lo - 0.5, self.hi + 0.5

    def of(self, x: float) -> int:
        """The bar of a value; the same operations as in ``sql``, so both agree in every bit."""
        return min(math.floor((float(x) - self.lo) / (self.hi - self.lo) * self.bins), self.bins - 1)

    def sql(self, x: str) -> str:
        width = dlit(self.hi - self.lo)
        return f"least(CAST(floor(({x} - {dlit(self.lo)}) / {width} * {float(self.bins)}D) AS BIGINT), {self.bins - 1}L)"

    def table(self, spark, counts: np.ndarray) -> DataFrame:
        width = (self.hi - self.lo) / self.bins
        rows = [(b, self.lo + b * width, self.lo + (b + 1) * width, int(n)) for b, n in enumerate(counts)]
        return spark.createDataFrame(rows, HISTOGRAM_SCHEMA)


def order_statistics(values: DataFrame, lo: float, hi: float, places: list[int], max_candidates: int) -> dict[int, float]:
    """Values at 0-based ``places`` of ``(v, n)`` rows with distinct ``v`` between ``lo`` and ``hi``.

    The range is cut into ``PARTS`` equal parts, and the part with the place
    again, until at most ``max_candidates`` rows are left to read.
    """
    out: dict[int, float] = {}
    todo = [(values, lo, hi, 0, places)]
    while todo:
        rows, lo, hi, before, places = todo.pop()
        few = rows.orderBy("v").limit(max_candidates + 1).collect()
        if len(few) <= max_candidates:
            ends = before + np.cumsum([r["n"] for r in few])
            for place in places:
                out[place] = float(few[int(np.searchsorted(ends, place, "right"))]["v"])
            continue
        part = f"least(CAST(floor((v - {dlit(lo)}) / {dlit(hi - lo)} * {PARTS}D) AS INT), {PARTS - 1})"
        tagged = rows.selectExpr("v", "n", f"{part} AS part")
        found = tagged.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        found.sort(key=lambda r: r["part"])
        ends = before + np.cumsum([r["n"] for r in found])
        by_part: dict[int, list[int]] = {}
        for place in places:
            by_part.setdefault(int(np.searchsorted(ends, place, "right")), []).append(place)
        for at, own in by_part.items():
            r = found[at]
            if r["lo"] == r["hi"]:
                out |= {place: float(r["lo"]) for place in own}
            else:
                some = tagged.where(F.col("part") == r["part"]).select("v", "n")
                todo.append((some, r["lo"], r["hi"], int(ends[at] - r["n"]), own))
    return out


def exact_quantile(
    df: DataFrame,
    col: str,
    p: float,
    accuracy: int = STEPS,
    max_candidates: int = DEFAULT_MAX_CANDIDATES,
    within: Callable[[list[tuple[float, float]]], DataFrame] | None = None,
) -> float | None:
    """Quantile ``p`` of ``col`` (nulls ignored), linear interpolation between
    the two order statistics around rank ``(n - 1) * p``; ``accuracy`` is the
    number of bins for a factor of e."""
    return summarize(df, col, [p], steps=accuracy, max_candidates=max_candidates, within=within).quantiles[p]


def quantile_table(df: DataFrame, col: str, p: float, **kw) -> DataFrame:
    """One row ``(p, value)`` holding the exact quantile."""
    value = exact_quantile(df, col, p, **kw)
    return df.sparkSession.createDataFrame([(float(p), value)], "p double, value double")
