"""The whole recommendation job: pairs -> fit -> score grid -> threshold -> flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from latentrec.operators.pruning import cells_between, components_between
from latentrec.operators.quantile import Summary, summarize
from latentrec.operators.scoring import flag, score_components, score_pairs
from latentrec.plans.layout import DEFAULT_BROADCAST_LIMIT
from latentrec.plans.model import PlsiModel, fit

# The settings the recommendation script ships with
# (10 classes, 20 iterations, flag at the 0.9 quantile of the scores).
DEFAULT_CLASSES = 10
DEFAULT_ITERATIONS = 20
DEFAULT_QUANTILE = 0.9


@dataclass
class Recommendation:
    model: PlsiModel
    threshold: float
    predictions: DataFrame  # user_id, item_id, [z,] score, recommended


def score_summary(
    model: PlsiModel,
    ps: list[float] | tuple[float, ...] = (DEFAULT_QUANTILE,),
    bins: int | None = None,
    per_class: bool = False,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> Summary:
    """Exact quantiles and a histogram of the scores of the whole grid, in two passes over it at most.

    The second pass expands only the item blocks that can hold the scores it looks for.
    """
    scores = score_components(model, broadcast_limit) if per_class else score_pairs(model, broadcast_limit)
    between = components_between if per_class else cells_between
    return summarize(scores, "score", ps, bins, within=lambda intervals: between(model, intervals, broadcast_limit))


def predict(
    model: PlsiModel,
    threshold: float | None = None,
    quantile: float = DEFAULT_QUANTILE,
    per_class: bool = False,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    flagged_only: bool = False,
) -> tuple[float, DataFrame]:
    """Score the grid and flag ``score >= threshold``.

    ``per_class=False`` scores pairs by p(s|u) = sum_z p(z|u) p(s|z);
    ``per_class=True`` keeps one row per class with p(z|u) p(s|z).
    Without a fixed ``threshold`` the exact ``quantile`` of the scores is used.
    ``flagged_only=True`` gives the flagged rows alone, and does not expand the
    item blocks that can hold none (``pruning``).
    """
    if threshold is None:
        threshold = score_summary(model, [quantile], per_class=per_class, broadcast_limit=broadcast_limit).quantiles[quantile]
    if flagged_only:
        between = components_between if per_class else cells_between
        return threshold, flag(between(model, [(threshold, None)], broadcast_limit), threshold)
    scores = score_components(model, broadcast_limit) if per_class else score_pairs(model, broadcast_limit)
    return threshold, flag(scores, threshold)


def recommend(
    pairs: DataFrame,
    k: int = DEFAULT_CLASSES,
    n_iter: int = DEFAULT_ITERATIONS,
    threshold: float | None = None,
    quantile: float = DEFAULT_QUANTILE,
    per_class: bool = False,
    init: str = "hashed",
    seed: int = 0,
    tol: float | None = None,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    flagged_only: bool = False,
) -> Recommendation:
    model = fit(pairs, k, n_iter, tol=tol, init=init, seed=seed, broadcast_limit=broadcast_limit)
    t, predictions = predict(model, threshold, quantile, per_class, broadcast_limit, flagged_only)
    return Recommendation(model=model, threshold=t, predictions=predictions)
