"""Registered queries (Spark) and their plain-SQL twins (DuckDB dialect).

Every query reads the test tables under ``sf_dir`` in full. Doubles are
rounded on both sides so that sums taken in a different order by the two
engines compare equal: 9 decimals for probabilities, 6 for sums of
magnitude 10^3 and above, 12 for values far below 10^-3.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentrec import oracle
from latentrec.functions.columns import ITEM, USER, class_cols, long_form
from latentrec.operators.em import Q
from latentrec.operators.init import with_start_posterior
from latentrec.operators.pruning import cells_between, components_between
from latentrec.operators.quantile import quantile_table, summarize
from latentrec.operators.scoring import (
    candidate_grid,
    histogram,
    item_list,
    joint_probability,
    score_components,
    score_known_pairs,
    score_pairs,
    user_list,
)
from latentrec.plans.model import fit, sweep
from latentrec.plans.recommend import predict, recommend, score_summary
from latentrec.session import checkpoint_dir
from latentrec.sources.interactions import (
    accounted_pairs,
    customer_brand_pairs,
    customer_part_pairs,
    dropped_rows,
    events_pairs,
    preview,
    read_interactions,
    read_table,
    shape,
    to_pairs,
)
from latentrec.sources.sinks import write_predictions

# Fixed parameters of the registered queries.
K = 3
ITER_SCORING = 5
TOL_ITERATIONS = 10
TOL = 5e-5
SWEEP_KS = [2, 3, 4]
SWEEP_ITERATIONS = 3
HIST_BINS = 30
QUANTILE = 0.9
FIXED_THRESHOLD = 0.01
RECOMMEND_K = 10
RECOMMEND_ITERATIONS = 20


def ready(spark: SparkSession) -> SparkSession:
    """Make sure the session has its shared folder (see ``checkpoint_dir``)."""
    checkpoint_dir(spark)
    return spark


def _r(c: str, d: int = 9):
    return F.round(F.col(c), d).alias(c)


# ---------------------------------------------------------------- Spark side
def _pairs(spark, sf):
    return events_pairs(ready(spark), sf)


def _model(spark, sf, n_iter, k=K):
    return fit(_pairs(spark, sf), k, n_iter, init="weighted")


def q_interactions_distinct(spark, sf):
    return _pairs(spark, sf)


def q_interaction_shape(spark, sf):
    return shape(_pairs(spark, sf))


def q_interaction_preview(spark, sf):
    return preview(_pairs(spark, sf), 10)


def q_init_posterior(spark, sf):
    wide = with_start_posterior(_pairs(spark, sf), K, "weighted")
    return long_form(wide, [USER, ITEM], class_cols(Q, K), "q").select(USER, ITEM, "z", _r("q"))


def q_item_class_mass(spark, sf):
    return _model(spark, sf, 1).item_class_mass().select(ITEM, "z", _r("n"))


def q_class_mass(spark, sf):
    return _model(spark, sf, 1).class_mass_table().select("z", _r("n", 6))


def q_user_class_mass(spark, sf):
    return _model(spark, sf, 1).user_class_mass().select(USER, "z", _r("n"))


def q_user_mass(spark, sf):
    return _model(spark, sf, 1).user_mass().select(USER, _r("n"))


def q_p_item_given_class(spark, sf):
    return _model(spark, sf, 1).p_item_given_class().select(ITEM, "z", _r("p"))


def q_p_class_given_user(spark, sf):
    return _model(spark, sf, 1).p_class_given_user().select(USER, "z", _r("p"))


def q_pair_products(spark, sf):
    return _model(spark, sf, 1).pair_products().select(USER, ITEM, "z", _r("pzu"), _r("psz"), _r("product"))


def q_pair_likelihood(spark, sf):
    return _model(spark, sf, 1).pair_likelihood().select(USER, ITEM, _r("psu"))


def q_posterior_1iter(spark, sf):
    return _model(spark, sf, 1).posterior().select(USER, ITEM, "z", _r("q"))


def q_posterior_3iter(spark, sf):
    return _model(spark, sf, 3).posterior().select(USER, ITEM, "z", _r("q"))


def _history(df):
    return df.select("k", "iteration", _r("mean_log_likelihood"), _r("total_log_likelihood", 6), "n_pairs")


def q_loglik_total(spark, sf):
    h = _model(spark, sf, 1).history()
    return h.select(F.round("total_log_likelihood", 6).alias("total_log_likelihood"))


def q_loglik_mean(spark, sf):
    h = _model(spark, sf, 1).history()
    return h.select(F.round("mean_log_likelihood", 9).alias("mean_log_likelihood"))


def q_log_loss(spark, sf):
    h = _model(spark, sf, 1).history()
    return h.select(F.round(-F.col("mean_log_likelihood"), 9).alias("log_loss"))


def q_loglik_history(spark, sf):
    return _history(_model(spark, sf, 3).history())


def q_fit_params_3iter(spark, sf):
    m = _model(spark, sf, 3)
    users = m.p_class_given_user().select(F.lit("user").alias("side"), F.col(USER).alias("key"), "z", _r("p"))
    items = m.p_item_given_class().select(F.lit("item").alias("side"), F.col(ITEM).alias("key"), "z", _r("p"))
    return users.unionByName(items)


def q_fit_tol(spark, sf):
    m = fit(_pairs(spark, sf), K, TOL_ITERATIONS, tol=TOL, init="weighted")
    return _history(m.history())


def q_k_sweep(spark, sf):
    return _history(sweep(_pairs(spark, sf), SWEEP_KS, SWEEP_ITERATIONS, init="weighted"))


def q_k_sweep_tol(spark, sf):
    """Curves that end where they stop gaining, each K on its own."""
    return _history(sweep(_pairs(spark, sf), SWEEP_KS, TOL_ITERATIONS, init="weighted", tol=TOL))


def q_candidate_grid(spark, sf):
    return candidate_grid(_pairs(spark, sf))


def q_score_components(spark, sf):
    return score_components(_model(spark, sf, ITER_SCORING)).select(USER, ITEM, "z", _r("score"))


def q_score_pairs(spark, sf):
    return score_pairs(_model(spark, sf, ITER_SCORING)).select(USER, ITEM, _r("score"))


def q_joint_prob(spark, sf):
    return joint_probability(_model(spark, sf, ITER_SCORING)).select(USER, ITEM, _r("p_joint", 12))


def q_score_histogram(spark, sf):
    scores = score_pairs(_model(spark, sf, ITER_SCORING)).select(F.round("score", 12).alias("score"))
    return histogram(scores, "score", HIST_BINS).select("bin", _r("bin_lo", 12), _r("bin_hi", 12), "n")


def q_score_quantile(spark, sf):
    scores = score_pairs(_model(spark, sf, ITER_SCORING))
    return quantile_table(scores, "score", QUANTILE).select("p", _r("value", 12))


def _predictions(threshold, df, with_z=False):
    """Score and threshold are compared as rounded, so that ties at the threshold agree between engines."""
    keys = [USER, ITEM] + (["z"] if with_z else [])
    flagged = F.round("score", 9) >= F.round(F.lit(float(threshold)), 9)
    return df.select(*keys, _r("score"), flagged.alias("recommended"))


def q_predict_fixed(spark, sf):
    return _predictions(*predict(_model(spark, sf, ITER_SCORING), threshold=FIXED_THRESHOLD))


def q_predict_quantile(spark, sf):
    return _predictions(*predict(_model(spark, sf, ITER_SCORING), quantile=QUANTILE))


def q_predict_per_class(spark, sf):
    return _predictions(*predict(_model(spark, sf, ITER_SCORING), quantile=QUANTILE, per_class=True), with_z=True)


def q_recommend(spark, sf):
    rec = recommend(_pairs(spark, sf), RECOMMEND_K, RECOMMEND_ITERATIONS, quantile=QUANTILE, init="weighted")
    return rec.predictions.select(USER, ITEM, _r("score", 12), "recommended")


def _flagged(model, threshold=None, per_class=False):
    """Flagged rows alone, by bound; down to what rounds to the threshold, as in ``_predictions``."""
    if threshold is None:
        threshold = score_summary(model, [QUANTILE], per_class=per_class).quantiles[QUANTILE]
    between = components_between if per_class else cells_between
    rows = between(model, [(threshold - 1e-9, None)])
    return _predictions(threshold, rows, with_z=per_class).where("recommended").drop("recommended")


def q_flagged_fixed(spark, sf):
    return _flagged(_model(spark, sf, ITER_SCORING), FIXED_THRESHOLD)


def q_flagged_quantile(spark, sf):
    return _flagged(_model(spark, sf, ITER_SCORING))


def q_flagged_per_class(spark, sf):
    return _flagged(_model(spark, sf, ITER_SCORING), per_class=True)


def q_recommend_flagged(spark, sf):
    pairs = _pairs(spark, sf)
    rec = recommend(pairs, RECOMMEND_K, RECOMMEND_ITERATIONS, quantile=QUANTILE, init="weighted", flagged_only=True)
    return rec.predictions.select(USER, ITEM, _r("score", 12))


def q_score_summary(spark, sf):
    """Histogram and quantile of the scores from shared scans."""
    scores = score_pairs(_model(spark, sf, ITER_SCORING)).select(F.round("score", 12).alias("score"))
    s = summarize(scores, "score", [QUANTILE], HIST_BINS)
    value = F.round(F.lit(s.quantiles[QUANTILE]), 9).alias("quantile")  # it lies between two of 12 decimals
    return s.histogram.select("bin", _r("bin_lo", 12), _r("bin_hi", 12), "n", value)


def q_loglik_history_blocks(spark, sf):
    """As ``loglik_history``, with neither side broadcast: pairs in two-dimensional blocks."""
    m = fit(_pairs(spark, sf), K, 3, init="weighted", broadcast_limit=0)
    rows = _history(m.history())
    m.close()
    return rows


def q_brand_p_item_given_class(spark, sf):
    m = fit(customer_brand_pairs(ready(spark), sf), K, 2, init="weighted")
    return m.p_item_given_class().select(ITEM, "z", _r("p"))


def q_customer_part_loglik_history(spark, sf):
    m = fit(customer_part_pairs(ready(spark), sf), K, 2, init="weighted")
    return _history(m.history())


def q_fit_hashed_seed(spark, sf):
    m = fit(_pairs(spark, sf), K, ITER_SCORING, init="hashed", seed=7)
    return _history(m.history())


def _shared(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/latentrec-{name}-{uuid.uuid4().hex}"


def _events_csv(spark, sf, blanks=False, invalid=False):
    """All events as CSV rows ``kind, props_k, uid``; some lack the number, or hold none, if asked for."""
    path = _shared(ready(spark), "csv")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    item = F.regexp_extract(F.col("props"), "[0-9]+", 0).try_cast("bigint").cast("string")
    if blanks:
        item = F.when(F.col("user_id") % 7 == 0, F.lit(None)).otherwise(item)
    if invalid:
        item = F.when(F.col("user_id") % 11 == 0, F.concat(F.lit("x"), item)).otherwise(item)
    ev.select(F.lit("event").alias("kind"), item.alias("props_k"), F.col("user_id").alias("uid")).write.option(
        "header", True
    ).csv(path)
    return read_interactions(spark, path)


def q_csv_round_trip(spark, sf):
    return to_pairs(_events_csv(spark, sf), "uid", "props_k", "bigint")


def q_csv_account(spark, sf):
    """Rows kept and dropped by cause, counted by the scan that a fit reads its pairs with."""
    pairs, account = accounted_pairs(_events_csv(spark, sf, blanks=True, invalid=True), "uid", "props_k", "bigint")
    fit(pairs, K, 1).close()
    return account.table()


def q_csv_dropped_rows(spark, sf):
    return dropped_rows(_events_csv(spark, sf, blanks=True), "uid", "props_k", "bigint")


def q_dimension_table(spark, sf):
    """A dimension table written as CSV and read back with its types."""
    path = _shared(ready(spark), "dimension")
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    part.write.option("header", True).csv(path)
    return read_table(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_brand")


def q_predictions_round_trip(spark, sf):
    path = _shared(ready(spark), "predictions")
    write_predictions(q_predict_fixed(spark, sf), path)
    return spark.read.parquet(path)


def q_user_list(spark, sf):
    return user_list(_pairs(spark, sf))


def q_item_list(spark, sf):
    return item_list(_pairs(spark, sf))


def q_score_known_pairs(spark, sf):
    m = _model(spark, sf, ITER_SCORING)
    return score_known_pairs(m, _pairs(spark, sf)).select(USER, ITEM, _r("score"))


def q_zero_mass_class(spark, sf):
    """Two classes, all mass in the first: the other stays empty, the likelihood finite."""
    pairs = _pairs(spark, sf)
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("z")
    q0 = pairs.select(USER, ITEM, both).select(USER, ITEM, "z", (1.0 - F.col("z")).cast("double").alias("q"))
    return _history(fit(pairs, 2, 2, q0=q0).history())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interactions_distinct": q_interactions_distinct,
    "interaction_shape": q_interaction_shape,
    "interaction_preview": q_interaction_preview,
    "init_posterior": q_init_posterior,
    "item_class_mass": q_item_class_mass,
    "class_mass": q_class_mass,
    "user_class_mass": q_user_class_mass,
    "user_mass": q_user_mass,
    "p_item_given_class": q_p_item_given_class,
    "p_class_given_user": q_p_class_given_user,
    "pair_products": q_pair_products,
    "pair_likelihood": q_pair_likelihood,
    "posterior_1iter": q_posterior_1iter,
    "posterior_3iter": q_posterior_3iter,
    "loglik_total": q_loglik_total,
    "loglik_mean": q_loglik_mean,
    "log_loss": q_log_loss,
    "loglik_history": q_loglik_history,
    "fit_params_3iter": q_fit_params_3iter,
    "fit_tol": q_fit_tol,
    "k_sweep": q_k_sweep,
    "k_sweep_tol": q_k_sweep_tol,
    "candidate_grid": q_candidate_grid,
    "score_components": q_score_components,
    "score_pairs": q_score_pairs,
    "joint_prob": q_joint_prob,
    "score_histogram": q_score_histogram,
    "score_quantile": q_score_quantile,
    "predict_fixed": q_predict_fixed,
    "predict_quantile": q_predict_quantile,
    "predict_per_class": q_predict_per_class,
    "recommend": q_recommend,
    "flagged_fixed": q_flagged_fixed,
    "flagged_quantile": q_flagged_quantile,
    "flagged_per_class": q_flagged_per_class,
    "recommend_flagged": q_recommend_flagged,
    "score_summary": q_score_summary,
    "loglik_history_blocks": q_loglik_history_blocks,
    "brand_p_item_given_class": q_brand_p_item_given_class,
    "customer_part_loglik_history": q_customer_part_loglik_history,
    "fit_hashed_seed": q_fit_hashed_seed,
    "csv_round_trip": q_csv_round_trip,
    "csv_account": q_csv_account,
    "csv_dropped_rows": q_csv_dropped_rows,
    "dimension_table": q_dimension_table,
    "predictions_round_trip": q_predictions_round_trip,
    "user_list": q_user_list,
    "item_list": q_item_list,
    "score_known_pairs": q_score_known_pairs,
    "zero_mass_class": q_zero_mass_class,
}


# ------------------------------------------------------------------ SQL side
def _sql(n_iter: int, body: str, k: int = K, extra: list[str] | None = None, source: str = "events", ranked=False, seed=None) -> str:
    return oracle.with_ctes(oracle.em_ctes(source, k, n_iter, ranked, seed=seed) + (extra or []), body)


def _hist_body(tag=""):
    return (
        f"SELECT k, iteration, round(mean_log_likelihood, 9) AS mean_log_likelihood, "
        f"round(total_log_likelihood, 6) AS total_log_likelihood, n_pairs FROM {tag}hist"
    )


def _scoring(body: str, extra: list[str] | None = None, k: int = K, n_iter: int = ITER_SCORING) -> str:
    ctes = oracle.params_ctes(n_iter) + oracle.grid_ctes() + [oracle.scores_cte()]
    return _sql(n_iter, body, k, ctes + (extra or []))


def _sweep_sql() -> str:
    ctes, bodies = [], []
    for k in SWEEP_KS:
        tag = f"k{k}_"
        ctes += oracle.em_ctes("events", k, SWEEP_ITERATIONS, tag=tag) + [oracle.history_cte(k, SWEEP_ITERATIONS, tag)]
        bodies.append(_hist_body(tag))
    return oracle.with_ctes(ctes, " UNION ALL ".join(bodies))


def _stop_ctes(k: int, tag: str = "") -> list[str]:
    gains = (
        f"{tag}gains AS (SELECT iteration, mean_log_likelihood - lag(mean_log_likelihood) "
        f"OVER (ORDER BY iteration) AS gain FROM {tag}hist)"
    )
    stop = (
        f"{tag}stop AS (SELECT coalesce(min(iteration), {TOL_ITERATIONS}) AS last FROM {tag}gains "
        f"WHERE iteration >= 2 AND gain <= {TOL!r})"
    )
    return [oracle.history_cte(k, TOL_ITERATIONS, tag), gains, stop]


def _tol_sql() -> str:
    body = _hist_body() + " WHERE iteration <= (SELECT last FROM stop)"
    return _sql(TOL_ITERATIONS, body, extra=_stop_ctes(K))


def _sweep_tol_sql() -> str:
    ctes, bodies = [], []
    for k in SWEEP_KS:
        tag = f"k{k}_"
        ctes += oracle.em_ctes("events", k, TOL_ITERATIONS, tag=tag) + _stop_ctes(k, tag)
        bodies.append(_hist_body(tag) + f" WHERE iteration <= (SELECT last FROM {tag}stop)")
    return oracle.with_ctes(ctes, " UNION ALL ".join(bodies))


_HISTOGRAM_CTES = [
    "rs AS (SELECT round(score, 12) AS score FROM scores)",
    "rng AS (SELECT min(score) AS lo, max(score) AS hi FROM rs)",
    "cnt AS (SELECT least(CAST(floor((score - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n "
    "FROM rs CROSS JOIN rng GROUP BY 1)",
]
_COMPONENTS_CTE = (
    "comp AS (SELECT g.user_id, g.item_id, u.z, u.pzu * i.psz AS score FROM grid g "
    "JOIN pzu u ON g.user_id = u.user_id JOIN psz i ON g.item_id = i.item_id AND u.z = i.z)"
)

_GRID_SCORES = "SELECT user_id, item_id, round(score, 9) AS score"

ORACLE_SQL: dict[str, str] = {
    "interactions_distinct": oracle.PAIRS_SQL["events"],
    "interaction_shape": (
        f"WITH pairs AS ({oracle.PAIRS_SQL['events']}) SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_columns, "
        "count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM pairs"
    ),
    "interaction_preview": (
        f"WITH pairs AS ({oracle.PAIRS_SQL['events']}) SELECT user_id, item_id FROM pairs ORDER BY user_id, item_id LIMIT 10"
    ),
    "init_posterior": _sql(0, "SELECT user_id, item_id, z, round(q, 9) AS q FROM q0"),
    "item_class_mass": _sql(1, "SELECT DISTINCT item_id, z, round(n_iz, 9) AS n FROM m1"),
    "class_mass": _sql(1, "SELECT DISTINCT z, round(n_z, 6) AS n FROM m1"),
    "user_class_mass": _sql(1, "SELECT DISTINCT user_id, z, round(n_uz, 9) AS n FROM m1"),
    "user_mass": _sql(1, "SELECT DISTINCT user_id, round(n_u, 9) AS n FROM m1"),
    "p_item_given_class": _sql(1, "SELECT DISTINCT item_id, z, round(psz, 9) AS p FROM e1"),
    "p_class_given_user": _sql(1, "SELECT DISTINCT user_id, z, round(pzu, 9) AS p FROM e1"),
    "pair_products": _sql(
        1, "SELECT user_id, item_id, z, round(pzu, 9) AS pzu, round(psz, 9) AS psz, round(pp, 9) AS product FROM e1"
    ),
    "pair_likelihood": _sql(1, "SELECT user_id, item_id, round(psu, 9) AS psu FROM q1 WHERE z = 0"),
    "posterior_1iter": _sql(1, "SELECT user_id, item_id, z, round(q, 9) AS q FROM q1"),
    "posterior_3iter": _sql(3, "SELECT user_id, item_id, z, round(q, 9) AS q FROM q3"),
    "loglik_total": _sql(
        1, "SELECT round(total_log_likelihood, 6) AS total_log_likelihood FROM hist", extra=[oracle.history_cte(K, 1)]
    ),
    "loglik_mean": _sql(
        1, "SELECT round(mean_log_likelihood, 9) AS mean_log_likelihood FROM hist", extra=[oracle.history_cte(K, 1)]
    ),
    "log_loss": _sql(1, "SELECT round(-mean_log_likelihood, 9) AS log_loss FROM hist", extra=[oracle.history_cte(K, 1)]),
    "loglik_history": _sql(3, _hist_body(), extra=[oracle.history_cte(K, 3)]),
    "fit_params_3iter": _sql(
        3,
        "SELECT DISTINCT 'user' AS side, user_id AS key, z, round(pzu, 9) AS p FROM e3 "
        "UNION ALL SELECT DISTINCT 'item' AS side, item_id AS key, z, round(psz, 9) AS p FROM e3",
    ),
    "fit_tol": _tol_sql(),
    "k_sweep": _sweep_sql(),
    "k_sweep_tol": _sweep_tol_sql(),
    "candidate_grid": oracle.with_ctes(
        [f"pairs AS ({oracle.PAIRS_SQL['events']})"] + oracle.grid_ctes(), "SELECT user_id, item_id FROM grid"
    ),
    "score_components": _scoring(
        "SELECT g.user_id, g.item_id, u.z, round(u.pzu * i.psz, 9) AS score FROM grid g "
        "JOIN pzu u ON g.user_id = u.user_id JOIN psz i ON g.item_id = i.item_id AND u.z = i.z"
    ),
    "score_pairs": _scoring(f"{_GRID_SCORES} FROM scores"),
    "joint_prob": _scoring(
        "SELECT g.user_id, g.item_id, round(sum(u.n_uz * i.psz) / (SELECT sum(n_z) FROM (SELECT DISTINCT z, n_z FROM m"
        f"{ITER_SCORING})), 12) AS p_joint FROM grid g "
        f"JOIN (SELECT DISTINCT user_id, z, n_uz FROM m{ITER_SCORING}) u ON g.user_id = u.user_id "
        "JOIN psz i ON g.item_id = i.item_id AND u.z = i.z GROUP BY g.user_id, g.item_id"
    ),
    "score_histogram": _scoring(
        "SELECT b.bin, round(r.lo + b.bin * ((r.hi - r.lo) / 30), 12) AS bin_lo, "
        "round(r.lo + (b.bin + 1) * ((r.hi - r.lo) / 30), 12) AS bin_hi, coalesce(c.n, 0) AS n "
        "FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(30)) b CROSS JOIN rng r "
        "LEFT JOIN cnt c ON c.bin = b.bin",
        extra=[
            "rs AS (SELECT round(score, 12) AS score FROM scores)",
            "rng AS (SELECT min(score) AS lo, max(score) AS hi FROM rs)",
            "cnt AS (SELECT least(CAST(floor((score - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS n "
            "FROM rs CROSS JOIN rng GROUP BY 1)",
        ],
    ),
    "score_quantile": _scoring(
        f"SELECT CAST({QUANTILE} AS DOUBLE) AS p, round(quantile_cont(score, {QUANTILE}), 12) AS value FROM scores"
    ),
    "predict_fixed": _scoring(f"{_GRID_SCORES}, round(score, 9) >= {FIXED_THRESHOLD} AS recommended FROM scores"),
    "predict_quantile": _scoring(
        f"{_GRID_SCORES}, round(score, 9) >= (SELECT round(quantile_cont(score, {QUANTILE}), 9) FROM scores) "
        "AS recommended FROM scores"
    ),
    "predict_per_class": _scoring(
        "SELECT user_id, item_id, z, round(score, 9) AS score, "
        f"round(score, 9) >= (SELECT round(quantile_cont(score, {QUANTILE}), 9) FROM comp) AS recommended FROM comp",
        extra=[
            "comp AS (SELECT g.user_id, g.item_id, u.z, u.pzu * i.psz AS score FROM grid g "
            "JOIN pzu u ON g.user_id = u.user_id JOIN psz i ON g.item_id = i.item_id AND u.z = i.z)"
        ],
    ),
    "recommend": _scoring(
        "SELECT user_id, item_id, round(score, 12) AS score, "
        f"score >= (SELECT quantile_cont(score, {QUANTILE}) FROM scores) AS recommended FROM scores",
        k=RECOMMEND_K,
        n_iter=RECOMMEND_ITERATIONS,
    ),
    "brand_p_item_given_class": _sql(
        2, "SELECT DISTINCT item_id, z, round(psz, 9) AS p FROM e2", source="customer_brand", ranked=True
    ),
    "customer_part_loglik_history": _sql(
        2, _hist_body(), extra=[oracle.history_cte(K, 2)], source="customer_part"
    ),
    "fit_hashed_seed": _sql(ITER_SCORING, _hist_body(), extra=[oracle.history_cte(K, ITER_SCORING)], seed=7),
    "csv_round_trip": oracle.PAIRS_SQL["events"],
    "csv_account": (
        "WITH c AS (SELECT CASE WHEN user_id IS NULL THEN 'no_user' "
        f"WHEN user_id % 7 = 0 OR {oracle._ITEM_K} IS NULL THEN 'no_item' "
        "WHEN user_id % 11 = 0 THEN 'bad_item' END AS cause FROM events) "
        "SELECT count(*) AS n_rows, count(*) FILTER (cause IS NULL) AS n_kept, count(*) FILTER (cause = 'no_user') AS no_user, "
        "count(*) FILTER (cause = 'no_item') AS no_item, CAST(0 AS BIGINT) AS bad_user, "
        "count(*) FILTER (cause = 'bad_item') AS bad_item FROM c"
    ),
    "csv_dropped_rows": (
        "SELECT count(*) AS n_rows, count(*) FILTER (user_id IS NULL OR user_id % 7 = 0 OR "
        f"{oracle._ITEM_K} IS NULL) AS n_dropped FROM events"
    ),
    "dimension_table": "SELECT p_partkey, p_brand FROM part",
    "user_list": f"SELECT DISTINCT user_id FROM ({oracle.PAIRS_SQL['events']})",
    "item_list": f"SELECT DISTINCT item_id FROM ({oracle.PAIRS_SQL['events']})",
    "score_known_pairs": _sql(
        ITER_SCORING, f"SELECT user_id, item_id, round(sum(pp), 9) AS score FROM e{ITER_SCORING} GROUP BY user_id, item_id"
    ),
    # with one class p(s|u) is the item's share of all pairs, in every iteration
    "zero_mass_class": (
        f"WITH pairs AS ({oracle.PAIRS_SQL['events']}), shares AS (SELECT count(*) OVER (PARTITION BY item_id) * 1.0 "
        "/ count(*) OVER () AS p FROM pairs) SELECT CAST(2 AS BIGINT) AS k, CAST(t.range AS BIGINT) AS iteration, "
        "round(avg(ln(p)), 9) AS mean_log_likelihood, round(sum(ln(p)), 6) AS total_log_likelihood, "
        "count(*) AS n_pairs FROM shares CROSS JOIN range(1, 3) t GROUP BY t.range"
    ),
}
ORACLE_SQL["loglik_history_blocks"] = ORACLE_SQL["loglik_history"]
ORACLE_SQL |= {
    "flagged_fixed": _scoring(f"{_GRID_SCORES} FROM scores WHERE round(score, 9) >= {FIXED_THRESHOLD}"),
    "flagged_quantile": _scoring(
        f"{_GRID_SCORES} FROM scores WHERE round(score, 9) >= (SELECT round(quantile_cont(score, {QUANTILE}), 9) FROM scores)"
    ),
    "flagged_per_class": _scoring(
        "SELECT user_id, item_id, z, round(score, 9) AS score FROM comp "
        f"WHERE round(score, 9) >= (SELECT round(quantile_cont(score, {QUANTILE}), 9) FROM comp)",
        extra=[_COMPONENTS_CTE],
    ),
    "recommend_flagged": _scoring(
        "SELECT user_id, item_id, round(score, 12) AS score FROM scores "
        f"WHERE score >= (SELECT quantile_cont(score, {QUANTILE}) FROM scores)",
        k=RECOMMEND_K,
        n_iter=RECOMMEND_ITERATIONS,
    ),
    "score_summary": _scoring(
        "SELECT b.bin, round(r.lo + b.bin * ((r.hi - r.lo) / 30), 12) AS bin_lo, "
        "round(r.lo + (b.bin + 1) * ((r.hi - r.lo) / 30), 12) AS bin_hi, coalesce(c.n, 0) AS n, "
        f"(SELECT round(quantile_cont(score, {QUANTILE}), 9) FROM rs) AS quantile "
        "FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(30)) b CROSS JOIN rng r "
        "LEFT JOIN cnt c ON c.bin = b.bin",
        extra=_HISTOGRAM_CTES,
    ),
}
ORACLE_SQL["predictions_round_trip"] = ORACLE_SQL["predict_fixed"]
