"""Plain-SQL (DuckDB dialect) text of the same computations, for oracle checks.

EM with the deterministic weighted start is ordinary SQL: each iteration is a
few window sums over the long posterior ``(user_id, item_id, z, q)``. Every
CTE reads only the one before it, so the text grows linearly with the number
of iterations. This module only produces strings; it never runs them.
"""

from __future__ import annotations

from latentrec.operators.init import (
    WEIGHT_CLASS_FACTOR,
    WEIGHT_ITEM_FACTOR,
    WEIGHT_MODULUS,
    WEIGHT_USER_FACTOR,
)

_ITEM_K = "TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

PAIRS_SQL = {
    "events": (
        f"SELECT DISTINCT user_id, {_ITEM_K} AS item_id FROM events "
        f"WHERE user_id IS NOT NULL AND {_ITEM_K} IS NOT NULL"
    ),
    "customer_part": (
        "SELECT DISTINCT o.o_custkey AS user_id, l.l_partkey AS item_id "
        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "WHERE o.o_custkey IS NOT NULL AND l.l_partkey IS NOT NULL"
    ),
    "customer_brand": (
        "SELECT DISTINCT o.o_custkey AS user_id, p.p_brand AS item_id "
        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN part p ON l.l_partkey = p.p_partkey "
        "WHERE o.o_custkey IS NOT NULL AND p.p_brand IS NOT NULL"
    ),
}


def em_ctes(
    source: str, k: int, n_iter: int, ranked: bool = False, tag: str = "", seed: int | None = None
) -> list[str]:
    """CTE list: ``{tag}pairs``, ``{tag}q0`` then per iteration t
    ``{tag}m{t}`` (sums), ``{tag}e{t}`` (parameters, products) and
    ``{tag}q{t}`` (posterior, p(s|u)).
    """
    p = tag
    out = [f"{p}pairs AS ({PAIRS_SQL[source]})"]
    if ranked:
        out.append(
            f"{p}rp AS (SELECT user_id, item_id, dense_rank() OVER (ORDER BY user_id) AS ur, "
            f"dense_rank() OVER (ORDER BY item_id) AS ir FROM {p}pairs)"
        )
    else:
        out.append(f"{p}rp AS (SELECT user_id, item_id, user_id AS ur, item_id AS ir FROM {p}pairs)")
    out.append(f"{p}zs AS (SELECT CAST(range AS BIGINT) AS z FROM range({k}))")
    weight = (
        f"CAST((ur * {WEIGHT_USER_FACTOR} + ir * {WEIGHT_ITEM_FACTOR} "
        f"+ z * {WEIGHT_CLASS_FACTOR}) % {WEIGHT_MODULUS} + 1 AS DOUBLE)"
    )
    if seed is not None:  # the hashed start
        digits = f"substr(md5(concat_ws('|', '{seed}', user_id, item_id, z)), 1, 13)"
        weight = f"CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) / {2**52} + {2.0**-53!r}"
    out.append(f"{p}w0 AS (SELECT user_id, item_id, z, {weight} AS w FROM {p}rp CROSS JOIN {p}zs)")
    out.append(
        f"{p}q0 AS (SELECT user_id, item_id, z, w / sum(w) OVER (PARTITION BY user_id, item_id) AS q FROM {p}w0)"
    )
    for t in range(1, n_iter + 1):
        out.append(
            f"{p}m{t} AS (SELECT user_id, item_id, z, q, "
            f"sum(q) OVER (PARTITION BY item_id, z) AS n_iz, "
            f"sum(q) OVER (PARTITION BY z) AS n_z, "
            f"sum(q) OVER (PARTITION BY user_id, z) AS n_uz, "
            f"sum(q) OVER (PARTITION BY user_id) AS n_u FROM {p}q{t - 1})"
        )
        out.append(
            f"{p}e{t} AS (SELECT user_id, item_id, z, n_uz / n_u AS pzu, n_iz / n_z AS psz, "
            f"(n_uz / n_u) * (n_iz / n_z) AS pp FROM {p}m{t})"
        )
        out.append(
            f"{p}q{t} AS (SELECT user_id, item_id, z, pzu, psz, pp, "
            f"pp / sum(pp) OVER (PARTITION BY user_id, item_id) AS q, "
            f"sum(pp) OVER (PARTITION BY user_id, item_id) AS psu FROM {p}e{t})"
        )
    return out


def history_cte(k: int, n_iter: int, tag: str = "") -> str:
    """``{tag}hist(k, iteration, mean_log_likelihood, total_log_likelihood, n_pairs)``."""
    parts = [
        f"SELECT CAST({k} AS BIGINT) AS k, CAST({t} AS BIGINT) AS iteration, "
        f"avg(ln(psu)) AS mean_log_likelihood, sum(ln(psu)) AS total_log_likelihood, "
        f"count(*) AS n_pairs FROM {tag}q{t} WHERE z = 0"
        for t in range(1, n_iter + 1)
    ]
    return f"{tag}hist AS ({' UNION ALL '.join(parts)})"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def params_ctes(t: int, tag: str = "") -> list[str]:
    """Wide-free parameter tables of iteration t: pzu(user_id, z, pzu), psz(item_id, z, psz)."""
    return [
        f"{tag}pzu AS (SELECT DISTINCT user_id, z, pzu FROM {tag}e{t})",
        f"{tag}psz AS (SELECT DISTINCT item_id, z, psz FROM {tag}e{t})",
    ]


def grid_ctes(tag: str = "") -> list[str]:
    """All (user, item) combinations of the users and items seen in the pairs."""
    return [
        f"{tag}users AS (SELECT DISTINCT user_id FROM {tag}pairs)",
        f"{tag}items AS (SELECT DISTINCT item_id FROM {tag}pairs)",
        f"{tag}grid AS (SELECT user_id, item_id FROM {tag}users CROSS JOIN {tag}items)",
    ]


def scores_cte(tag: str = "") -> str:
    """``scores(user_id, item_id, score)``: p(s|u) over the whole grid."""
    return (
        f"{tag}scores AS (SELECT g.user_id, g.item_id, sum(u.pzu * i.psz) AS score "
        f"FROM {tag}grid g JOIN {tag}pzu u ON g.user_id = u.user_id "
        f"JOIN {tag}psz i ON g.item_id = i.item_id AND u.z = i.z GROUP BY g.user_id, g.item_id)"
    )
