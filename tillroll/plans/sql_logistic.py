"""DuckDB text of the logistic regression: every Newton step and every elimination
step of its linear system written out, over the CTE ``split`` of the churn oracle."""

from __future__ import annotations

from tillroll.operators.churn import FEATURE_COLUMNS
from tillroll.operators.logistic import STEPS

_WIDTH = len(FEATURE_COLUMNS)
_N = _WIDTH + 1


def eliminated(matrix: str, n: int, keep: str) -> str:
    """``matrix`` (``keep`` columns and m) with m, rows with their right side last, reduced to
    the identity and the solution beside it."""
    out = matrix
    for k in range(1, n + 1):
        out = (f"SELECT {keep}, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / nullif(r[{k}], 0)) "
               f"ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / nullif(m[{k}][{k}], 0)) END) AS m FROM ({out})")
    return out


def logistic_ctes(steps: int = STEPS, folds: int = 5) -> str:
    """CTEs ``lscale`` (mean and deviation), ``lw`` (fit, w: the coefficients) and ``lscored``
    (fit, id, label, score: every customer by the fit outside which it lies)."""
    moments = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_pop(CAST({c} AS DOUBLE)) AS s{i}"
                        for i, c in enumerate(FEATURE_COLUMNS))
    x = ", ".join(f"(CAST({c} AS DOUBLE) - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END"
                  for i, c in enumerate(FEATURE_COLUMNS))
    fits = ", ".join(f"({f})" for f in range(folds + 1))
    out = [
        f"lscale AS MATERIALIZED (SELECT {moments} FROM split WHERE is_test = 0)",
        f"lx AS MATERIALIZED (SELECT CustomerID AS id, Churned AS y, is_test, fold, [1.0::DOUBLE, {x}] AS x FROM split, lscale)",
        f"ltrain AS MATERIALIZED (SELECT fit, y, x FROM lx, (VALUES {fits}) f(fit) "
        "WHERE is_test = 0 AND (fit = 0 OR fold <> fit - 1))",
        f"lw0 AS MATERIALIZED (SELECT fit, list_transform(range({_N}), lambda i: 0.0::DOUBLE) AS w FROM (VALUES {fits}) f(fit))",
    ]
    for s in range(steps):
        p = f"SELECT t.fit, y, x, w, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM ltrain t JOIN lw{s} USING (fit)"
        cells = (f"SELECT fit, any_value(w) AS w, i, j, CASE WHEN j = {_N + 1} THEN sum(x[i] * (p - y)) "
                 "ELSE sum(x[i] * x[j] * p * (1 - p)) END + CASE WHEN i = 1 THEN 0 WHEN j = i THEN 1 "
                 f"WHEN j = {_N + 1} THEN any_value(w)[i] ELSE 0 END AS v "
                 f"FROM lp{s}, range(1, {_N + 1}) a(i), range(1, {_N + 2}) b(j) GROUP BY fit, i, j")
        rows = f"SELECT fit, any_value(w) AS w, i, list(v ORDER BY j) AS r FROM ({cells}) GROUP BY fit, i"
        matrix = f"SELECT fit, any_value(w) AS w, list(r ORDER BY i) AS m FROM ({rows}) GROUP BY fit"
        out += [f"lp{s} AS MATERIALIZED ({p})",
                f"lw{s + 1} AS MATERIALIZED (SELECT fit, list_transform(w, lambda v, i: v - m[i][{_N + 1}]) AS w "
                f"FROM ({eliminated(matrix, _N, 'fit, w')}))"]
    out += [f"lw AS MATERIALIZED (SELECT * FROM lw{steps})",
            "lscored AS MATERIALIZED (SELECT fit, id, y AS label, 1 / (1 + exp(-list_dot_product(x, w))) AS score "
            "FROM lx JOIN lw ON fit = CASE WHEN is_test = 1 THEN 0 ELSE fold + 1 END)"]
    return ",\n".join(out)
