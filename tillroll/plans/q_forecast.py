"""Registered queries: grouped seasonal forecasting (TS6, TS7, TS10, AGG17,
model hold-out accuracy) over the weekly series per country plus the total.

The oracle repeats the start values, the Gauss-Newton steps and the recursion of the
forecast in SQL; amounts are compared to the cent, because sums that are multiplied in
double differ in their last bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import forecast
from tillroll.plans.catalog import date_text, register
from tillroll.plans.q_timeseries import series_oracle, weekly_by_country
from tillroll.plans.sql_logistic import eliminated
from tillroll.sources.tables import materialized


_ZEROS = {n: "[" + ", ".join(["0.0::DOUBLE"] * n) + "]" for n in (4, 5, 6, 15)}
_PAIRS = [(i, j) for i in range(1, 5) for j in range(1, i + 1)]


def _least_squares(name: str, y: str, xs: list[str], rows: str) -> str:
    """CTE ``name`` (series_key, b): least squares of ``y`` on ``xs`` over ``rows``."""
    n, row = len(xs), [*xs, y]
    sums = "[" + ", ".join("[" + ", ".join(f"sum({row[i]} * {row[j]})" for j in range(n + 1)) + "]" for i in range(n)) + "]"
    found = eliminated(f"SELECT series_key, {sums} AS m FROM {rows} GROUP BY series_key", n, "series_key")
    return f"{name} AS MATERIALIZED (SELECT series_key, list_transform(m, lambda r: r[{n + 1}]) AS b FROM ({found}))"


def _sums(passes: str, b: str) -> str:
    """Errors and their derivatives along the list ``passes`` of a series at ``b``: the list of
    fifteen sums, then the last errors, newest first."""
    s = forecast.SEASON

    def shocks(x):
        return f"{b}[3] * {x(1)} + {b}[4] * {x(s)} + {b}[3] * {b}[4] * {x(s + 1)}"

    e = f"x.d0 - {b}[1] * x.d1 - {b}[2] * x.ds + {b}[1] * {b}[2] * x.dp - ({shocks(lambda k: f'a.e[{k}]')})"
    own = [f"{b}[2] * x.dp - x.d1", f"{b}[1] * x.dp - x.ds", f"0.0 - a.e[1] - {b}[4] * a.e[{s + 1}]",
           f"0.0 - a.e[{s}] - {b}[3] * a.e[{s + 1}]"]
    slope = ", ".join(f"{own[i]} - ({shocks(lambda k, i=i: f'a.g[{k}][{i + 1}]')})" for i in range(4))
    terms = ["a.e[1] * a.e[1]", *[f"a.g[1][{i}] * a.e[1]" for i in range(1, 5)],
             *[f"a.g[1][{i}] * a.g[1][{j}]" for i, j in _PAIRS]]
    added = ", ".join(f"a.s[{k}] + {t}" for k, t in enumerate(terms, 1))
    last = (f"list_reduce({passes}, lambda a, x: {{'d0': x.d0, 'd1': x.d1, 'ds': x.ds, 'dp': x.dp, "
            f"'e': [{e}] || a.e[1:{s + 1}], 'g': [[{slope}]] || a.g[1:{s}], 's': [{added}]}})")
    return f"(SELECT z.s || z.e[2:{s + 2}] FROM (SELECT {last} AS z))"


def _forecast_cte(steps: int, skip: int) -> str:
    """``fc``: (series_key, w, f, half) for the series without the last ``skip`` points."""
    s = forecast.SEASON
    ys, ds, es = ([f"{c}{k}" for k in range(s + 1)] for c in "yde")
    lags = [f"ld{k}" for k in range(1, s + 2)]
    place = {pair: 6 + k for k, pair in enumerate(_PAIRS)}
    matrix = "[" + ", ".join("[" + ", ".join(f"ev[{place[max(i, j), min(i, j)]}]" for j in range(1, 5))
                             + f", ev[{1 + i}]]" for i in range(1, 5)) + "]"
    rounds = []
    for k in range(forecast.STEPS):
        found = eliminated(f"SELECT *, {matrix} AS m FROM gn{k}", 4, "series_key, p, b, ev, scale")
        rounds += [f"""
try{k} AS MATERIALIZED (
  SELECT series_key, p, b, ev, scale, nb, {_sums('p', 'nb')} AS nev
  FROM (SELECT *, list_transform(b, lambda v, i: v - scale * m[i][5]) AS nb FROM ({found}))
),
gn{k + 1} AS MATERIALIZED (
  SELECT series_key, p, CASE WHEN coalesce(nev[1] < ev[1], false) THEN nb ELSE b END AS b,
         CASE WHEN coalesce(nev[1] < ev[1], false) THEN nev ELSE ev END AS ev,
         CASE WHEN coalesce(nev[1] < ev[1], false) THEN least(1, 2 * scale) ELSE scale / 2 END AS scale FROM try{k}
)"""]
    zero = f"{_ZEROS[6]} AS e, [{', '.join([_ZEROS[4]] * (s + 1))}] AS g, {_ZEROS[15]} AS s"
    least = 4 * forecast.ROWS_EACH
    return f""", cut AS (
  SELECT series_key, t, n - {skip} AS n, CAST(rev * 1000 AS HUGEINT) AS y FROM pos WHERE t < n - {skip}
),
lagged AS (
  SELECT *, y - lag(y) OVER w - lag(y, {s}) OVER w + lag(y, {s + 1}) OVER w AS d FROM cut
  WINDOW w AS (PARTITION BY series_key ORDER BY t)
),
rowed AS (
  SELECT *, {", ".join(f"lag(y, {k}) OVER w AS ly{k}" for k in range(1, s + 1))},
         {", ".join(f"CAST(lag(d, {k}) OVER w AS DOUBLE) AS ld{k}" for k in range(1, s + 2))}, CAST(d AS DOUBLE) AS d0
  FROM lagged WINDOW w AS (PARTITION BY series_key ORDER BY t)
),
whole AS MATERIALIZED (SELECT * FROM rowed WHERE ld{s + 1} IS NOT NULL AND n - {2 * (s + 1)} >= {least}),
{_least_squares("far", "d0", lags, "whole")},
noise AS MATERIALIZED (
  SELECT r.*, CASE WHEN r.ld{s + 1} IS NULL THEN 0 ELSE d0 - ({" + ".join(f"b[{k}] * ld{k}" for k in range(1, s + 2))}) END AS u
  FROM rowed r JOIN far USING (series_key) WHERE d0 IS NOT NULL
),
noises AS MATERIALIZED (
  SELECT *, lag(u) OVER w AS u1, lag(u, {s}) OVER w AS us, row_number() OVER w AS i FROM noise
  WINDOW w AS (PARTITION BY series_key ORDER BY t)
),
{_least_squares("near", "d0", ["ld1", f"ld{s}", "u1", "us"], f"(SELECT * FROM noises WHERE i > {2 * s + 1})")},
passes AS (
  SELECT series_key, -1 AS i, 0.0::DOUBLE AS d0, 0.0::DOUBLE AS d1, 0.0::DOUBLE AS ds, 0.0::DOUBLE AS dp FROM near
  UNION ALL SELECT series_key, t, d0, ld1, ld{s}, ld{s + 1} FROM whole
  UNION ALL SELECT series_key, 1000000, 0, 0, 0, 0 FROM near
),
gn0 AS MATERIALIZED (
  SELECT *, {_sums('p', 'b')} AS ev, 1.0::DOUBLE AS scale FROM (
    SELECT series_key, p, CASE WHEN len(list_filter(b, lambda v: v IS NULL)) > 0 THEN {_ZEROS[4]} ELSE b END AS b
    FROM near JOIN (SELECT series_key, list({{'d0': d0, 'd1': d1, 'ds': ds, 'dp': dp, 'e': e, 'g': g, 's': s}} ORDER BY i) AS p
                    FROM (SELECT *, {zero} FROM passes) GROUP BY series_key) USING (series_key))
),{",".join(rounds)},
{_least_squares("two", "d0", ["ld1", f"ld{s}"], f"(SELECT * FROM rowed WHERE ld{s} IS NOT NULL AND n - {2 * (s + 1)} < {least})")},
rest AS (
  SELECT series_key, any_value(b) AS b, COUNT(*) AS rows, sum((d0 - b[1] * ld1 - b[2] * ld{s}) ** 2) AS sse
  FROM (SELECT series_key, d0, ld1, ld{s}, CASE WHEN b[1] IS NULL OR b[2] IS NULL THEN {_ZEROS[4]} ELSE b || [0.0, 0.0] END AS b
        FROM rowed JOIN two USING (series_key) WHERE ld{s} IS NOT NULL) GROUP BY series_key
),
fit AS (
  SELECT r.*, coalesce(g.b, rest.b, {_ZEROS[4]}) AS b, CASE WHEN g.b IS NULL THEN 0 ELSE 1 END AS product,
         CASE WHEN g.b IS NOT NULL THEN g.ev[1] / (n - {2 * (s + 1)} - 4)
              WHEN rest.rows > 2 THEN rest.sse / (rest.rows - 2) END AS sigma2,
         CASE WHEN g.b IS NULL THEN {_ZEROS[5]} ELSE g.ev[16:] END AS es
  FROM rowed r LEFT JOIN gn{forecast.STEPS} g USING (series_key) LEFT JOIN rest USING (series_key) WHERE t = n - 1
),
steps AS (
  WITH RECURSIVE run AS (
    SELECT series_key, b, product, sigma2, 0 AS w, CAST(y AS DOUBLE) AS y0,
           {", ".join(f"CAST(coalesce(ly{k}, y) AS DOUBLE) AS y{k}" for k in range(1, s + 1))},
           coalesce(d0, 0) AS d0, {", ".join(f"coalesce(ld{k}, 0) AS d{k}" for k in range(1, s + 1))},
           {", ".join(f"es[{k + 1}] AS e{k}" for k in range(s + 1))},
           {", ".join(f"0.0::DOUBLE AS p{c}" for c in [*ys, *ds, *es])}, 0.0::DOUBLE AS spread
    FROM fit
    UNION ALL
    SELECT series_key, b, product, sigma2, w + 1, nd + y0 + y{s - 1} - y{s}, {", ".join(ys[:-1])}, nd,
           {", ".join(ds[:-1])}, 0, {", ".join(es[:-1])}, np, {", ".join(f"p{c}" for c in ys[:-1])}, pd,
           {", ".join(f"p{c}" for c in ds[:-1])}, CASE WHEN w = 0 THEN 1 ELSE 0 END, {", ".join(f"p{c}" for c in es[:-1])},
           spread + np * np
    FROM (SELECT *, pd + py0 + py{s - 1} - py{s} AS np FROM (
            SELECT *, b[1] * d0 + b[2] * d{s - 1} - product * b[1] * b[2] * d{s} + b[3] * e0 + b[4] * e{s - 1} + b[3] * b[4] * e{s} AS nd,
                   b[1] * pd0 + b[2] * pd{s - 1} - product * b[1] * b[2] * pd{s} + CASE WHEN w = 0 THEN 1.0::DOUBLE ELSE 0 END
                   + b[3] * pe0 + b[4] * pe{s - 1} + b[3] * b[4] * pe{s} AS pd FROM run))
    WHERE w < {steps})
  SELECT * FROM run
),
fc AS (
  SELECT series_key, CAST(w AS INTEGER) AS w, y0 / 1000 AS f,
         {forecast.Z!r} * sqrt(sigma2 * spread) / 1000 AS half FROM steps WHERE w > 0
)"""


FORECAST_SQL = _forecast_cte(forecast.HORIZON, 0)


def forecast_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12-week forecast table of every series, fitted once per session."""
    return materialized(spark, "revenue_forecast", sf_dir,
                        lambda: forecast.forecast_table(weekly_by_country(spark, sf_dir)))


def _cents(*cols: str):
    return [F.round(c, 2).alias(c) for c in cols]


@register("ts10_revenue_forecast", series_oracle(f"""{FORECAST_SQL}
SELECT series_key, w AS Week, strftime(last + 7 * w, '%Y-%m-%d') AS Date, round(f, 2) AS Forecast,
       round(f - half, 2) AS Lower_CI, round(f + half, 2) AS Upper_CI
FROM fc JOIN (SELECT series_key, MAX(Date) AS last FROM weekly GROUP BY series_key) USING (series_key)"""))
def q_ts10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = forecast_by_country(spark, sf_dir)
    return t.select("series_key", "Week", date_text("Date"), *_cents("Forecast", "Lower_CI", "Upper_CI"))


@register("ts6_seasonal_coefficients", series_oracle(f"""{FORECAST_SQL}
SELECT series_key, round(b[1], 6) AS phi, round(b[2], 6) AS seasonal_phi, round(b[3], 6) AS theta,
       round(b[4], 6) AS seasonal_theta FROM fit"""))
def q_ts6_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS6: the four coefficients of every series."""
    fit = forecast.fit_series(weekly_by_country(spark, sf_dir))
    return fit.select("series_key", *[F.round(c, 6).alias(c) for c in ("phi", "seasonal_phi", "theta", "seasonal_theta")])


@register("agg17_forecast_summary", series_oracle(f"""{FORECAST_SQL}
SELECT series_key, round(SUM(f), 2) AS total_forecast, round(AVG(f), 2) AS mean_forecast,
       round(MIN(f), 2) AS min_forecast, round(MAX(f), 2) AS max_forecast FROM fc GROUP BY series_key"""))
def q_agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecast_summary(forecast_by_country(spark, sf_dir)).select(
        "series_key", *_cents("total_forecast", "mean_forecast", "min_forecast", "max_forecast"))


@register("ts6_holdout_accuracy", series_oracle(f"""{_forecast_cte(forecast.HOLDOUT, forecast.HOLDOUT)},
held AS (SELECT series_key, t - n + {forecast.HOLDOUT} + 1 AS w, CAST(rev AS DOUBLE) AS actual FROM pos
         WHERE t >= n - {forecast.HOLDOUT})
SELECT series_key, round(AVG(abs(actual - f)), 2) AS mae, round(sqrt(AVG((actual - f) * (actual - f))), 2) AS rmse,
       round(AVG(abs((actual - f) / nullif(actual, 0))) * 100, 4) AS mape, COUNT(f) AS points
FROM held LEFT JOIN fc USING (series_key, w) GROUP BY series_key"""))
def q_ts6(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = forecast.holdout_accuracy(weekly_by_country(spark, sf_dir))
    return acc.select("series_key", *_cents("mae", "rmse"), F.round("mape", 4).alias("mape"), "points")
