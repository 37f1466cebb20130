"""Grouped seasonal forecasting (TS6, TS7, TS10, AGG17, TS8): the reference's model, one
autoregressive and one moving-average term each for the week and for the season, on the
series differenced by one week and by the season:

    d[t] = phi d[t-1] + Phi d[t-s] - phi Phi d[t-s-1]
           + e[t] + theta e[t-1] + Theta e[t-s] + theta Theta e[t-s-1]

Start values are by Hannan and Rissanen: residuals of a long autoregression stand in for
the noise of a least-squares fit.  Then Gauss-Newton steps lower the conditional sum of
squares (noise before the first full row is 0): errors, their derivatives and the sums
of a step run through one aggregate over the series' array, whose length the calendar
bounds.  A step that does not lower the sum is not taken, and the next is halved.  All of
it is column expressions by series; the exact likelihood of the reference's library is
not repeated, so forecasts differ from it by a few per cent.

Every series gets a forecast.  With fewer than three residuals a coefficient the moving
averages and the product are left out and least squares give the rest; without two
independent regressors the coefficients are 0, and missing early values count as the last
one, so that a very short series goes on as it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.timeseries import accuracy, future_weeks, with_positions

# --- fixed values that must equal the reference's ---------------------------
SEASON = 4
HORIZON = 12
HOLDOUT = 8
# 97.5 % point of the normal distribution, for a 95 % interval.
Z = 1.959963984540054
# -----------------------------------------------------------------------------


#: Gauss-Newton steps.
STEPS = 8
#: Residuals for each coefficient that the full model needs.
ROWS_EACH = 3
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def _numbers(count: int) -> str:
    """SQL text of that many zeros."""
    return f"array({', '.join(['0D'] * count)})"


def solved(matrix: str, n: int) -> str:
    """SQL text: the solution of a linear system of ``n`` rows, each with its right side last,
    by Gauss-Jordan elimination; nulls if a pivot is 0."""
    return (f"transform(aggregate(sequence(0, {n - 1}), {matrix}, (m, k) -> transform(m, (r, i) -> "
            "if(i = k, transform(r, v -> try_divide(v, m[k][k])), "
            f"transform(r, (v, j) -> v - try_divide(r[k] * m[k][j], m[k][k]))))), r -> r[{n}])")


def regression(y: str, xs: list[str], first: int, size: str) -> str:
    """SQL text: least squares of ``y`` on ``xs``, both in terms of t, from t = ``first`` on."""
    n, row = len(xs), [*xs, y]
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    added = ", ".join(f"c[{k}] + {row[i]} * {row[j]}" for k, (i, j) in enumerate(cells))
    rows = ", ".join(f"slice(c, {i * (n + 1) + 1}, {n + 1})" for i in range(n))
    sums = f"aggregate(sequence({first}, {size} - 1), {_numbers(len(cells))}, (c, t) -> array({added}), c -> array({rows}))"
    return solved(sums, n)


def evaluated(d: str, b: str, season: int) -> str:
    """SQL text: at coefficients ``b`` the sum of squares, the four products of errors with
    their derivatives, the ten products of derivatives, then the last errors, newest first.
    A pass behind, the sums take up what the state holds, so that no term is computed twice."""
    lags = season + 1

    def shocks(x):  # what the moving averages make of a quantity's past
        return f"{b}[2] * {x(0)} + {b}[3] * {x(season - 1)} + {b}[2] * {b}[3] * {x(season)}"

    def at(k):
        return f"get({d}, t - {k})"

    e = (f"{at(0)} - {b}[0] * {at(1)} - {b}[1] * {at(season)} + {b}[0] * {b}[1] * {at(lags)} - ("
         + shocks(lambda k: f"a.e[{k}]") + ")")
    own = [f"{b}[1] * {at(lags)} - {at(1)}", f"{b}[0] * {at(lags)} - {at(season)}",
           f"0D - a.e[0] - {b}[3] * a.e[{season}]", f"0D - a.e[{season - 1}] - {b}[2] * a.e[{season}]"]
    slope = ", ".join(f"{own[i]} - ({shocks(lambda k, i=i: f'a.x[{k}][{i}]')})" for i in range(4))
    terms = ["a.e[0] * a.e[0]", *[f"a.x[0][{i}] * a.e[0]" for i in range(4)],
             *[f"a.x[0][{i}] * a.x[0][{j}]" for i, j in _PAIRS]]
    sums = ", ".join(f"a.s[{k}] + {x}" for k, x in enumerate(terms))
    none = ", ".join([_numbers(4)] * lags)  # the errors reach one further, for what comes last
    # One pass more than there are values: its error is null and stands before the last ones.
    return (f"aggregate(sequence({lags}, size({d})), named_struct('e', {_numbers(lags + 1)}, 'x', array({none}), 's', {_numbers(15)}), "
            f"(a, t) -> named_struct('e', concat(array({e}), slice(a.e, 1, {lags})), "
            f"'x', concat(array(array({slope})), slice(a.x, 1, {season})), 's', array({sums})), "
            f"a -> concat(a.s, slice(a.e, 2, {lags})))")


def step_of(ev: str) -> str:
    """SQL text: the Gauss-Newton step from the sums of ``evaluated``."""
    place = {pair: 5 + k for k, pair in enumerate(_PAIRS)}
    rows = ", ".join("array(" + ", ".join(f"{ev}[{place[max(i, j), min(i, j)]}]" for j in range(4)) + f", {ev}[{1 + i}])"
                     for i in range(4))
    return solved(f"array({rows})", 4)


def refined(d: str, b: str, season: int, steps: int) -> str:
    """SQL text: struct of the coefficients ``b`` after the steps, the sums ``ev`` there and the
    ``scale`` of the next step; transforms of arrays of one name values used more than once."""
    def state(b, ev, scale):
        return f"named_struct('b', {b}, 'ev', {ev}, 'scale', {scale})"

    judged = (f"if(coalesce(nev[0] < st.ev[0], false), {state('nb', 'nev', 'least(1D, 2D * st.scale)')}, "
              f"{state('st.b', 'st.ev', 'st.scale / 2D')})")
    moved = "transform(st.b, (v, i) -> v - st.scale * delta[i])"
    taken = (f"transform(array({step_of('st.ev')}), delta -> transform(array({moved}), nb -> "
             f"transform(array({evaluated(d, 'nb', season)}), nev -> {judged})[0])[0])[0]")
    return f"aggregate(sequence(1, {steps}), {state(b, evaluated(d, b, season), '1D')}, (st, n) -> {taken})"


def differences(series: DataFrame, y: str = "Revenue", season: int = SEASON) -> DataFrame:
    """Per series: its length ``n``, ``ys`` (the last season + 1 values, newest first, missing
    ones as the last) and ``d`` (all differences in order), in thousandths."""
    pos = with_positions(series.withColumn(y, F.col(y).cast("decimal(24,3)")))
    pos = pos.withColumn("_y", (F.col(y) * 1000).cast("decimal(28,0)"))
    grouped = pos.groupBy("series_key", "n").agg(F.sort_array(F.collect_list(F.struct("t", "_y"))).alias("_v"))
    v = F.col("_v._y")
    back = [F.coalesce(F.try_element_at(v, F.lit(-k)), F.element_at(v, -1)).cast("double") for k in range(1, season + 2)]
    diff = F.transform(F.sequence(F.lit(season + 1), F.size(v) - 1),
                       lambda t: (F.get(v, t) - F.get(v, t - 1) - F.get(v, t - season) + F.get(v, t - season - 1))
                       .cast("double"))
    return grouped.select("series_key", "n", F.array(*back).alias("ys"),
                          F.when(F.size(v) > season + 1, diff).otherwise(F.array().cast("array<double>")).alias("d"))


def fit_series(series: DataFrame, y: str = "Revenue", season: int = SEASON, steps: int = STEPS) -> DataFrame:
    """TS6: per series ``phi``, ``seasonal_phi``, ``theta``, ``seasonal_theta``, ``product`` (1 with
    the products of the full model, else 0), ``rows`` (residuals), ``sse``, ``start_sse`` (before
    the steps), ``sigma2`` and the last values, differences and errors, newest first."""
    lags, size = season + 1, F.size("d")
    src = differences(series, y, season)
    enough = F.greatest(size - lags, F.lit(0)) >= 4 * ROWS_EACH

    def back(c: str, k: int) -> str:
        return f"get({c}, t - {k})"

    now = "get(d, t)"
    explained = " + ".join(f"a[{k - 1}] * {back('d', k)}" for k in range(1, lags + 1))
    full = (src.where(enough)
            .withColumn("a", F.expr(regression(now, [back("d", k) for k in range(1, lags + 1)], lags, "size(d)")))
            .withColumn("u", F.expr(f"transform(sequence(0, size(d) - 1), t -> if(t < {lags}, 0D, {now} - ({explained})))"))
            .withColumn("b", F.expr(regression(now, [back("d", 1), back("d", season), back("u", 1), back("u", season)],
                                               lags + season, "size(d)")))
            .withColumn("b", F.expr(f"if(exists(b, v -> v is null), {_numbers(4)}, b)"))
            .withColumn("start_sse", F.expr(f"{evaluated('d', 'b', season)}[0]"))
            .withColumn("r", F.expr(refined("d", "b", season, steps))))
    whole = full.select("series_key", "n", "ys", "d", F.col("r.b").alias("b"), F.lit(1).alias("product"),
                        F.col("r.ev")[0].alias("sse"), "start_sse", F.slice("r.ev", 16, lags).alias("es"))

    left = f"get(d, t) - b[0] * {back('d', 1)} - b[1] * {back('d', season)}"
    short = (src.where(~enough)
             .withColumn("b", F.when(size > season, F.expr(regression(now, [back("d", 1), back("d", season)], season, "size(d)"))))
             .withColumn("b", F.expr(f"if(b is null or exists(b, v -> v is null), {_numbers(4)}, concat(b, {_numbers(2)}))"))
             .withColumn("sse", F.when(size > season, F.expr(
                 f"aggregate(sequence({season}, size(d) - 1), 0D, (s, t) -> s + ({left}) * ({left}))"))))
    simple = short.select("series_key", "n", "ys", "d", "b", F.lit(0).alias("product"), "sse",
                          F.lit(None).cast("double").alias("start_sse"), F.expr(_numbers(lags)).alias("es"))
    used = F.when(F.col("product") == 1, size - lags).otherwise(F.greatest(size - season, F.lit(0)))
    spare = used - F.when(F.col("product") == 1, 4).otherwise(2)
    last = F.transform(F.sequence(F.lit(1), F.lit(lags)), lambda k: F.coalesce(F.try_element_at("d", -k), F.lit(0.0)))
    return whole.unionByName(simple).select(
        "series_key", "n", used.alias("rows"), F.col("b")[0].alias("phi"), F.col("b")[1].alias("seasonal_phi"),
        F.col("b")[2].alias("theta"), F.col("b")[3].alias("seasonal_theta"), "product", "sse", "start_sse",
        F.when(spare > 0, F.col("sse") / spare).alias("sigma2"), "ys", last.alias("ds"), "es")


def _path(ys: Column, ds: Column, es: Column, steps: int, season: int, shock: bool = False) -> Column:
    """The next ``steps`` values of a series from its last values, differences and errors,
    newest first; ``shock``: an error of 1 comes first."""
    phi, sphi, theta, stheta, both = (F.col(c) for c in ("phi", "seasonal_phi", "theta", "seasonal_theta", "product"))

    def step(acc: Column, h: Column) -> Column:
        e = F.when(h == 1, 1.0).otherwise(0.0) if shock else F.lit(0.0)
        d = (phi * acc["ds"][0] + sphi * acc["ds"][season - 1] - both * phi * sphi * acc["ds"][season] + e
             + theta * acc["es"][0] + stheta * acc["es"][season - 1] + theta * stheta * acc["es"][season])
        y = d + acc["ys"][0] + acc["ys"][season - 1] - acc["ys"][season]
        return F.struct(F.concat(F.array(y), F.slice(acc["ys"], 1, season)).alias("ys"),
                        F.concat(F.array(d), F.slice(acc["ds"], 1, season)).alias("ds"),
                        F.concat(F.array(e), F.slice(acc["es"], 1, season)).alias("es"),
                        F.concat(acc["out"], F.array(y)).alias("out"))

    start = F.struct(ys.alias("ys"), ds.alias("ds"), es.alias("es"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["out"])


def forecast_series(series: DataFrame, y: str = "Revenue", steps: int = HORIZON,
                    season: int = SEASON) -> DataFrame:
    """TS6 + TS7: per-series fit on all points and ``steps``-ahead forecast with a
    95 % interval: (series_key, Week, Forecast, Lower_CI, Upper_CI)."""
    zeros = F.expr(_numbers(season + 1))
    fitted = fit_series(series, y, season).select(
        "*", _path(F.col("ys"), F.col("ds"), F.col("es"), steps, season).alias("_f"),
        _path(zeros, zeros, zeros, steps, season, shock=True).alias("_psi"))
    # Weeks are exploded, not the forecast: a filter on its size would be pushed down with
    # a copy of the fit.
    rows = fitted.select("series_key", "sigma2", "_psi", "_f", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k"))
    spread = F.aggregate(F.slice("_psi", F.lit(1), F.col("_k")), F.lit(0.0), lambda a, x: a + x * x)
    half = F.lit(Z) * F.sqrt(F.col("sigma2") * spread) / 1000.0
    point = F.get("_f", F.col("_k") - 1) / 1000.0
    return rows.select("series_key", F.col("_k").cast("int").alias("Week"),
                       point.alias("Forecast"), (point - half).alias("Lower_CI"),
                       (point + half).alias("Upper_CI"))


def forecast_table(series: DataFrame, y: str = "Revenue", steps: int = HORIZON) -> DataFrame:
    """TS10: Week, Date (TS9 week-ending dates), Forecast, Lower_CI, Upper_CI."""
    fc = forecast_series(series, y, steps)
    dates = future_weeks(series, steps)
    return fc.join(dates, ["series_key", "Week"]).select(
        "series_key", "Week", "Date", "Forecast", "Lower_CI", "Upper_CI")


def forecast_summary(table: DataFrame) -> DataFrame:
    """AGG17: total, mean, min and max of the forecast per series."""
    return table.groupBy("series_key").agg(
        F.sum("Forecast").alias("total_forecast"), F.avg("Forecast").alias("mean_forecast"),
        F.min("Forecast").alias("min_forecast"), F.max("Forecast").alias("max_forecast"))


def holdout_predictions(series: DataFrame, y: str = "Revenue",
                        holdout: int = HOLDOUT) -> DataFrame:
    """TS4 + TS6: fit on all but the last ``holdout`` points of each series and
    forecast them; (series_key, Date, actual, predicted).  A series that has no
    point before these keeps its rows with ``predicted`` NULL."""
    pos = with_positions(series, holdout)
    train = pos.filter(F.col("is_test") == 0).select("series_key", "Date", y)
    test = pos.filter(F.col("is_test") == 1).withColumn(
        "Week", (F.col("t") - F.col("n") + holdout + 1).cast("int"))
    fc = forecast_series(train, y, holdout)
    return test.join(fc, ["series_key", "Week"], "left").select(
        "series_key", "Date", F.col(y).cast("double").alias("actual"),
        F.col("Forecast").alias("predicted"))


def holdout_accuracy(series: DataFrame, y: str = "Revenue", holdout: int = HOLDOUT) -> DataFrame:
    """TS8 on the model: MAE, RMSE, MAPE of the hold-out forecast per series; a
    series without training points has NULL errors over 0 points."""
    return accuracy(holdout_predictions(series, y, holdout))
