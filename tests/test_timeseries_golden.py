"""Golden tests on the published 53-week revenue series (re-typed below):
decomposition values, double differencing, and the 12-week forecast, whose conditional
sum of squares brings it within some per cent of the published exact likelihood."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import forecast, timeseries as ts

# Published weekly revenue, Sundays 2010-12-05 … 2011-12-11 (2011-01-02 absent).
REVENUE = [149386.33, 213447.72, 163770.73, 46109.11, 114865.27, 154714.94, 175757.98,
           105288.77, 106095.23, 88015.42, 126050.40, 130687.36, 117600.82, 112338.0,
           138278.82, 129918.43, 143977.03, 119961.92, 135142.201, 116090.02, 73474.56,
           131329.18, 178850.25, 196269.92, 146976.9, 102371.9, 194019.08, 171940.3,
           112818.82, 116479.92, 131383.74, 118297.88, 167519.81, 164667.901, 156185.19,
           143652.21, 168080.69, 148051.26, 114046.78, 167004.06, 209167.98, 309569.211,
           194007.851, 297116.86, 204423.28, 255461.64, 237685.49, 260628.77, 264765.98,
           277773.94, 249532.68, 251788.22, 408587.15]
# Published 12-week forecast: point, lower 95 % bound.
FORECAST = [340927.0502, 302534.0509, 325228.3167, 394809.7320, 377004.0302, 340761.1555,
            362884.1762, 435208.3835, 415836.5482, 379526.1287, 401667.0959, 473905.1349]
LOWER = [229835.2510, 186907.7954, 206019.6228, 272151.0875, 228692.9925, 185886.6608,
         202122.0221, 268781.7340, 222027.9119, 176851.6971, 190928.4382, 255415.5019]


def _dates():
    d, out = dt.date(2010, 12, 5), []
    while len(out) < len(REVENUE):
        if d != dt.date(2011, 1, 2):
            out.append(d)
        d += dt.timedelta(days=7)
    return out


@pytest.fixture(scope="module")
def weekly(spark):
    rows = [("ALL", d, float(v)) for d, v in zip(_dates(), REVENUE)]
    return spark.createDataFrame(rows, "series_key string, Date date, Revenue double")


@pytest.fixture(scope="module")
def weekly_exact(weekly):
    return weekly.withColumn("Revenue", F.col("Revenue").cast("decimal(24,3)"))


def test_fixture_shape():
    assert len(REVENUE) == 53
    assert sum(REVENUE) == pytest.approx(8911425.904, abs=1e-3)
    assert all(d.weekday() == 6 for d in _dates())


@pytest.mark.parametrize("series", ["weekly", "weekly_exact"])
def test_decomposition_golden(request, series):
    d = ts.decompose(request.getfixturevalue(series)).orderBy("t").toPandas()
    assert d.loc[2, "trend"] == pytest.approx(138863.34, abs=1e-6)
    assert d.loc[50, "trend"] == pytest.approx(278942.85125, abs=1e-6)
    seasonal = d.groupby(d["t"] % 4)["seasonal"].first().tolist()
    assert seasonal == pytest.approx([-6478.0792524, 3066.8148726, 3889.48186138,
                                      -478.21748157], abs=1e-6)
    assert d.loc[2, "residual"] == pytest.approx(21017.90813862, abs=1e-6)
    assert d.loc[50, "residual"] == pytest.approx(-33299.65311138, abs=1e-6)
    assert d["trend"].isna().sum() == 4
    ok = d.dropna()
    assert np.allclose(ok["observed"], ok["trend"] + ok["seasonal"] + ok["residual"])


def test_double_difference_golden(weekly):
    d = ts.difference(weekly).orderBy("t").toPandas()
    assert len(d) == 48
    assert d["d2"].iloc[0] == pytest.approx(-24211.72, abs=1e-6)
    assert d["d2"].iloc[-1] == pytest.approx(152661.72, abs=1e-6)


def test_holdout_split(weekly):
    p = ts.with_positions(weekly, 8).toPandas()
    assert p["is_test"].sum() == 8
    assert str(p.loc[p["is_test"] == 0, "Date"].max()) == "2011-10-16"
    assert str(p.loc[p["is_test"] == 1, "Date"].min()) == "2011-10-23"


def test_forecast_against_published(weekly):
    t = forecast.forecast_table(weekly).orderBy("Week").toPandas()
    assert len(t) == 12
    assert str(t["Date"].iloc[0]) == "2011-12-18" and str(t["Date"].iloc[-1]) == "2012-03-04"
    pub, got = np.array(FORECAST), t["Forecast"].to_numpy()
    assert np.mean(np.abs(got - pub) / pub) < 0.08 and np.max(np.abs(got - pub) / pub) < 0.12
    low = t["Lower_CI"].to_numpy()
    assert np.mean(np.abs(low - np.array(LOWER)) / pub) < 0.1
    assert np.allclose(t["Upper_CI"] - t["Forecast"], t["Forecast"] - t["Lower_CI"])
    assert (np.diff(t["Upper_CI"] - t["Forecast"]) > 0).all()


def errors_at(d, b):
    """Errors and their derivatives, one by one."""
    phi, sphi, theta, stheta = b
    e, x = np.zeros(len(d)), np.zeros((len(d), 4))
    for i in range(5, len(d)):
        e[i] = (d[i] - phi * d[i - 1] - sphi * d[i - 4] + phi * sphi * d[i - 5] - theta * e[i - 1]
                - stheta * e[i - 4] - theta * stheta * e[i - 5])
        own = np.array([sphi * d[i - 5] - d[i - 1], phi * d[i - 5] - d[i - 4], -e[i - 1] - stheta * e[i - 5],
                        -e[i - 4] - theta * e[i - 5]])
        x[i] = own - theta * x[i - 1] - stheta * x[i - 4] - theta * stheta * x[i - 5]
    return e, x


def start_values(d):
    n = len(d)
    lags = np.stack([d[5 - k:n - k] for k in range(1, 6)], 1)
    u = np.append(np.zeros(5), d[5:] - lags @ np.linalg.lstsq(lags, d[5:], rcond=None)[0])
    i = np.arange(9, n)
    return np.linalg.lstsq(np.stack([d[i - 1], d[i - 4], u[i - 1], u[i - 4]], 1), d[9:], rcond=None)[0]


def fitted(d, steps):
    b = start_values(d)
    e, x = errors_at(d, b)
    scale, sums = 1.0, [e @ e]
    for _ in range(steps):
        nb = b - scale * np.linalg.solve(x.T @ x, x.T @ e)
        ne, nx = errors_at(d, nb)
        if ne @ ne < e @ e:
            b, e, x, scale = nb, ne, nx, min(1.0, 2 * scale)
        else:
            scale /= 2
        sums.append(e @ e)
    return b, e, sums


def test_coefficients_and_forecast_match_plain_recursions(weekly):
    y = np.array(REVENUE)
    d = np.diff(y)
    d = d[4:] - d[:-4]
    b, e, sums = fitted(d, forecast.STEPS)
    fit = forecast.fit_series(weekly).first()
    got = [fit[c] for c in ("phi", "seasonal_phi", "theta", "seasonal_theta")]
    assert got == pytest.approx(b.tolist(), rel=1e-6)
    assert fit["start_sse"] / 1e6 == pytest.approx(sums[0]) and fit["sse"] / 1e6 == pytest.approx(sums[-1])
    assert fit["sigma2"] / 1e6 == pytest.approx(sums[-1] / (len(d) - 5 - 4))
    ys, ds, es = list(y), list(d), list(e)
    for _ in range(12):
        ds.append(b[0] * ds[-1] + b[1] * ds[-4] - b[0] * b[1] * ds[-5] + b[2] * es[-1] + b[3] * es[-4]
                  + b[2] * b[3] * es[-5])
        es.append(0.0)
        ys.append(ds[-1] + ys[-1] + ys[-4] - ys[-5])
    out = forecast.forecast_series(weekly).orderBy("Week").toPandas()["Forecast"]
    assert np.allclose(out, ys[-12:], rtol=1e-6)


def test_the_sum_of_squares_never_rises(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(12):
        kind, level = s % 4, 1000.0 * (1 + s)
        for i in range(30 + 5 * s):
            level += float(rng.normal() * (1, 50, 400, 0)[kind])
            rows.append((f"S{s}", dt.date(2020, 1, 5) + dt.timedelta(days=7 * i), round(level + (i % 4) * 20 * kind, 2)))
    df = spark.createDataFrame(rows, "series_key string, Date date, Revenue double")
    ends = [[(r.start_sse, r.sse) for r in forecast.fit_series(df, steps=k).orderBy("series_key").collect()] for k in (1, 8)]
    for (start, one), (again, eight) in zip(*ends):
        assert start == pytest.approx(again) and eight <= one <= start
    assert all(np.isfinite(r.Forecast) for r in forecast.forecast_series(df).collect())


def test_short_series_are_least_squares(spark):
    y = np.array(REVENUE[:20])
    d = np.diff(y)
    d = d[4:] - d[:-4]
    beta = np.linalg.lstsq(np.stack([d[3:-1], d[:-4]], axis=1), d[4:], rcond=None)[0]
    rows = [("ALL", day, float(v)) for day, v in zip(_dates(), y)]
    fit = forecast.fit_series(spark.createDataFrame(rows, "series_key string, Date date, Revenue double")).first()
    assert (fit["phi"], fit["seasonal_phi"]) == (pytest.approx(beta[0]), pytest.approx(beta[1]))
    assert (fit["theta"], fit["seasonal_theta"], fit["product"]) == (0, 0, 0)


def test_forecast_summary(weekly):
    s = forecast.forecast_summary(forecast.forecast_table(weekly)).first()
    assert s["min_forecast"] <= s["mean_forecast"] <= s["max_forecast"]
    assert s["total_forecast"] == pytest.approx(12 * s["mean_forecast"])


def test_holdout_accuracy_is_finite(weekly):
    acc = forecast.holdout_accuracy(weekly).first()
    assert acc["points"] == 8
    assert 0 < acc["mae"] <= acc["rmse"]
    assert 0 < acc["mape"] < 100


def test_no_series_is_missing(spark):
    rows = [(f"S{n}", dt.date(2020, 1, 5) + dt.timedelta(days=7 * i), 10.0 + i * i % 7)
            for n in (1, 3, 6, 8, 9, 15, 16, 20, 60) for i in range(n)]
    df = spark.createDataFrame(rows, "series_key string, Date date, Revenue double")
    out = forecast.forecast_series(df).toPandas()
    assert len(out) == 9 * 12 and out["Forecast"].notna().all()
    assert (out[out.series_key == "S1"]["Forecast"] == 10).all()
    acc = {r.series_key: r for r in forecast.holdout_accuracy(df).collect()}
    assert len(acc) == 9
    assert all((acc[k].points == 8) == (int(k[1:]) > 8) for k in acc)
    assert acc["S8"].mae is None and acc["S9"].mae is not None
