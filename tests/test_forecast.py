import datetime as dt

import numpy as np
import pytest

from riskloom.operators import forecast as FC
from riskloom.operators.weekly import METRICS

SCHEMA = "country string, metric string, t int, y double, n long, is_holdout boolean"


def series(spark, ys, country="XX", metric="total_mentions"):
    n = len(ys)
    return spark.createDataFrame([(country, metric, i + 1, float(y), n, i + 1 == n) for i, y in enumerate(ys)], SCHEMA)


def ar(spark, ys, upto="train"):
    return {(r["p"], r["d"]): r["forecast"] for r in FC.ar_forecasts(series(spark, ys), upto=upto).collect()}


def test_closed_forms(spark):
    ys = [3.0, 5.0, 4.0, 6.0, 8.0, 7.0, 9.0]
    f = ar(spark, ys)
    train = ys[:-1]
    assert f[(0, 0)] == pytest.approx(np.mean(train))
    assert f[(0, 1)] == pytest.approx(train[-1])
    assert f[(0, 2)] == pytest.approx(2 * train[-1] - train[-2])
    x, y = np.array(train[:-1]), np.array(train[1:])
    slope, icpt = np.polyfit(x, y, 1)
    assert f[(1, 0)] == pytest.approx(icpt + slope * train[-1])


@pytest.mark.parametrize("n", [6, 12])
def test_closed_forms_equal_least_squares(spark, n):
    rng = np.random.default_rng(n)
    ys = np.cumsum(rng.normal(size=n)) + 5
    y = ys[:-1]
    for (p, d), f in ar(spark, ys.tolist()).items():
        z, const = np.diff(y, d), [1.0] if d == 0 else []
        rows = [const + [z[t - i] for i in range(1, p + 1)] for t in range(p, len(z))]
        if len(rows) < max(1, p + len(const)):
            assert f is None
            continue
        c = np.linalg.lstsq(np.array(rows), z[p:], rcond=None)[0] if rows[0] else np.zeros(0)
        zhat = np.dot(const + [z[len(z) - i] for i in range(1, p + 1)], c) if len(c) else 0.0
        assert f == pytest.approx(zhat if d == 0 else y[-1] + zhat if d == 1 else 2 * y[-1] - y[-2] + zhat, rel=1e-6, abs=1e-6)


def two_stage(y, p, d, q):
    """One-step forecast by numpy's least squares, or None."""
    y = np.asarray(y, float)
    z, one = np.diff(y, d), d == 0
    fit = lambda rows, v: np.linalg.lstsq(np.array(rows), np.array(v), rcond=None)[0]
    const = [1.0] if one else []
    if len(z) - 2 <= 2 + one:
        return None
    long = fit([const + [z[t - 1], z[t - 2]] for t in range(2, len(z))], z[2:])
    e = {t: z[t] - np.dot(const + [z[t - 1], z[t - 2]], long) for t in range(2, len(z))}
    rows = [const + [z[t - i] for i in range(1, p + 1)] + [e[t - j] for j in range(1, q + 1)] for t in range(2 + q, len(z))]
    if len(rows) < p + q + one:
        return None
    c = fit(rows, z[2 + q:])
    phi, theta = c[one:one + p], c[one + p:]
    for poly in (np.r_[1, -phi], np.r_[1, theta]):
        if len(poly) > 1 and np.any(np.abs(np.roots(poly)) >= 1):
            return None
    m = len(z)
    zhat = np.dot(const + [z[m - i] for i in range(1, p + 1)] + [e[m - j] for j in range(1, q + 1)], c)
    return zhat if d == 0 else y[-1] + zhat if d == 1 else 2 * y[-1] - y[-2] + zhat


@pytest.mark.parametrize("n", [4, 7, 10, 40])
@pytest.mark.parametrize("upto", ["train", "all"])
def test_two_regressions_equal_least_squares(spark, n, upto):
    rng = np.random.default_rng(n)
    many = {f"C{i}": np.cumsum(rng.normal(size=n)) * 10 ** (i % 4) + 50 * i for i in range(4)}
    s = None
    for name, ys in many.items():
        one = series(spark, ys, name)
        s = one if s is None else s.unionByName(one)
    got = {(r["country"], r["p"], r["d"], r["q"]): r["forecast"] for r in FC.arma_forecasts(s, upto=upto).collect()}
    assert len(got) == 4 * 18
    refused = 0
    for (name, p, d, q), f in got.items():
        want = two_stage(many[name][:-1] if upto == "train" else many[name], p, d, q)
        refused += f is None and want is not None  # the tolerance may refuse what least squares still solves
        assert f is None or f == pytest.approx(want, rel=1e-5, abs=1e-5)
    assert n < 10 or refused < 0.2 * sum(f is not None for f in got.values())


@pytest.mark.parametrize("ys", [[5.0] * 12, [float(i) for i in range(12)], [1.0, None, 2.0, 3.0, 2.0, 4.0, 3.0, 5.0, 4.0, 6.0, 5.0, 7.0], [1.0], [1.0, 2.0]])
def test_series_without_shocks_or_with_gaps_have_no_moving_average(spark, ys):
    s = spark.createDataFrame([("XX", "m", i + 1, y, len(ys), i + 1 == len(ys)) for i, y in enumerate(ys)], SCHEMA)
    assert all(r["forecast"] is None for r in FC.arma_forecasts(s).collect())
    assert FC.next_week_forecast(s, orders="all").count() == (1 if len(ys) > 1 and None not in ys else 0)


def test_order_grid_has_27_rows_per_series(spark):
    keys = spark.createDataFrame([("A", "m"), ("B", "m")], "country string, metric string")
    grid = FC.order_grid(keys)
    assert grid.count() == 54 and grid.select("p", "d", "q").distinct().count() == 27


def test_constant_series_mean_wins(spark):  # E12
    s = series(spark, [4.0] * 6)
    best = FC.best_order(s, FC.ar_forecasts(s)).first()
    assert (best["p"], best["d"], best["q"]) == (0, 0, 0) and best["forecast"] == 4.0


def weekly(spark, n_weeks, country="XX"):
    rows = [(country, dt.date(2024, 1, 1) + dt.timedelta(days=7 * i), 10 + i, 5 + i, 3 + i, 0.5 * i, -0.2 * i)
            for i in range(n_weeks)]
    return spark.createDataFrame(rows, "country string, week date, total_mentions long, total_sources long, "
                                       "total_articles long, center_tone double, center_goldstein double")


@pytest.mark.parametrize("n,fallback", [(0, True), (1, True), (2, False), (6, False)])
@pytest.mark.parametrize("orders", ["ar", "all"])
def test_short_series_fallback(spark, n, fallback, orders):  # E10, E11
    countries = spark.createDataFrame([("XX",)], "country string")
    wk = weekly(spark, n) if n else weekly(spark, 1).limit(0)
    out = FC.forecast_table(wk, countries, orders=orders).first()
    assert out["is_fallback"] == fallback
    if fallback:
        assert all(out[m] == 0.0 for m in METRICS)


def test_reference_direction_predicts_oldest(spark):
    wk = weekly(spark, 5)
    s = FC.metric_series(wk, "reference").filter("is_holdout").select("week").distinct().collect()
    assert s[0]["week"] == dt.date(2024, 1, 1)


def test_one_metric_unforecastable_zero_fills_all(spark):  # E11
    rows = [("XX", dt.date(2024, 1, 1) + dt.timedelta(days=7 * i), 10 + i, 5 + i, 3 + i, None, -0.2 * i)
            for i in range(6)]
    wk = spark.createDataFrame(rows, "country string, week date, total_mentions long, total_sources long, "
                                     "total_articles long, center_tone double, center_goldstein double")
    countries = spark.createDataFrame([("XX",)], "country string")
    out = FC.forecast_table(wk, countries, orders="ar").first()
    assert out["is_fallback"] and all(out[m] == 0.0 for m in METRICS)
