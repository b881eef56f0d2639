"""One-step forecasts of the five weekly metrics for every country at once.

The reference fits 27 ARIMA(p, d, q) orders (p, d, q in 0..2) per metric with a
likelihood package, scores each by the squared error on one held-out week, keeps
the first order with the lowest error and reports that model's one-step forecast
(not refitted on the holdout). Any failure in any metric zero-fills the country.

Here (parity of method, not of digits: no likelihood package is used):

- series are long rows ``(country, metric, t, week, y)`` built by ``unpivot``;
- the nine q = 0 orders are conditional least squares with closed forms, computed
  as one DataFrame aggregate per (series, p, d): sums of products of the lagged
  differenced values, then 1- or 2-variable normal equations by column arithmetic;
- the 18 q > 0 orders are two linear regressions (a long autoregression for the
  shocks, then lags and shocks together) from sums of products, in columns as well;
  unstable or non-invertible fits give NULL;
- the winner is ``min_by`` over (squared error, p, d, q) with failed fits removed.

Trend: a constant when d = 0, none when d > 0. An order is fitted only when it has
at least as many equations as coefficients (and at least one equation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.weekly import METRICS

SERIES_KEY = ("country", "metric")
ORDERS = [(p, d, q) for p in range(3) for d in range(3) for q in range(3)]


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def metric_series(weekly: DataFrame, direction: str = "forward", by: Sequence[str] = ("country",)) -> DataFrame:
    """F1 + W3: wide weekly rows to one long series per (group, metric), numbered by ``t``.

    ``direction='forward'`` numbers weeks oldest first, so the newest week is the
    holdout and the forecast is for the week after it. ``direction='reference'``
    numbers newest first, as the reference's rows arrive (holdout = oldest week).
    Also adds ``n`` (series length) and ``is_holdout`` (``t == n``).
    """
    if direction not in ("forward", "reference"):
        raise ValueError("direction must be 'forward' or 'reference'")
    long = weekly.select(*by, "week", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(
        [*by, "week"], list(METRICS), "metric", "y")
    key = [*by, "metric"]
    order = F.col("week").asc() if direction == "forward" else F.col("week").desc()
    # Series are bounded by the lookback (a few dozen weeks), so one task per series is fine.
    w = Window.partitionBy(*key).orderBy(order)
    return (long.withColumn("t", F.row_number().over(w))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
            .withColumn("is_holdout", F.col("t") == F.col("n")))


def differenced_series(series: DataFrame, by: Sequence[str] = ("country",)) -> DataFrame:
    """Lags y(t-1..t-4) and the first and second differences of each series."""
    w = Window.partitionBy(*by, "metric").orderBy("t")
    out = series
    for i in range(1, 5):
        out = out.withColumn(f"y_lag{i}", F.lag("y", i).over(w))
    return (out.withColumn("diff1", F.col("y") - F.col("y_lag1"))
            .withColumn("diff2", F.col("y") - 2 * F.col("y_lag1") + F.col("y_lag2")))


def order_grid(series_keys: DataFrame, orders=ORDERS) -> DataFrame:
    """every series with the 27 orders (an exploded literal, no join)."""
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q")) for p, d, q in orders])
    return series_keys.select("*", F.explode(grid).alias("_o")).select("*", "_o.p", "_o.d", "_o.q").drop("_o")


def _z(d: int, lag: int) -> Column:
    """d-th difference of y taken at t - lag, from the lag columns."""
    y = [F.col("y")] + [F.col(f"y_lag{i}") for i in range(1, 5)]
    if d == 0:
        return y[lag]
    if d == 1:
        return y[lag] - y[lag + 1]
    return y[lag] - 2 * y[lag + 1] + y[lag + 2]


def ar_forecasts(series: DataFrame, by: Sequence[str] = ("country",), upto: str = "train") -> DataFrame:
    """One-step forecasts of the nine q = 0 orders for every series.

    ``upto='train'`` fits on t < n (the holdout is predicted); ``upto='all'`` fits on
    every point and forecasts the week after (used by ``refit=True``).
    Output: by + metric, p, d, q (= 0), forecast (NULL when the order cannot be fitted)
    and ``y_test``, the held-out value the forecast is scored against (NULL for 'all').
    """
    diffs = differenced_series(series, by)
    m = F.col("n") - 1 if upto == "train" else F.col("n")
    combos = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"),
                                _z(d, 0).alias("zt"),
                                (_z(d, 1) if p >= 1 else F.lit(0.0)).alias("x1"),
                                (_z(d, 2) if p >= 2 else F.lit(0.0)).alias("x2"),
                                _z(d, 1).alias("zprev"))
                       for p in range(3) for d in range(3)])
    rows = (diffs.withColumn("_m", m)
            .select(*by, "metric", "t", "n", "y", "y_lag1", "_m", F.explode(combos).alias("_c"))
            .select("*", "_c.*").drop("_c"))
    reg = (F.col("t") >= F.col("d") + F.col("p") + 1) & (F.col("t") <= F.col("_m"))
    last = F.col("t") == F.col("_m")

    def s(c: Column) -> Column:
        return F.sum(F.when(reg, c))

    sums = rows.groupBy(*by, "metric", "p", "d").agg(
        F.count_if(reg).alias("E"),
        s(F.col("zt")).alias("Sy"), s(F.col("x1")).alias("S1"), s(F.col("x2")).alias("S2"),
        s(F.col("x1") * F.col("x1")).alias("S11"), s(F.col("x1") * F.col("x2")).alias("S12"),
        s(F.col("x2") * F.col("x2")).alias("S22"), s(F.col("x1") * F.col("zt")).alias("S1y"),
        s(F.col("x2") * F.col("zt")).alias("S2y"),
        F.max(F.when(last, F.col("y"))).alias("ym"), F.max(F.when(last, F.col("y_lag1"))).alias("ym1"),
        F.max(F.when(last, F.col("zt"))).alias("zm"), F.max(F.when(last, F.col("zprev"))).alias("zm1"),
        F.max(F.when(F.col("t") == F.col("n"), F.col("y"))).alias("y_holdout"),
        F.count_if(F.col("y").isNull()).alias("gaps"))
    # Each quantity is its own column, referenced by name, so the plan stays small.
    E = F.col("E").cast("double")
    icpt = F.col("d") == 0

    def centred(sxy: str, sx: str, sy: str):
        return F.when(icpt, F.col(sxy) - _div(F.col(sx) * F.col(sy), E)).otherwise(F.col(sxy))

    fitted = (sums
              .withColumn("a11", centred("S11", "S1", "S1")).withColumn("a12", centred("S12", "S1", "S2"))
              .withColumn("a22", centred("S22", "S2", "S2")).withColumn("b1", centred("S1y", "S1", "Sy"))
              .withColumn("b2", centred("S2y", "S2", "Sy"))
              .withColumn("det", F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")))
    fitted = (fitted
              .withColumn("phi1", F.when(F.col("p") == 0, F.lit(0.0)).when(F.col("p") == 1, _div(F.col("b1"), F.col("a11")))
                          .otherwise(_div(F.col("b1") * F.col("a22") - F.col("b2") * F.col("a12"), F.col("det"))))
              .withColumn("phi2", F.when(F.col("p") == 2, _div(F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1"),
                                                                  F.col("det"))).otherwise(F.lit(0.0))))
    fitted = fitted.withColumn(
        "c", F.when(icpt, _div(F.col("Sy") - F.col("phi1") * F.col("S1") - F.col("phi2") * F.col("S2"), E)).otherwise(F.lit(0.0)))
    fitted = fitted.withColumn(
        "zhat", F.col("c") + F.when(F.col("p") >= 1, F.col("phi1") * F.col("zm")).otherwise(F.lit(0.0))
        + F.when(F.col("p") == 2, F.col("phi2") * F.col("zm1")).otherwise(F.lit(0.0)))
    fitted = fitted.withColumn(
        "yhat", F.when(F.col("d") == 0, F.col("zhat")).when(F.col("d") == 1, F.col("ym") + F.col("zhat"))
        .otherwise(2 * F.col("ym") - F.col("ym1") + F.col("zhat")))
    k = F.col("p") + F.when(icpt, 1).otherwise(0)
    # A NULL anywhere in a series, holdout included, fails every order of it.
    valid = (F.col("E") >= F.greatest(k, F.lit(1))) & (F.col("gaps") == 0)
    y_test = F.col("y_holdout") if upto == "train" else F.lit(None).cast("double")
    return fitted.select(*by, "metric", "p", "d", F.lit(0).alias("q"),
                         F.when(valid, _finite(F.col("yhat"))).alias("forecast"), y_test.alias("y_test"))


# ------------------------------------------------------------------ q > 0 (two regressions)

#: Lags of the first, long regression, whose residuals stand for the unknown shocks.
LONG_ORDER = 2
#: A regressor that the ones before it explain up to this share of its square is a repetition: no fit.
TOLERANCE = 1e-4
#: Residuals below this share of the squares are rounding: the series has no shocks to fit.
NO_SHOCKS = 1e-9


def _gram(x: Sequence[Column], total) -> Column:
    """Symmetric matrix of the sums of products, each taken once; ``total`` turns a product into its sum."""
    sums = {(i, j): total(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    return F.array(*[F.array(*[sums[min(i, j), max(i, j)] for j in range(len(x))]) for i in range(len(x))])


def _eliminated(gram: str, pivots: str) -> Column:
    """Gauss-Jordan elimination of the columns ``pivots`` (an array of indexes) of a matrix of sums: a struct of
    the matrix ``m`` and ``ok``. The last column then has the coefficients of the pivots, and its own sum of
    squares that of the residuals."""
    return F.expr(
        f"aggregate({pivots}, named_struct('m', {gram}, 'ok', true), (s, k) -> named_struct("
        "'m', transform(s.m, (row, i) -> transform(row, (x, j) -> CASE WHEN i = k THEN x / nullif(s.m[k][k], 0D) "
        "ELSE x - s.m[i][k] * s.m[k][j] / nullif(s.m[k][k], 0D) END)), "
        f"'ok', coalesce(s.ok AND s.m[k][k] > {TOLERANCE}D * {gram}[k][k], false)))")


def arma_forecasts(series: DataFrame, by: Sequence[str] = ("country",), upto: str = "train") -> DataFrame:
    """One-step forecasts of the 18 q > 0 orders for every series, in columns throughout.

    Two regressions per (series, d), after Hannan and Rissanen: a long autoregression of LONG_ORDER
    lags gives residuals in place of the unknown shocks; then the value is regressed on p of its lags
    and q of these residuals. Both are sums of products, eliminated in an array of at most 6 x 6
    numbers. No fit: fewer equations than coefficients (the first regression needs one more), a
    regressor that repeats the others (TOLERANCE), no residuals (NO_SHOCKS), or coefficients of an
    unstable or not invertible process.

    Output as of ``ar_forecasts``. Windows hold one series, whose length the lookback bounds.
    """
    key = [*by, "metric"]
    m = F.col("n") - 1 if upto == "train" else F.col("n")
    whole = Window.partitionBy(*key)
    rows = differenced_series(series, by).withColumn("m", m)
    inside = F.col("t") <= F.col("m")
    # Sums of squares keep their digits if the values are near 0; only d = 0 notices, and gets it back.
    rows = rows.withColumn("centre", F.avg(F.when(inside, F.col("y"))).over(whole)).withColumn("gaps", F.count_if(F.col("y").isNull()).over(whole))
    rows = rows.withColumn("y_holdout", F.max(F.when(F.col("t") == F.col("n"), F.col("y"))).over(whole))
    z = F.array(*[F.struct(F.lit(d).alias("d"), (_z(d, 0) - (F.col("centre") if d == 0 else F.lit(0.0))).alias("z")) for d in range(3)])
    rows = rows.filter(inside).select(*key, "t", "m", "y", "y_lag1", "centre", "gaps", "y_holdout", F.explode(z).alias("o")).select("*", "o.d", "o.z").drop("o")
    one, each = Window.partitionBy(*key, "d"), Window.partitionBy(*key, "d").orderBy("t")
    rows = rows.withColumn("z1", F.lag("z", 1).over(each)).withColumn("z2", F.lag("z", 2).over(each))

    first = F.col("t") > F.col("d") + LONG_ORDER
    constant = F.when(F.col("d") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    x = [F.lit(1.0), F.col("z1"), F.col("z2"), F.col("z")]
    rows = rows.withColumn("gram", _gram(x, lambda c: F.sum(F.when(first, c)).over(one))).withColumn("E1", F.count_if(first).over(one))
    rows = rows.withColumn("pivots", F.concat(constant, F.array(F.lit(1), F.lit(2)))).withColumn("fit", _eliminated("gram", "pivots"))
    told = (F.col("fit.ok") & (F.col("E1") > F.size("pivots")) & (F.col("fit.m")[3][3] > NO_SHOCKS * F.col("gram")[3][3]))
    mean = F.when(F.col("d") == 0, F.col("fit.m")[0][3]).otherwise(F.lit(0.0))
    shock = F.col("z") - mean - F.col("fit.m")[1][3] * F.col("z1") - F.col("fit.m")[2][3] * F.col("z2")
    rows = rows.withColumn("e", F.when(first & told, shock)).drop("gram", "pivots", "fit")
    rows = rows.withColumn("e1", F.lag("e", 1).over(each)).withColumn("e2", F.lag("e", 2).over(each))

    rows = rows.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2))))
    second = F.col("t") > F.col("d") + LONG_ORDER + F.col("q")
    x = [F.lit(1.0), F.col("z1"), F.col("z2"), F.col("e1"), F.when(F.col("q") == 2, F.col("e2")).otherwise(F.lit(0.0)), F.col("z")]
    last = F.col("t") == F.col("m")
    fits = rows.groupBy(*key, "d", "q").agg(
        _gram(x, lambda c: F.sum(F.when(second, c))).alias("gram"), F.count_if(second & F.col("e1").isNotNull()).alias("E"),
        *[F.max(F.when(last, F.col(c))).alias(name) for c, name in (("y", "ym"), ("y_lag1", "ym1"), ("z", "zm"), ("z1", "zm1"), ("e", "em"), ("e1", "em1"))],
        F.max("centre").alias("centre"), F.max("gaps").alias("gaps"), F.max("y_holdout").alias("y_holdout"))
    fits = fits.withColumn("p", F.explode(F.array(*map(F.lit, range(3)))))
    fits = fits.withColumn("pivots", F.concat(constant, F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), F.col("p")),
                                              F.slice(F.array(F.lit(3), F.lit(4)), F.lit(1), F.col("q"))))
    fits = fits.withColumn("fit", _eliminated("gram", "pivots"))
    # A coefficient of a variable that isn't in the order is 0.
    for i, name in enumerate(("c", "phi1", "phi2", "theta1", "theta2")):
        fits = fits.withColumn(name, F.when(F.array_contains("pivots", i), F.col("fit.m")[i][5]).otherwise(F.lit(0.0)))
    def inside_circle(a1: Column, a2: Column) -> Column:  # roots of 1 - a1 B - a2 B^2 outside the unit circle
        return (F.abs(a2) < 1) & (a1 + a2 < 1) & (a2 - a1 < 1)

    stable = inside_circle(F.col("phi1"), F.col("phi2")) & inside_circle(-F.col("theta1"), -F.col("theta2"))
    fits = fits.withColumn("zhat", F.col("c") + F.col("phi1") * F.col("zm") + F.col("theta1") * F.col("em")
                           + F.when(F.col("p") == 2, F.col("phi2") * F.col("zm1")).otherwise(F.lit(0.0))
                           + F.when(F.col("q") == 2, F.col("theta2") * F.col("em1")).otherwise(F.lit(0.0)))
    yhat = (F.when(F.col("d") == 0, F.col("centre") + F.col("zhat")).when(F.col("d") == 1, F.col("ym") + F.col("zhat"))
            .otherwise(2 * F.col("ym") - F.col("ym1") + F.col("zhat")))
    valid = F.col("fit.ok") & stable & (F.col("E") >= F.size("pivots")) & (F.col("gaps") == 0)
    y_test = F.col("y_holdout") if upto == "train" else F.lit(None).cast("double")
    return fits.select(*key, "p", "d", "q", F.when(valid, _finite(yhat)).alias("forecast"), y_test.alias("y_test"))


def best_order(series: DataFrame, fits: DataFrame, by: Sequence[str] = ("country",)) -> DataFrame:
    """O3 + F5: per series, the order with the lowest squared error, first in (p, d, q)
    order on ties, with its forecast (the winner is not refitted).

    Failed fits get a NULL ordering key, which ``min_by`` skips; no filter is needed
    (a filter would be pushed into, and inflate, the closed-form projections)."""
    mse = F.pow(F.col("y_test") - F.col("forecast"), 2)
    key = F.when(mse.isNotNull(), F.struct(mse.alias("mse"), "p", "d", "q"))
    best = fits.groupBy(*by, "metric").agg(
        F.min_by(F.struct("p", "d", "q", "forecast", mse.alias("mse")), key).alias("b"))
    return best.filter(F.col("b").isNotNull()).select(*by, "metric", "b.p", "b.d", "b.q", "b.forecast", "b.mse")


def fit_orders(series: DataFrame, by: Sequence[str] = ("country",), orders: str = "all", upto: str = "train") -> DataFrame:
    """All fits: q = 0 by closed forms, plus q > 0 by two regressions when ``orders='all'``."""
    fits = ar_forecasts(series, by, upto)
    if orders == "all":
        fits = fits.unionByName(arma_forecasts(series, by, upto))
    elif orders != "ar":
        raise ValueError("orders must be 'all' or 'ar'")
    return fits


def next_week_forecast(series: DataFrame, by: Sequence[str] = ("country",), orders: str = "all",
                       refit: bool = False) -> DataFrame:
    """per series, the winning order's one-step forecast. ``refit=True`` refits the
    winning order on every point (holdout included) and forecasts the week after."""
    best = best_order(series, fit_orders(series, by, orders, "train"), by)
    if not refit:
        return best
    full = fit_orders(series, by, orders, "all").withColumnRenamed("forecast", "refit_forecast")
    return (best.join(full, [*by, "metric", "p", "d", "q"], "left")
            .withColumn("forecast", F.col("refit_forecast")).drop("refit_forecast"))


def forecast_table(weekly: DataFrame, countries: DataFrame, direction: str = "forward", orders: str = "all",
                   refit: bool = False) -> DataFrame:
    """F6 + F7: one row per country with the five forecasts (FIXTURES D8).

    A country with any metric unforecastable (no rows, too few points, every fit
    failed) gets zeros in all five and ``is_fallback = true``, as the reference does.
    """
    series = metric_series(weekly, direction)
    nxt = next_week_forecast(series, orders=orders, refit=refit)
    per_metric = nxt.select("country", "metric", "forecast")
    listed = countries.select("country", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("forecast"))
    # One aggregate over (forecasts + the country list): every country once, no join.
    out = per_metric.unionByName(listed).groupBy("country").pivot("metric", list(METRICS)).agg(F.max("forecast"))
    complete = F.lit(True)
    for m in METRICS:
        complete = complete & F.col(m).isNotNull()
    return out.select("country", *[F.when(complete, F.col(m)).otherwise(F.lit(0.0)).alias(m) for m in METRICS],
                      (~complete).alias("is_fallback"))
