"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.

Each query reads the whole driver tables through ``riskloom.plans.fixtures`` and runs
one operator (or a short chain ending in it). Double columns are rounded to 6 places
so that the value hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.dates import parse_sqldate, week_of
from riskloom.operators import weekly as W
from riskloom.plans import fixtures as FX
from riskloom.plans import oracle_sql as S
from riskloom.session import materialize, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def _ev(spark, sf_dir):
    return FX.events(spark, sf_dir)


KEYCOLS = list(FX.EVENT_KEY)


# ------------------------------------------------------------------ weekly family

@register("weekly_metrics", S.weekly_sql(-2))
def q_weekly_metrics(spark, sf_dir):
    return rounded(W.weekly_metrics(_ev(spark, sf_dir), FX.AS_OF, -2, key=FX.EVENT_KEY))


@register("weekly_metrics_range", S.weekly_sql(-2))
def q_weekly_metrics_range(spark, sf_dir):
    """The same metrics with all rows at a threshold dealt over ranges, as very many would be."""
    return rounded(W.weekly_metrics(_ev(spark, sf_dir), FX.AS_OF, -2, key=FX.EVENT_KEY, strategy="ranges"))


@register("weekly_metrics_join", S.weekly_sql(-2))
def q_weekly_metrics_join(spark, sf_dir):
    return rounded(W.weekly_metrics_join(_ev(spark, sf_dir), FX.AS_OF, -2, key=FX.EVENT_KEY))


@register("weekly_metrics_global", S.weekly_sql(-4, by_country=False))
def q_weekly_metrics_global(spark, sf_dir):
    return rounded(W.weekly_metrics(_ev(spark, sf_dir), FX.AS_OF, -4, by=(), key=FX.EVENT_KEY))


@register("weekly_totals_country", S.weekly_sql(-2, with_centres=False))
def q_weekly_totals_country(spark, sf_dir):
    return W.weekly_totals(_ev(spark, sf_dir), FX.AS_OF, -2)


@register("weekly_totals_global", S.weekly_sql(-4, by_country=False, with_centres=False))
def q_weekly_totals_global(spark, sf_dir):
    return W.weekly_totals(_ev(spark, sf_dir), FX.AS_OF, -4, by=())


@register("lower_half_mean_country", S.weekly_sql(-2, with_totals=False))
def q_lower_half_mean_country(spark, sf_dir):
    return rounded(W.lower_half_mean(_ev(spark, sf_dir), FX.AS_OF, -2, key=FX.EVENT_KEY))


@register("lower_half_mean_global", S.weekly_sql(-4, by_country=False, with_totals=False))
def q_lower_half_mean_global(spark, sf_dir):
    return rounded(W.lower_half_mean(_ev(spark, sf_dir), FX.AS_OF, -4, by=(), key=FX.EVENT_KEY))


@register("weekly_median", S.weekly_median_sql(-2))
def q_weekly_median(spark, sf_dir):
    return rounded(W.weekly_median(_ev(spark, sf_dir), FX.AS_OF, -2))


@register("weekly_median_range", S.weekly_median_sql(-4))
def q_weekly_median_range(spark, sf_dir):
    """Medians of the longer training lookback by Spark's own aggregate, the literal twin."""
    return rounded(W.weekly_median(_ev(spark, sf_dir), FX.AS_OF, -4, strategy="window"))


@register("tone_halves", S.halves_sql("avg_tone"))
def q_tone_halves(spark, sf_dir):
    out = W.tone_halves(_ev(spark, sf_dir), "avg_tone", FX.AS_OF, -2, key=FX.EVENT_KEY)
    return out.select(*KEYCOLS, "country", "week", "half")


@register("goldstein_halves", S.halves_sql("goldstein"))
def q_goldstein_halves(spark, sf_dir):
    out = W.tone_halves(_ev(spark, sf_dir), "goldstein", FX.AS_OF, -2, key=FX.EVENT_KEY)
    return out.select(*KEYCOLS, "country", "week", "half")


@register("weekly_desc", S.weekly_sql(-2))
def q_weekly_desc(spark, sf_dir):
    return W.weekly_desc(q_weekly_metrics(spark, sf_dir))


# ------------------------------------------------------------------ projections / filters

@register("parse_sqldate", S.with_ev(f"SELECT {S.KEY}, sqldate, CAST(strptime(sqldate, '%Y%m%d') AS DATE) AS parsed FROM ev"))
def q_parse_sqldate(spark, sf_dir):
    return _ev(spark, sf_dir).select(*KEYCOLS, "sqldate", parse_sqldate("sqldate").alias("parsed"))


@register("week_of", S.with_ev(f"SELECT {S.KEY}, event_date, CAST(date_trunc('week', event_date) AS DATE) AS week FROM ev"))
def q_week_of(spark, sf_dir):
    return _ev(spark, sf_dir).select(*KEYCOLS, "event_date", week_of("event_date").alias("week"))


@register("lookback_filter", S.with_ev(
    f"SELECT {S.KEY}, event_date FROM ev WHERE event_date >= {S.start_sql(-2)} AND event_date <= DATE '{FX.AS_OF}'"))
def q_lookback_filter(spark, sf_dir):
    return W.lookback_filter(_ev(spark, sf_dir), FX.AS_OF, -2).select(*KEYCOLS, "event_date")


@register("root_code_filter", S.with_ev(f"SELECT {S.KEY}, root_code FROM ev WHERE TRY_CAST(root_code AS INTEGER) IN ({S.CODES})"))
def q_root_code_filter(spark, sf_dir):
    return W.root_code_filter(_ev(spark, sf_dir)).select(*KEYCOLS, "root_code")


@register("dropped_countries", S.with_ev("SELECT count(*) FILTER (WHERE country IS NULL) AS null_country, "
                                         "count(*) FILTER (WHERE country = '') AS empty_country FROM ev"))
def q_dropped_countries(spark, sf_dir):
    return W.dropped_countries(_ev(spark, sf_dir))


@register("one_country", S.with_ev(f"SELECT {S.KEY}, country, event_date FROM ev WHERE country = 'NATION_7'"))
def q_one_country(spark, sf_dir):
    return W.one_country(_ev(spark, sf_dir), "NATION_7").select(*KEYCOLS, "country", "event_date")


@register("distinct_countries", S.with_ev("SELECT DISTINCT country FROM ev WHERE country IS NOT NULL"))
def q_distinct_countries(spark, sf_dir):
    return W.distinct_countries(_ev(spark, sf_dir))


@register("recent_weeks", S.with_ev(
    f"SELECT DISTINCT CAST(date_trunc('week', event_date) AS DATE) AS week FROM ev "
    f"WHERE event_date >= {S.start_sql(-2)} AND event_date <= DATE '{FX.AS_OF}'"))
def q_recent_weeks(spark, sf_dir):
    return W.recent_weeks(_ev(spark, sf_dir), FX.AS_OF, -2)


# ------------------------------------------------------------------ forecast family

from riskloom.operators import forecast as FC  # noqa: E402


def _weekly(spark, sf_dir, months=-2):
    """Weekly metrics, materialised once (groups x weeks rows) for the model steps."""
    return materialize(W.weekly_metrics(_ev(spark, sf_dir), FX.AS_OF, months, key=FX.EVENT_KEY), "weekly")


def _series(spark, sf_dir, direction="forward"):
    return FC.metric_series(_weekly(spark, sf_dir), direction)


@register("metric_series", S.with_ctes(S.series_ctes(), "SELECT country, metric, week, round(y, 6) AS y FROM st"))
def q_metric_series(spark, sf_dir):
    return rounded(_series(spark, sf_dir).select("country", "metric", "week", "y"))


@register("holdout_split", S.with_ctes(S.series_ctes(),
                                       "SELECT country, metric, week, CAST(t AS INTEGER) AS t, t = n AS is_holdout FROM st"))
def q_holdout_split(spark, sf_dir):
    return _series(spark, sf_dir).select("country", "metric", "week", F.col("t").cast("int").alias("t"), "is_holdout")


@register("differenced_series", S.with_ctes(S.series_ctes(), """SELECT country, metric, CAST(t AS INTEGER) AS t,
  round(y, 6) AS y, round(y_lag1, 6) AS y_lag1, round(y_lag2, 6) AS y_lag2, round(y - y_lag1, 6) AS diff1,
  round(y - 2 * y_lag1 + y_lag2, 6) AS diff2 FROM sl"""))
def q_differenced_series(spark, sf_dir):
    d = FC.differenced_series(_series(spark, sf_dir))
    return rounded(d.select("country", "metric", F.col("t").cast("int").alias("t"), "y", "y_lag1", "y_lag2",
                            "diff1", "diff2"))


@register("order_grid", S.with_ctes(S.series_ctes(), """SELECT s.country, s.metric, a.p, b.d, c.q
  FROM (SELECT DISTINCT country, metric FROM st) s, (VALUES (0), (1), (2)) a(p), (VALUES (0), (1), (2)) b(d),
  (VALUES (0), (1), (2)) c(q)"""))
def q_order_grid(spark, sf_dir):
    keys = _series(spark, sf_dir).select("country", "metric").distinct()
    return FC.order_grid(keys)


@register("ar_forecasts", S.with_ctes(S.ar_ctes(), "SELECT country, metric, p, d, q, round(forecast, 6) AS forecast FROM fc"))
def q_ar_forecasts(spark, sf_dir):
    return rounded(FC.ar_forecasts(_series(spark, sf_dir)).drop("y_test"))


@register("arima_forecasts", S.with_ctes(S.ar_ctes() + S.arma_ctes(), "SELECT country, metric, p, d, q, round(forecast, 3) AS forecast FROM ma"))
def q_arima_forecasts(spark, sf_dir):
    """The q > 0 orders; three places, as the oracle solves the same regressions in another way."""
    return rounded(FC.arma_forecasts(_series(spark, sf_dir)).drop("y_test"), 3)


@register("best_order", S.with_ctes(S.best_ctes(), "SELECT country, metric, p, d, q, round(forecast, 6) AS forecast, "
                                                   "round(mse, 6) AS mse FROM bo"))
def q_best_order(spark, sf_dir):
    series = _series(spark, sf_dir)
    return rounded(FC.best_order(series, FC.ar_forecasts(series)))


@register("next_week_forecast", S.with_ctes(S.best_ctes(), "SELECT country, metric, round(forecast, 6) AS forecast FROM bo"))
def q_next_week_forecast(spark, sf_dir):
    return rounded(FC.next_week_forecast(_series(spark, sf_dir), orders="ar").select("country", "metric", "forecast"))


@register("forecast_table", S.forecast_table_sql())
def q_forecast_table(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    weekly = _weekly(spark, sf_dir)
    return rounded(FC.forecast_table(weekly, W.distinct_countries(ev), orders="ar"))


@register("forecast_table_all", S.forecast_table_sql(orders="all", digits=3))
def q_forecast_table_all(spark, sf_dir):
    """The default forecast: the winner of all 27 orders."""
    ev = _ev(spark, sf_dir)
    weekly = _weekly(spark, sf_dir)
    return rounded(FC.forecast_table(weekly, W.distinct_countries(ev)), 3)


# ------------------------------------------------------------------ SOM / risk family

from riskloom.operators import risk as RK  # noqa: E402
from riskloom.operators import som as SM  # noqa: E402


def _som_inputs(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    weekly = _weekly(spark, sf_dir)
    stats = SM.feature_stats(weekly)
    feats = SM.som_features(weekly, ["country", "week"], stats=stats)
    return ev, weekly, stats, feats


def _flat(df, col="v", prefix="f", n=5):
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(n)])


def _epoch1(spark, sf_dir):
    ev, weekly, stats, feats = _som_inputs(spark, sf_dir)
    cb0 = SM.som_init(feats, method="grid")
    return ev, weekly, stats, feats, cb0, SM.som_epoch(feats, cb0, sigma=1.0, rate=0.5)


@register("som_features", S.with_ctes(S.som_ctes(), "SELECT country, week, " +
                                      ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(5)) + " FROM feat"))
def q_som_features(spark, sf_dir):
    return rounded(_flat(_som_inputs(spark, sf_dir)[3]))


@register("som_bmu", S.with_ctes(S.som_ctes(), "SELECT country, week, bmu_x, bmu_y, round(d2, 6) AS d2 FROM bm"))
def q_som_bmu(spark, sf_dir):
    feats = _som_inputs(spark, sf_dir)[3]
    cb0 = SM.som_init(feats, method="grid")
    return rounded(SM.som_bmu(feats, cb0).drop("v"))


@register("som_epoch", S.with_ctes(S.som_ctes(), "SELECT x, y, " +
                                   ", ".join(f"round(w{i}, 6) AS w{i}" for i in range(5)) + " FROM cb1"))
def q_som_epoch(spark, sf_dir):
    return rounded(_flat(_epoch1(spark, sf_dir)[-1], "w", "w"))


@register("som_umatrix", S.with_ctes(S.som_ctes(), "SELECT x, y, round(u, 6) AS u FROM um"))
def q_som_umatrix(spark, sf_dir):
    return rounded(SM.som_umatrix(_epoch1(spark, sf_dir)[-1]))


@register("som_umatrix_mean", S.with_ctes(S.som_ctes() + S.mean_map_ctes(), "SELECT x, y, round(u, 6) AS u FROM umm"))
def q_som_umatrix_mean(spark, sf_dir):
    """The distance map by mean distances: neurons at the edge, with fewer neighbours, do not look calmer."""
    return rounded(SM.som_umatrix(_epoch1(spark, sf_dir)[-1], scaling="mean"))


def _risk(spark, sf_dir):
    ev, weekly, stats, feats, cb0, cb1 = _epoch1(spark, sf_dir)
    fc = materialize(FC.forecast_table(weekly, W.distinct_countries(ev), orders="ar"), "forecast")
    return RK.country_risk(fc, cb1, stats)


@register("country_risk", S.with_ctes(S.som_ctes(), "SELECT country, round(distance, 6) AS distance FROM fr"))
def q_country_risk(spark, sf_dir):
    return rounded(_risk(spark, sf_dir))


@register("risk_outliers", S.with_ctes(S.som_ctes(), "SELECT country, round(distance, 6) AS distance FROM fr "
                                                     "WHERE distance >= 0.5 ORDER BY distance DESC, country"))
def q_risk_outliers(spark, sf_dir):
    return rounded(RK.risk_outliers(_risk(spark, sf_dir), 0.5))


@register("vectors_by_country", S.with_ctes(S.som_ctes(), "SELECT country, " +
                                            ", ".join(f"round({m}, 6) AS v{i}" for i, m in enumerate(S.METRIC_NAMES)) +
                                            " FROM fo"))
def q_vectors_by_country(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    fc = FC.forecast_table(_weekly(spark, sf_dir), W.distinct_countries(ev), orders="ar")
    return rounded(_flat(RK.vectors_by_country(fc), "v", "v"))


_SOM_ROWS = ["sf AS (SELECT country || '|' || CAST(week AS VARCHAR) AS id, f0, f1, f2, f3, f4 FROM feat)"]


@register("som_init", S.with_ctes(S.som_ctes() + _SOM_ROWS + S.som_init_ctes("sf"), f"SELECT x, y, {S.WEIGHTS} FROM k0"))
def q_som_init(spark, sf_dir):
    """Random rows (by md5 and seed) as initial weights."""
    feats = _som_inputs(spark, sf_dir)[3]
    return rounded(_flat(SM.som_init(feats, seed=7, method="random", key=["country", "week"]), "w", "w"))


@register("som_train", S.with_ctes(S.som_ctes() + _SOM_ROWS + S.som_train_ctes("sf"), f"SELECT x, y, {S.WEIGHTS} FROM k10"))
def q_som_train(spark, sf_dir):
    """Ten batch epochs from random rows."""
    feats = _som_inputs(spark, sf_dir)[3]
    return rounded(_flat(SM.som_train(feats, epochs=10, seed=7, key=["country", "week"]), "w", "w"))


# ------------------------------------------------------------------ sourcing family

from riskloom.operators import sourcing as X  # noqa: E402


def _src(spark, sf_dir):
    """Requests are parsed once and the long offers written to the checkpoint folder,
    as a loading job would; risk is one row per country."""
    reqs = materialize(FX.requests(spark, sf_dir), "requests")
    offers = materialize(X.offers_long(reqs), "offers")
    return reqs, offers, materialize(FX.risk(spark, sf_dir), "risk"), X.request_budgets(reqs)


_OFFER_COLS = "request_id, item_pos, item, offer_pos, country, cost"


@register("parse_request", S.with_ctes(S.sourcing_ctes(), """SELECT bg.request_id, bg.risk_aversion,
  CAST(count(DISTINCT ol.item_pos) AS INTEGER) AS n_items FROM bg JOIN ol USING (request_id) GROUP BY ALL"""))
def q_parse_request(spark, sf_dir):
    p = X.parse_requests(FX.requests(spark, sf_dir))
    return p.select("request_id", F.col("req.risk_aversion").alias("risk_aversion"),
                    F.size("req.items").cast("int").alias("n_items"))


@register("offers_long", S.with_ctes(S.sourcing_ctes(), f"SELECT {_OFFER_COLS} FROM ol"))
def q_offers_long(spark, sf_dir):
    return _src(spark, sf_dir)[1]


@register("offers_dedup", S.with_ctes(S.sourcing_ctes(), f"SELECT {_OFFER_COLS} FROM o"))
def q_offers_dedup(spark, sf_dir):
    return X.offers_dedup(_src(spark, sf_dir)[1])


@register("cost_matrix", S.with_ctes(S.sourcing_ctes(), """
SELECT o.request_id, o.item_pos, CAST(c.k AS INTEGER) AS country_pos, o.cost
FROM o JOIN (SELECT request_id, country, row_number() OVER (PARTITION BY request_id ORDER BY country) - 1 AS k
             FROM (SELECT DISTINCT request_id, country FROM o) d) c USING (request_id, country)"""))
def q_cost_matrix(spark, sf_dir):
    return X.cost_matrix(_src(spark, sf_dir)[1])


@register("usable_offers", S.with_ctes(S.sourcing_ctes(), f"SELECT {_OFFER_COLS} FROM o WHERE cost > 0"))
def q_usable_offers(spark, sf_dir):
    return X.usable_offers(X.offers_dedup(_src(spark, sf_dir)[1]))


@register("risk_budget", S.with_ctes(S.sourcing_ctes(), "SELECT request_id, risk_aversion, budget FROM bg"))
def q_risk_budget(spark, sf_dir):
    return X.request_budgets(FX.requests(spark, sf_dir)).drop("valid")


@register("offer_risk", S.with_ctes(S.sourcing_ctes(), f"SELECT {_OFFER_COLS}, rk.distance FROM ol LEFT JOIN rk USING (country)"))
def q_offer_risk(spark, sf_dir):
    _, off, risk, _ = _src(spark, sf_dir)
    return X.offer_risk(off, risk).select(*_OFFER_COLS.split(", "), "distance")


@register("missing_risk", S.with_ctes(S.sourcing_ctes(),
                                      "SELECT DISTINCT ol.request_id, ol.country FROM ol LEFT JOIN rk USING (country) WHERE rk.distance IS NULL"))
def q_missing_risk(spark, sf_dir):
    _, off, risk, _ = _src(spark, sf_dir)
    return X.missing_risk(off, risk)


@register("missing_risk_status", S.with_ctes(S.sourcing_ctes(), """SELECT ol.request_id, list_sort(list(DISTINCT ol.country)) AS missing,
  'missing_risk' AS status FROM ol LEFT JOIN rk USING (country) WHERE rk.distance IS NULL GROUP BY ol.request_id"""))
def q_missing_risk_status(spark, sf_dir):
    _, off, risk, _ = _src(spark, sf_dir)
    return X.missing_risk_status(off, risk)


@register("request_status", S.with_ctes(S.sourcing_ctes(),
                                        "SELECT request_id, status, round(min_risk, 6) AS min_risk, budget FROM sts"))
def q_request_status(spark, sf_dir):
    _, off, risk, bud = _src(spark, sf_dir)
    return rounded(X.request_status(off, risk, bud))


@register("request_status_all", S.with_ctes(S.sourcing_ctes(), f"""
SELECT request_id, status, round(min_risk, 6) AS min_risk, budget FROM sts
UNION ALL
SELECT {FX.ODD_REQUESTS} + 10 * n_nationkey + k AS request_id,
  CASE k WHEN 0 THEN 'invalid_request' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'infeasible' WHEN 4 THEN 'invalid_request' ELSE 'missing_risk' END AS status,
  round(CASE k WHEN 1 THEN 0.0 WHEN 2 THEN 2 * distance WHEN 3 THEN distance WHEN 5 THEN 2 * distance END, 6) AS min_risk,
  CASE k WHEN 0 THEN 0.5 ELSE 0.75 END AS budget
FROM nation JOIN rk ON rk.country = n_name CROSS JOIN range(6) kinds(k)"""))
def q_request_status_all(spark, sf_dir):
    """All requests with those of unusual shape, in all four states; items without offers count."""
    reqs = materialize(FX.requests(spark, sf_dir).unionByName(FX.odd_requests(spark, sf_dir)), "requests")
    status = X.request_status(X.offers_long(reqs), FX.risk(spark, sf_dir), X.request_budgets(reqs), X.request_items(reqs))
    return rounded(status)


@register("cheapest_offer", S.with_ctes(S.sourcing_ctes(), """SELECT request_id, item_pos, item, country, cost, distance
  FROM (SELECT u0.*, row_number() OVER (PARTITION BY request_id, item_pos ORDER BY cost, distance, offer_pos) AS rn FROM u0) z
  WHERE rn = 1"""))
def q_cheapest_offer(spark, sf_dir):
    _, off, risk, _ = _src(spark, sf_dir)
    return X.cheapest_offer(off, risk)


@register("select_relaxed", S.relaxed_sql() + """
SELECT pk.request_id, pk.item_pos, pk.item, pk.country, pk.cost, pk.distance, bl.tc AS total_cost,
  round(bl.tr, 6) AS total_risk, round(lb.lower_bound, 3) AS lower_bound, round(bl.tc - lb.lower_bound, 3) AS gap
FROM pk JOIN bl ON pk.request_id = bl.request_id JOIN lb ON lb.request_id = pk.request_id""")
def q_select_relaxed(spark, sf_dir):
    _, off, risk, bud = _src(spark, sf_dir)
    out = X.select_relaxed(off, risk, bud)
    return rounded(out.withColumn("lower_bound", F.round("lower_bound", 3)).withColumn("gap", F.round("gap", 3)))


@register("select_exact", S.exact_sql() + "\nSELECT * FROM sel")
def q_select_exact(spark, sf_dir):
    _, off, risk, bud = _src(spark, sf_dir)
    return X.select_exact(off, risk, bud)


def _large_requests(spark, sf_dir):
    """One request per brand with all its parts, and a budget half way between the least risk and that of the cheapest choice."""
    parts = FX.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    numbered = parts.select("p_brand").distinct().withColumn("request_id", F.row_number().over(Window.orderBy("p_brand")).cast("long"))  # one row per brand
    brands = parts.join(numbered, "p_brand").select("p_partkey", "request_id")
    li = FX.offers(spark, sf_dir).filter("cost > 0 AND country <> 'UNSCORED'").withColumn("p_partkey", F.col("request_id") * 4 + F.col("item_pos"))
    li = li.groupBy("p_partkey", "country").agg(F.max_by("cost", "offer_pos").alias("cost"), F.min("offer_pos").alias("offer_pos"))
    offers = li.join(brands, "p_partkey")
    place = Window.partitionBy("request_id").orderBy("p_partkey")
    places = offers.select("request_id", "p_partkey").distinct().withColumn("item_pos", (F.row_number().over(place) - 1).cast("int"))
    offers = offers.join(places, ["request_id", "p_partkey"]).withColumn("item", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    offers = materialize(offers.select("request_id", "item_pos", "item", "offer_pos", "country", "cost"), "large-offers")
    risk = X.dedup_risk(FX.risk(spark, sf_dir))
    mils = offers.join(risk, "country").groupBy("request_id", "item_pos").agg(
        F.min(F.round(F.col("distance") * 1000)).alias("lo"), F.min_by(F.round(F.col("distance") * 1000), F.struct("cost", "distance")).alias("hi"))
    budgets = mils.groupBy("request_id").agg((F.floor((F.sum("lo") + F.sum("hi")) / 2) / 1000).alias("budget"))
    return offers, risk, materialize(budgets, "large-budgets")


@register("select_exact_large", S.exact_large_sql())
def q_select_exact_large(spark, sf_dir):
    """Least cost of requests with all parts of a brand, by the tree of partial fronts."""
    chosen = X.select_exact(*_large_requests(spark, sf_dir))
    return chosen.groupBy("request_id").agg(F.count("*").alias("n_items"), F.sum("cost").alias("total_cost"))


@register("recommendation", S.exact_sql() + "\nSELECT request_id, item_pos, item, country FROM sel")
def q_recommendation(spark, sf_dir):
    return X.recommendation(q_select_exact(spark, sf_dir))


@register("recommendation_json", S.exact_sql() + """
SELECT request_id, '[' || string_agg(CAST(json_object(item, country) AS VARCHAR), ',' ORDER BY item_pos) || ']' AS body FROM sel GROUP BY request_id""")
def q_recommendation_json(spark, sf_dir):
    """The JSON reply body of every answered request."""
    return X.recommendation_json(q_select_exact(spark, sf_dir))


@register("country_names", S.with_ctes(S.sourcing_ctes() + [f"dct AS ({S.DICTIONARY_SQL})"],
                                       "SELECT DISTINCT ol.country, coalesce(dct.name, ol.country) AS name FROM ol "
                                       "LEFT JOIN dct ON dct.code = ol.country"))
def q_country_names(spark, sf_dir):
    codes = _src(spark, sf_dir)[1].select("country").distinct()
    return X.country_names(codes, FX.dictionary(spark, sf_dir))


@register("country_code_of", f"SELECT name, arg_min(code, pos) AS code FROM ({S.DICTIONARY_SQL}) d GROUP BY name")
def q_country_code_of(spark, sf_dir):
    """The order that decides between two codes of a name is that of the dictionary's file."""
    return X.country_code_of(q_read_dictionary(spark, sf_dir))


@register("offers_named", S.with_ctes(S.sourcing_ctes() + [f"dct AS ({S.DICTIONARY_SQL})"],
                                      f"SELECT o.*, coalesce(dct.name, o.country) AS name FROM o LEFT JOIN dct ON dct.code = o.country"))
def q_offers_named(spark, sf_dir):
    return X.offers_named(_src(spark, sf_dir)[1], FX.dictionary(spark, sf_dir))


# ------------------------------------------------------------------ ingest sources and streaming

from riskloom.sources import buckets as SB  # noqa: E402
from riskloom.sources import files as SF  # noqa: E402
from riskloom.sources import links as SL  # noqa: E402
from riskloom.streaming import incremental as ST  # noqa: E402

# File layout of the fixture events: the five key columns, then the event fields.
FIXTURE_TSV_SCHEMA = T.StructType(
    [T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
     T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
     T.StructField("l_extendedprice", T.DoubleType())] + SF.EVENT_TSV_SCHEMA.fields[1:])
_FILE_COLS = [f.name for f in FIXTURE_TSV_SCHEMA.fields]
_FILE_SQL = S.with_ev("SELECT " + ", ".join(_FILE_COLS) + " FROM ev")

_LINKS_SQL = """links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM (
  SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) a) b)"""
_NEW_SQL = _LINKS_SQL + """, stored AS (SELECT DISTINCT href AS name FROM links WHERE page_id % 3 = 0),
nf AS (SELECT DISTINCT href AS name FROM links l WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.name = l.href))"""


def _pages(spark, sf_dir):
    return FX.table(spark, sf_dir, "pages")


def _listing(pages):
    """Every linked name; every third page's names are stored already."""
    links = SL.link_harvest(pages)
    return links.select(F.col("href").alias("name")), links.filter("page_id % 3 = 0").select(F.col("href").alias("name"))


def _new_files(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    listing, stored = _listing(pages)
    return SL.new_files(listing, stored)


@register("link_harvest", "WITH " + _LINKS_SQL + "\nSELECT page_id, pos, href, ends_with(href, 'ing') AS is_archive FROM links")
def q_link_harvest(spark, sf_dir):
    """The pages link to words, not archives; a suffix that some of them have stands for ``.zip``."""
    return SL.link_harvest(_pages(spark, sf_dir), "ing")


@register("new_files", "WITH " + _NEW_SQL + "\nSELECT name FROM nf")
def q_new_files(spark, sf_dir):
    return _new_files(spark, sf_dir)


@register("new_file_count", "WITH " + _NEW_SQL + "\nSELECT CAST(count(*) AS BIGINT) AS new_files FROM nf")
def q_new_file_count(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return SL.new_file_count(*_listing(pages))


@register("file_keys", "WITH " + _NEW_SQL + "\nSELECT name, 'landing/' || name AS key FROM nf")
def q_file_keys(spark, sf_dir):
    return SL.file_keys(_new_files(spark, sf_dir), "landing/")


@register("list_files", S.with_ev("""SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, CAST(1 AS BIGINT) AS n_files, true AS has_bytes
FROM ev GROUP BY ALL"""))
def q_list_files(spark, sf_dir):
    """A store with a folder per month of events, one file each: listed to the end, counted by folder."""
    path = work_path(spark, "store")
    months = _ev(spark, sf_dir).select(*_FILE_COLS, F.trunc("event_date", "month").alias("month"))
    months.repartition("month").sortWithinPartitions("month").write.partitionBy("month").parquet(path)
    listed = SL.list_files(spark, path, glob="*.parquet")
    month = F.regexp_extract("path", r"month=([0-9-]+)/", 1).cast("date").alias("month")
    return listed.groupBy(month).agg(F.count("*").alias("n_files"), (F.min("length") > 0).alias("has_bytes"))


def _written_tsv(spark, sf_dir):
    path = work_path(spark, "tsv")
    SF.write_tsv(_ev(spark, sf_dir), path, _FILE_COLS)
    return path


@register("load_events_tsv", _FILE_SQL)
def q_load_events_tsv(spark, sf_dir):
    return SF.read_tsv(spark, _written_tsv(spark, sf_dir), FIXTURE_TSV_SCHEMA).select(*_FILE_COLS)


@register("expand_archives", _FILE_SQL + " WHERE l_linenumber <> 7")
def q_expand_archives(spark, sf_dir):
    """Members by line number and a part of the orders, each in two archives (the first one's rows are older), of
    which those of line number 7 are expanded already."""
    path, ev = work_path(spark, "zip"), _ev(spark, sf_dir).select(*_FILE_COLS)
    member = F.concat_ws("-", F.lit("line"), "l_linenumber", F.col("l_orderkey") % 4)
    FX.write_archives(ev.withColumn("num_mentions", F.lit(0)), path, member, "a-")
    FX.write_archives(ev, path, member, "b-")
    done = ev.filter("l_linenumber = 7").select(F.concat(member, F.lit(".tsv")).alias("member")).distinct()
    lines = SF.expand_archives(spark, path, done)
    return SF.parse_lines(lines, FIXTURE_TSV_SCHEMA).select(*_FILE_COLS)


@register("archive_members", S.with_ev("""SELECT p || 'line-' || l_linenumber || '-' || l_orderkey % 4 || '.zip' AS archive,
  'line-' || l_linenumber || '-' || l_orderkey % 4 || '.tsv' AS member FROM ev, (VALUES ('a-'), ('b-')) v(p) GROUP BY ALL"""))
def q_archive_members(spark, sf_dir):
    """The directories of archives, without expanding them."""
    path, ev = work_path(spark, "zip"), _ev(spark, sf_dir).select(*_FILE_COLS)
    for prefix in ("a-", "b-"):
        FX.write_archives(ev, path, F.concat_ws("-", F.lit("line"), "l_linenumber", F.col("l_orderkey") % 4), prefix)
    return SF.archive_members(spark, path).select(F.substring_index("archive", "/", -1).alias("archive"), "member")


@register("load_manifest", _FILE_SQL)
def q_load_manifest(spark, sf_dir):
    """The folder also holds files that the manifest doesn't name: a second copy of all rows."""
    data = work_path(spark, "tsv")
    SF.write_tsv(_ev(spark, sf_dir), f"{data}/named", _FILE_COLS)
    SF.write_tsv(_ev(spark, sf_dir), f"{data}/other", _FILE_COLS)
    manifest = SF.write_manifest(spark, f"{data}/named", work_path(spark, "manifest"))
    return SF.load_manifest(spark, manifest, data, FIXTURE_TSV_SCHEMA).select(*_FILE_COLS)


@register("append_events", _FILE_SQL)
def q_append_events(spark, sf_dir):
    data = _written_tsv(spark, sf_dir)
    table = work_path(spark, "events-table")
    rows = SF.read_tsv(spark, data, FIXTURE_TSV_SCHEMA)
    SF.append_events(rows, table)
    SF.append_events(rows, table)  # the same files again: nothing is appended
    return SF.read_events(spark, table).select(*_FILE_COLS)


@register("refresh_table", _FILE_SQL)
def q_refresh_table(spark, sf_dir):
    root = work_path(spark, "refresh")
    ev = _ev(spark, sf_dir).select(*_FILE_COLS)
    SF.refresh_table(ev.withColumn("num_mentions", F.lit(0)), root)  # a filled version that the next one replaces
    SF.refresh_table(ev, root)
    return SF.read_current(spark, root)


@register("incremental_load", _FILE_SQL)
def q_incremental_load(spark, sf_dir):
    data = _written_tsv(spark, sf_dir)
    sink, chk = work_path(spark, "inc-sink"), work_path(spark, "inc-chk")
    ST.incremental_load(spark, data, sink, chk, FIXTURE_TSV_SCHEMA)
    again = ST.incremental_load(spark, data, sink, chk, FIXTURE_TSV_SCHEMA)  # nothing new: 0 rows
    if again:
        raise RuntimeError("incremental rerun loaded already-seen files")
    return spark.read.parquet(sink).select(*_FILE_COLS)


@register("weekly_totals_stream", """SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week,
  CAST(count(*) AS BIGINT) AS n_events, round(sum(value), 6) AS total_value FROM events GROUP BY ALL""")
def q_weekly_totals_stream(spark, sf_dir):
    schema = FX.table(spark, sf_dir, "events").schema
    stream = ST.events_stream(spark, sf_dir, schema, glob="events.parquet")
    sink, chk = work_path(spark, "wk-sink"), work_path(spark, "wk-chk")
    ST.weekly_totals_stream(spark, stream, sink, chk)
    return rounded(ST.current_weekly_totals(spark, sink).select("user_id", "week", "n_events", "total_value"))


@register("read_dictionary", S.DICTIONARY_SQL)
def q_read_dictionary(spark, sf_dir):
    """The code dictionary written as one JSON object and read back in its order."""
    path = SF.write_json_object(FX.dictionary(spark, sf_dir), work_path(spark, "dictionary"), "pos", "code", "name")
    return SF.read_dictionary(spark, path)


@register("codebook_roundtrip", S.with_ctes(S.som_ctes(), "SELECT x, y, " +
                                            ", ".join(f"round(w{i}, 6) AS w{i}" for i in range(5)) + " FROM cb1"))
def q_codebook_roundtrip(spark, sf_dir):
    cb1 = _epoch1(spark, sf_dir)[-1]
    path = SF.save_codebook(cb1, work_path(spark, "codebook"))
    return rounded(_flat(SF.load_codebook(spark, path), "w", "w"))


# ------------------------------------------------------------------ variants named in the survey

@register("forecast_table_reference", S.forecast_table_sql(direction="reference"))
def q_forecast_table_reference(spark, sf_dir):
    """The reference's order: newest week first, the oldest week is the holdout."""
    ev = _ev(spark, sf_dir)
    return rounded(FC.forecast_table(_weekly(spark, sf_dir), W.distinct_countries(ev), direction="reference", orders="ar"))


@register("weekly_metrics_median", S.with_ctes(
    [S.ev_cte(), S.filtered_cte(-2)],
    """SELECT country, week, CAST(SUM(num_mentions) AS BIGINT) AS total_mentions,
  CAST(SUM(num_sources) AS BIGINT) AS total_sources, CAST(SUM(num_articles) AS BIGINT) AS total_articles,
  round(median(avg_tone), 6) AS center_tone, round(median(goldstein), 6) AS center_goldstein
FROM f GROUP BY country, week"""))
def q_weekly_metrics_median(spark, sf_dir):
    """Weekly metrics with true medians as centres (every week kept)."""
    return rounded(W.weekly_metrics(_ev(spark, sf_dir), FX.AS_OF, -2, center="median", key=FX.EVENT_KEY))


@register("root_code_filter_strict", S.with_ev(
    f"SELECT {S.KEY}, root_code FROM ev WHERE root_code IN (" + ", ".join(f"'{c}'" for c in S.CODES.split(", ")) + ")"))
def q_root_code_filter_strict(spark, sf_dir):
    """The literal text comparison of root codes."""
    return W.root_code_filter(_ev(spark, sf_dir), strict=True).select(*KEYCOLS, "root_code")


@register("next_week_forecast_refit", S.with_ctes(
    S.best_ctes() + S.ar_fit_ctes("all", "_all"),
    """SELECT bo.country, bo.metric, round(fc_all.forecast, 6) AS forecast FROM bo
LEFT JOIN fc_all ON fc_all.country = bo.country AND fc_all.metric = bo.metric AND fc_all.p = bo.p AND fc_all.d = bo.d"""))
def q_next_week_forecast_refit(spark, sf_dir):
    """The winning order refitted on every point, forecasting the week after the holdout."""
    nxt = FC.next_week_forecast(_series(spark, sf_dir), orders="ar", refit=True)
    return rounded(nxt.select("country", "metric", "forecast"))


def _reference_codebook(spark, sf_dir):
    """The reference's training set-up: global weekly totals over four months, unscaled
    features, random training rows as initial weights (batch epochs instead of online steps)."""
    train = materialize(W.weekly_metrics(_ev(spark, sf_dir), FX.AS_OF, -4, by=(), key=FX.EVENT_KEY), "weekly-global")
    feats = SM.som_features(train, ["week"], stats=None)
    return SM.som_train(feats, epochs=10, seed=7, key=["week"])


@register("som_train_reference", S.with_ctes(S.reference_train_ctes() + S.som_train_ctes("gf"), f"SELECT x, y, {S.WEIGHTS.replace(', 6)', ', 3)')} FROM k10"))
def q_som_train_reference(spark, sf_dir):
    """SOM trained as the reference does (global grain, unscaled; three places of values in the thousands)."""
    return rounded(_flat(_reference_codebook(spark, sf_dir), "w", "w"), 3)


@register("country_risk_reference", S.reference_risk_sql())
def q_country_risk_reference(spark, sf_dir):
    """Per-country forecasts scored, unscaled, against the global-grain codebook."""
    ev = _ev(spark, sf_dir)
    fc = materialize(FC.forecast_table(_weekly(spark, sf_dir), W.distinct_countries(ev), orders="ar"), "forecast")
    return rounded(RK.country_risk(fc, _reference_codebook(spark, sf_dir), stats=None))


@register("weekly_metrics_stream", S.weekly_sql(-2))
def q_weekly_metrics_stream(spark, sf_dir):
    """Weekly metrics maintained from a stream of event files (four micro-batches of as many
    files, in event-date order), compared with the batch oracle."""
    src = work_path(spark, "ev-files")
    ev = _ev(spark, sf_dir)
    per_batch = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # files: more when tasks are to be more
    ev.repartitionByRange(4 * per_batch, "event_date", *KEYCOLS).write.mode("overwrite").parquet(src)
    stream = ST.events_stream(spark, src, ev.schema, files_per_batch=per_batch)
    state, metrics = work_path(spark, "wk-state"), work_path(spark, "wk-metrics")
    ST.weekly_metrics_stream(spark, stream, state, metrics, work_path(spark, "wk-chk"), FX.AS_OF, -2, key=FX.EVENT_KEY)
    out = spark.read.parquet(metrics)
    return rounded(out.select("country", "week", "total_mentions", "total_sources", "total_articles",
                              "center_tone", "center_goldstein"))


@register("weekly_metrics_stored", S.weekly_sql(-2))
def q_weekly_metrics_stored(spark, sf_dir):
    """Events loaded from TSV into the week-partitioned event table, then weekly metrics
    over it: the lookback reads only its weeks' folders."""
    data = _written_tsv(spark, sf_dir)
    table = work_path(spark, "event-table")
    SF.store_events(SF.read_tsv(spark, data, FIXTURE_TSV_SCHEMA), table)
    stored = SF.read_events(spark, table)
    return rounded(W.weekly_metrics(stored, FX.AS_OF, -2, key=FX.EVENT_KEY))


def _bucketed(spark, sf_dir):
    root = work_path(spark, "event-buckets")
    SB.store_bucketed(_ev(spark, sf_dir), root, buckets=8)
    return SB.read_bucketed(spark, root)


@register("weekly_totals_bucketed", S.weekly_sql(-2, with_centres=False))
def q_weekly_totals_bucketed(spark, sf_dir):
    """Weekly totals over events stored in buckets of (country, week): no exchange."""
    return W.weekly_totals(_bucketed(spark, sf_dir), FX.AS_OF, -2)


@register("weekly_metrics_bucketed", S.weekly_sql(-2))
def q_weekly_metrics_bucketed(spark, sf_dir):
    """Weekly metrics over the same layout, halves by window: no exchange either."""
    return rounded(W.weekly_metrics(_bucketed(spark, sf_dir), FX.AS_OF, -2, key=FX.EVENT_KEY, strategy="window"))
