"""End to end: events -> weekly metrics -> forecasts -> SOM -> risk -> sourcing decisions.

One Spark application instead of the reference's chain of functions and polling
clients. Only small derived tables are materialised (written as Parquet into the
session's shared checkpoint folder): weekly metrics (groups x weeks), forecasts
(one row per country) and risk (one row per country). The event table is scanned
by the weekly plans only; requests are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from riskloom.operators import forecast as FC
from riskloom.operators import risk as RK
from riskloom.operators import som as SM
from riskloom.operators import sourcing as X
from riskloom.operators import weekly as W
from riskloom.session import ensure_checkpoint_dir, materialize


@dataclass
class NightlyResult:
    weekly: DataFrame
    forecast: DataFrame
    codebook: DataFrame
    risk: DataFrame
    status: DataFrame
    selection: DataFrame
    recommendation: DataFrame


def run_nightly(events: DataFrame, requests: DataFrame, as_of, key=("event_id",), forecast_months: int = -2,
        train_months: int = -4, grain: str = "country", scale: str = "zscore", direction: str = "forward",
        orders: str = "all", epochs: int = 10, seed: int = 0, exact: bool = True) -> NightlyResult:
    """``grain='global', scale='none'`` trains the SOM on global weekly totals, unscaled,
    as the reference does; the defaults train on per-country weeks, z-scored."""
    ensure_checkpoint_dir(events.sparkSession)
    weekly = materialize(W.weekly_metrics(events, as_of, forecast_months, key=key), "weekly")
    fc = materialize(FC.forecast_table(weekly, W.distinct_countries(events), direction=direction, orders=orders), "forecast")
    by = ("country",) if grain == "country" else ()
    train = materialize(W.weekly_metrics(events, as_of, train_months, by=by, key=key), "weekly-train")
    stats = SM.feature_stats(train) if scale == "zscore" else None
    feats = SM.som_features(train, [*by, "week"], stats=stats)
    codebook = SM.som_train(feats, epochs=epochs, seed=seed, key=[*by, "week"])
    risk = materialize(RK.country_risk(fc, codebook, stats), "risk")
    offers, items, budgets = X.offers_long(requests), X.request_items(requests), X.request_budgets(requests)
    status = X.request_status(offers, risk, budgets, items)
    selection = (X.select_exact if exact else X.select_relaxed)(offers, risk, budgets, items)
    return NightlyResult(weekly, fc, codebook, risk, status, selection, X.recommendation_json(selection))
