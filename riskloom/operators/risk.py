"""Country risk: the distance-map value of each forecast vector's best-matching unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.som import codebook_array, codebook_frame, som_bmu, som_features, som_umatrix
from riskloom.operators.weekly import METRICS


def country_risk(forecast: DataFrame, codebook: DataFrame, stats=None, key: Sequence[str] = ("country",),
                 cols: Sequence[str] = METRICS, scaling: str = "sum") -> DataFrame:
    """M5 + M6: one ``(country, distance)`` row per forecast row (FIXTURES D10).

    ``stats`` are the training feature statistics (None = unscaled, the reference); ``scaling`` is the distance map's.
    The distance map has one row per grid cell, so joining it is a bounded broadcast.
    """
    w = codebook_array(codebook)
    feats = som_features(forecast, key, cols, stats)
    um = som_umatrix(codebook_frame(forecast.sparkSession, w), scaling)
    scored = som_bmu(feats, w)
    return (scored.join(F.broadcast(um), (scored.bmu_x == um.x) & (scored.bmu_y == um.y), "left")
            .select(*key, F.col("u").alias("distance")))


def risk_outliers(risk: DataFrame, threshold: float = 0.75) -> DataFrame:
    """M7: countries outside the normal pattern, riskiest first."""
    return risk.filter(F.col("distance") >= F.lit(threshold)).orderBy(F.col("distance").desc(), "country")


def vectors_by_country(forecast: DataFrame, key: Sequence[str] = ("country",), cols: Sequence[str] = METRICS) -> DataFrame:
    """One row per forecast vector, keyed by country (no collect into lists)."""
    return som_features(forecast, key, cols, None)
