"""Array<double> vector expressions, evaluated JVM-side with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sq_distance(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def euclid(a, b) -> Column:
    return F.sqrt(sq_distance(a, b))
