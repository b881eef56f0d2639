"""Self-organising map on weekly feature vectors, and the distance map used as risk.

The reference trains an online SOM (5 x 5 grid, sigma 1.0, learning rate 0.5, 100
single-sample steps, random rows as initial weights) and scores a vector by the
normalised distance-map value of its best-matching unit. Online and batch SOM are
different algorithms with the same purpose; this module trains a **batch** SOM,
which distributes: per epoch the codebook (25 x 5 numbers, model state) is
shipped inside the plan as a literal, every vector finds its best-matching unit
with JVM-side array expressions, and one ``groupBy(bmu)`` sums counts and vectors.
Only those at most 25 partial sums reach the driver, where the Gaussian
neighbourhood smoothing is applied. The data never leaves the executors.

Codebook schema (FIXTURES D9): ``x int, y int, w array<double>``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.vectors import euclid, sq_distance
from riskloom.operators.weekly import METRICS
from riskloom.session import materialize

CODEBOOK_SCHEMA = T.StructType([T.StructField("x", T.IntegerType(), False),
                                T.StructField("y", T.IntegerType(), False),
                                T.StructField("w", T.ArrayType(T.DoubleType(), False), False)])
# The eight neighbour offsets of a rectangular grid.
NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


# ------------------------------------------------------------------ features (M1)

def feature_stats(df: DataFrame, cols: Sequence[str] = METRICS) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation per feature: model parameters, one row."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                 *[F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0)) for c in cols}


def som_features(df: DataFrame, key: Sequence[str], cols: Sequence[str] = METRICS,
                 stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``(key..., v array<double>)``. Unscaled when ``stats`` is None (the reference);
    z-scored with the given training statistics otherwise (a zero spread leaves 0)."""
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        if stats is not None:
            mean, sd = stats[c]
            x = (x - F.lit(mean)) / F.lit(sd) if sd > 0 else F.lit(0.0)
        parts.append(x)
    return df.select(*key, F.array(*parts).alias("v"))


# ------------------------------------------------------------------ codebook helpers

def codebook_frame(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    gx, gy, _ = weights.shape
    rows = [(int(i), int(j), [float(v) for v in weights[i, j]]) for i in range(gx) for j in range(gy)]
    return spark.createDataFrame(rows, CODEBOOK_SCHEMA)


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """Collect the codebook (model state: grid cells x dimensions) into numpy."""
    rows = codebook.collect()
    gx = max(r["x"] for r in rows) + 1
    gy = max(r["y"] for r in rows) + 1
    out = np.zeros((gx, gy, len(rows[0]["w"])))
    for r in rows:
        out[r["x"], r["y"]] = r["w"]
    return out


def _literal(weights: np.ndarray) -> Column:
    gx, gy, _ = weights.shape
    return F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"),
                              F.array(*[F.lit(float(v)) for v in weights[i, j]]).alias("w"))
                     for i in range(gx) for j in range(gy)])


# ------------------------------------------------------------------ initialisation (M2)

def som_init(features: DataFrame, grid=(5, 5), seed: int = 0, method: str = "random",
             key: Sequence[str] | None = None) -> DataFrame:
    """Initial codebook.

    ``random``: the reference's random-rows init made deterministic: rows ranked by the md5 of
    their key's text and the seed, the first grid-size rows taken (a bounded top-k), cycled
    when there are fewer rows. ``grid``: a regular spread over each feature's
    min..max (x drives even features, y odd ones); reproducible in SQL.
    """
    spark = features.sparkSession
    gx, gy = grid
    features = complete_vectors(features)
    if method == "random":
        key = list(key or [c for c in features.columns if c != "v"])
        picked = (features.withColumn("_h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(seed))))
                  .orderBy("_h", *key).limit(gx * gy).select("v").collect())
        if not picked:
            raise ValueError("no training rows")
        vecs = [r["v"] for r in picked]
        w = np.array([vecs[i % len(vecs)] for i in range(gx * gy)], dtype=float).reshape(gx, gy, -1)
        return codebook_frame(spark, w)
    if method == "grid":
        dim = len(features.select("v").first()["v"])
        row = features.agg(*[F.min(F.col("v")[j]).alias(f"lo{j}") for j in range(dim)],
                           *[F.max(F.col("v")[j]).alias(f"hi{j}") for j in range(dim)]).first()
        w = np.zeros((gx, gy, dim))
        for i in range(gx):
            for j in range(gy):
                for k in range(dim):
                    lo, hi = row[f"lo{k}"], row[f"hi{k}"]
                    frac = (i + 0.5) / gx if k % 2 == 0 else (j + 0.5) / gy
                    w[i, j, k] = lo + (hi - lo) * frac
        return codebook_frame(spark, w)
    raise ValueError("method must be 'random' or 'grid'")


# ------------------------------------------------------------------ best-matching unit

def _complete() -> Column:
    return F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def complete_vectors(features: DataFrame) -> DataFrame:
    """Vectors a map can be trained on: those without a NULL or NaN component."""
    return features.filter(_complete())


def incomplete_count(features: DataFrame) -> DataFrame:
    """How many vectors training leaves out (one row)."""
    return features.agg(F.count_if(~_complete()).alias("incomplete_vectors"))


def som_bmu(features: DataFrame, codebook: DataFrame | np.ndarray) -> DataFrame:
    """Add ``bmu_x, bmu_y, d2``: the nearest neuron, lowest x then y on ties; all three are
    NULL for a vector with a missing component.
    A narrow projection: the codebook travels inside the expression, no join."""
    w = codebook if isinstance(codebook, np.ndarray) else codebook_array(codebook)
    cands = F.transform(_literal(w), lambda n: F.struct(sq_distance(F.col("v"), n["w"]).alias("d2"),
                                                        n["x"].alias("x"), n["y"].alias("y")))
    best = F.when(_complete(), F.array_min(cands))
    return features.withColumn("_b", best).select(
        "*", F.col("_b.x").alias("bmu_x"), F.col("_b.y").alias("bmu_y"), F.col("_b.d2").alias("d2")).drop("_b")


# ------------------------------------------------------------------ training

def bmu_sums(features: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per neuron: number of vectors it wins and their component sums (one partial aggregate)."""
    dim = weights.shape[2]
    return (som_bmu(complete_vectors(features), weights).groupBy("bmu_x", "bmu_y")
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(dim)]))


def _smooth(weights: np.ndarray, sums: list, sigma: float, rate: float) -> np.ndarray:
    gx, gy, dim = weights.shape
    num = np.zeros((gx, gy, dim))
    den = np.zeros((gx, gy))
    xs, ys = np.meshgrid(np.arange(gx), np.arange(gy), indexing="ij")
    for r in sums:
        h = np.exp(-((xs - r["bmu_x"]) ** 2 + (ys - r["bmu_y"]) ** 2) / (2.0 * sigma * sigma))
        den += h * r["n"]
        num += h[:, :, None] * np.array([r[f"s{k}"] for k in range(dim)])[None, None, :]
    target = np.where(den[:, :, None] > 0, num / np.where(den > 0, den, 1.0)[:, :, None], weights)
    return weights + rate * (target - weights)


def som_epoch(features: DataFrame, codebook: DataFrame, sigma: float = 1.0, rate: float = 0.5) -> DataFrame:
    """One batch epoch from a given codebook: w += rate * (smoothed batch mean - w)."""
    w = codebook_array(codebook)
    sums = bmu_sums(features, w).collect()  # at most grid-size rows
    return codebook_frame(features.sparkSession, _smooth(w, sums, sigma, rate))


def som_train(features: DataFrame, grid=(5, 5), sigma: float = 1.0, rate: float = 0.5, epochs: int = 10,
              seed: int = 0, init: str = "random", key: Sequence[str] | None = None) -> DataFrame:
    """Batch SOM. Sigma and rate decay as sigma / (1 + t / (T / 2)) per epoch.

    Features are written once as a table in the shared checkpoint folder (they are read once
    per epoch; a lost executor then costs a re-read, not a recomputation).
    """
    feats = materialize(complete_vectors(features), "som-features")
    codebook = som_init(feats, grid, seed, init, key)
    w = codebook_array(codebook)
    half = max(epochs / 2.0, 1e-9)
    for t in range(epochs):
        decay = 1.0 / (1.0 + t / half)
        sums = bmu_sums(feats, w).collect()
        w = _smooth(w, sums, sigma * decay, rate * decay)
    return codebook_frame(features.sparkSession, w)


def quantization_error(features: DataFrame, codebook: DataFrame) -> float:
    row = som_bmu(features, codebook).agg(F.avg(F.sqrt("d2")).alias("q")).first()
    return float(row["q"] or 0.0)


# ------------------------------------------------------------------ distance map (M4)

def som_umatrix(codebook: DataFrame, scaling: str = "sum") -> DataFrame:
    """Per neuron the summed (``scaling="mean"``: mean) distance to its (up to 8) grid neighbours,
    divided by the largest such value (all-equal weights give 0, never NaN). An equi-join on
    shifted coordinates of the grid-size codebook."""
    if scaling not in ("sum", "mean"):
        raise ValueError("scaling is 'sum' or 'mean'")
    measure = F.sum if scaling == "sum" else F.avg
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NEIGHBOURS])
    a = codebook.select("x", "y", F.col("w").alias("wa"), F.explode(offs).alias("o")).select(
        "x", "y", "wa", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    b = codebook.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("w").alias("wb"))
    sums = a.join(b, ["nx", "ny"]).groupBy("x", "y").agg(measure(euclid("wa", "wb")).alias("u_sum"))
    # The window spans the grid (25 rows), not data.
    top = F.max("u_sum").over(Window.partitionBy(F.lit(1)))
    return sums.select("x", "y", F.when(top > 0, F.col("u_sum") / top).otherwise(F.lit(0.0)).alias("u"))
