import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ranks
from riskloom.operators.ranks import lower_half_flags


def hot_frame(spark, seed=4):
    rng = np.random.default_rng(seed)
    n_hot, n_cold = 6000, 300
    g = np.r_[np.zeros(n_hot, int), rng.integers(1, 30, n_cold)]
    v = np.round(rng.normal(size=n_hot + n_cold), 1)  # many ties
    v[rng.integers(0, len(v), 50)] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v, "k": np.arange(len(g))})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    return pdf, df.repartition(6)


def test_thresholds_of_a_hot_group_are_exact(spark):
    pdf, df = hot_frame(spark)
    found = ranks.value_thresholds(df, ["g"], ["v", "k"], lambda n: [F.lit(1).cast("long"), F.floor((n + 1) / 2).cast("long"), n])
    got = {(r["g"], r["which"], r["rank"]): (r["v"], r["n"], r["before"], r["at"]) for r in found.collect()}
    want = {}
    for g, grp in pdf.groupby("g"):
        for which, name in enumerate(["v", "k"]):
            vals = sorted(grp[name].tolist(), key=lambda x: (x != x, x))
            for rank in {1, (len(vals) + 1) // 2, len(vals)}:
                v = vals[rank - 1]
                same = [x for x in vals if x == v or (x != x and v != v)]
                want[g, which, rank] = (None if v != v else v, len(vals), vals.index(v) if v == v else len(vals) - len(same), len(same))
    assert got == want


def test_coarse_steps_keep_the_order_of_all_doubles(spark):
    rng = np.random.default_rng(1)
    vals = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), 1.0, -1.0, 0.1, 10.0]
    vals += (rng.normal(size=300) * 10.0 ** rng.integers(-200, 200, 300)).tolist()
    df = spark.createDataFrame([(x,) for x in vals], "v double").select("v", ranks.coarse_step(F.col("v")).alias("s"))
    steps = [r["s"] for r in df.orderBy("v").collect()]
    assert steps == sorted(steps) and len(set(steps)) > 200
    assert df.select(ranks.coarse_step(F.lit(None).cast("double")).alias("s")).first()["s"] is None


def test_weighted_counts_equal_the_rows(spark):
    _, df = hot_frame(spark, 6)
    cells = df.groupBy("g", "v").agg(F.count("*").alias("w"))
    half = lambda n: [F.floor((n + 1) / 2).cast("long")]
    a, b = ranks.value_thresholds(df, ["g"], ["v"], half), ranks.value_thresholds(cells, ["g"], ["v"], half, weight="w")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_two_flags_with_null_groups_and_doubled_keys(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ranks, "WINDOW_ROWS", window_rows)  # 0: all ties are dealt over ranges
    rng = np.random.default_rng(2)
    rows = [(int(g) if g else None, float(a) if a < 4 else None, float(b), i // 2) for i, (g, a, b) in
            enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 6, 900), rng.integers(0, 5, 900), strict=True))]
    df = spark.createDataFrame(rows, "g int, a double, b double, k int")
    flagged, (fa, fb) = lower_half_flags(df.repartition(5), ["g"], ["a", "b"], ["k"])
    got = flagged.groupBy("g").agg(F.count_if(fa).alias("a"), F.count_if(fb).alias("b"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and all(r["a"] == r["b"] == (r["n"] + 1) // 2 for r in got)
    # a key's two rows have other values, so only keys on the edge of a half are open to the hash of the row
    for name, flag in (("a", fa), ("b", fb)):
        for g in {r[0] for r in rows}:
            mine = [r for r in flagged.collect() if r["g"] == g]
            order = lambda r: (r[name] is None, r[name] or 0.0, r["k"])
            assert max(order(r) for r in mine if r[flag]) <= min(order(r) for r in mine if not r[flag])


def test_flags_match_window_under_skew(spark):
    _, df = hot_frame(spark, 9)
    a, (fa,) = lower_half_flags(df, ["g"], ["v"], ["k"], strategy="window")
    b, (fb,) = lower_half_flags(df, ["g"], ["v"], ["k"], strategy="counts")
    ra = sorted((r["k"], r[fa]) for r in a.select("k", fa).collect())
    rb = sorted((r["k"], r[fb]) for r in b.select("k", fb).collect())
    assert ra == rb


def test_repeated_rows_fill_halves_exactly(spark):
    rows = [(1, 5.0, 1)] * 4 + [(2, 1.0, 1)] * 3 + [(2, 1.0, 2), (2, None, 3)]
    df = spark.createDataFrame(rows, "g int, v double, k int")
    flagged, (flag,) = lower_half_flags(df, ["g"], ["v"], ["k"])
    got = {r["g"]: r["n"] for r in flagged.groupBy("g").agg(F.count_if(flag).alias("n")).collect()}
    assert got == {1: 2, 2: 3}


def test_flags_do_not_depend_on_optimizer_switches(spark):
    _, df = hot_frame(spark, 3)
    expected = None
    for reuse in ("true", "false"):
        for adaptive in ("true", "false"):
            before = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            try:
                out, (flag,) = lower_half_flags(df, ["g"], ["v"], ["k"])
                got = sorted((r["k"], r[flag]) for r in out.select("k", flag).collect())
            finally:
                for k, v in before.items():
                    spark.conf.set(k, v)
            expected = expected or got
            assert got == expected and len(got) == df.count()
