import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import som as SM
from riskloom.operators import sourcing as X


def feats(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(n)]
    return spark.createDataFrame(data, "k long, v array<double>")


def test_som_train_invariants(spark):
    f = feats(spark)
    a = SM.codebook_array(SM.som_train(f, epochs=5, seed=3, key=["k"]))
    b = SM.codebook_array(SM.som_train(f, epochs=5, seed=3, key=["k"]))
    # equal up to the order of distributed double sums
    assert a.shape == (5, 5, 5) and np.allclose(a, b, rtol=0, atol=1e-9)
    data = np.array([r["v"] for r in f.collect()])
    assert (a >= data.min(axis=0) - 1e-9).all() and (a <= data.max(axis=0) + 1e-9).all()


def test_kmeans_limit_error_never_rises(spark):
    f = feats(spark, 80, 5)
    cb = SM.som_init(f, seed=2, key=["k"])
    errs = [SM.quantization_error(f, cb)]
    for _ in range(4):
        cb = SM.som_epoch(f, cb, sigma=1e-3, rate=1.0)
        errs.append(SM.quantization_error(f, cb))
    assert all(b <= a + 1e-9 for a, b in zip(errs, errs[1:]))


def test_umatrix_equal_weights_is_zero(spark):  # E18
    cb = SM.codebook_frame(spark, np.ones((5, 5, 5)))
    for scaling in ("sum", "mean"):
        assert {r["u"] for r in SM.som_umatrix(cb, scaling).collect()} == {0.0}
    with pytest.raises(ValueError):
        SM.som_umatrix(cb, "max")


def test_umatrix_mean_counts_each_neighbour_once(spark):
    w = np.zeros((5, 5, 5))
    w[:, :, 0] = np.arange(5)[:, None]  # neighbours in the next row lie 1 apart
    u = {(r.x, r.y): r.u for r in SM.som_umatrix(SM.codebook_frame(spark, w), "mean").collect()}
    assert u[2, 0] == 1.0  # 4 of 5 neighbours, the largest mean
    assert u[2, 2] == pytest.approx(6 / 8 / 0.8) and u[0, 0] == pytest.approx(2 / 3 / 0.8) and u[0, 2] == pytest.approx(3 / 5 / 0.8)


def test_bmu_tie_lowest_x_then_y(spark):  # E19
    w = np.full((5, 5, 2), 9.0)
    w[1, 3] = [1.0, 1.0]  # two neurons equally near the vector
    w[3, 1] = [1.0, 1.0]
    f = spark.createDataFrame([(1, [1.0, 1.0])], "k long, v array<double>")
    r = SM.som_bmu(f, w).first()
    assert (r["bmu_x"], r["bmu_y"]) == (1, 3)


# ------------------------------------------------------------------ sourcing

def request_json(items, appetite):
    import json
    return json.dumps({"items": [{name: [{c: v} for c, v in offs]} for name, offs in items], "risk_aversion": appetite})


def req_df(spark, reqs):
    return spark.createDataFrame([(i, request_json(it, ap)) for i, (it, ap) in enumerate(reqs)], "request_id long, json string")


def risk_df(spark, risk):
    return spark.createDataFrame(list(risk.items()), "country string, distance double")


def brute(items, risk, budget):
    best = None
    usable = [[(j, c, v) for j, (c, v) in enumerate(offs) if v > 0] for _, offs in items]
    for combo in itertools.product(*usable):
        r = 0.0
        for _, c, _ in combo:
            r += risk[c]
        if r > budget + 1e-9:
            continue
        key = (sum(v for _, _, v in combo), r, tuple(j for j, _, _ in combo))
        if best is None or key < best[0]:
            best = (key, [c for _, c, _ in combo])
    return best


def test_exact_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    countries = [f"C{i}" for i in range(8)]
    risk = {c: float(rng.integers(0, 200)) / 1000 for c in countries}
    reqs = []
    for _ in range(25):
        items = []
        for k in range(int(rng.integers(1, 5))):
            cs = rng.choice(countries, size=int(rng.integers(1, 6)), replace=False)
            items.append((f"item{k}", [(c, float(rng.integers(1, 30))) for c in cs]))
        reqs.append((items, ["Low", "Medium", "High"][int(rng.integers(0, 3))]))
    rq = req_df(spark, reqs)
    off, rk, bud = X.offers_long(rq), risk_df(spark, risk), X.request_budgets(rq)
    got = {}
    for r in X.select_exact(off, rk, bud).collect():
        got.setdefault(r["request_id"], {})[r["item_pos"]] = r["country"]
    relaxed = {r["request_id"]: r["total_cost"] for r in X.select_relaxed(off, rk, bud).collect()}
    cheap = {}
    for r in X.cheapest_offer(off, rk).collect():
        cheap[r["request_id"]] = cheap.get(r["request_id"], 0.0) + r["cost"]
    for i, (items, ap) in enumerate(reqs):
        budget = {"Low": 0.75, "Medium": 0.5, "High": 0.25}[ap]
        b = brute(items, risk, budget)
        if b is None:
            assert i not in got
            continue
        assert [got[i][k] for k in range(len(items))] == b[1]
        assert b[0][0] >= cheap[i] - 1e-9          # X8 cost >= X10 cost
        assert relaxed[i] >= b[0][0] - 1e-9        # X8 <= X9, and every ok request has a row
        assert b[0][1] <= budget + 1e-9            # never above budget


def random_requests(seed, n, most_items, countries=8):
    rng = np.random.default_rng(seed)
    names = [f"C{i}" for i in range(countries)]
    risk = {c: float(rng.integers(0, 60)) / 1000 for c in names}
    reqs = []
    for _ in range(n):
        items = [(f"item{k}", [(c, float(rng.integers(1, 60))) for c in rng.choice(names, size=int(rng.integers(1, 6)), replace=False)])
                 for k in range(int(rng.integers(1, most_items)))]
        reqs.append((items, ["Low", "Medium", "High"][int(rng.integers(0, 3))]))
    return reqs, risk


def totals(selection):
    out = {}
    for r in selection.collect():
        c, n, d = out.get(r["request_id"], (0.0, 0, 0.0))
        out[r["request_id"]] = c + r["cost"], n + 1, d + r["distance"]
    return out


@pytest.mark.parametrize("group", [1, 2, 3])
def test_tree_of_fronts_equals_one_task(spark, monkeypatch, group):
    reqs, risk = random_requests(group, 70, 24)
    rq = req_df(spark, reqs)
    off, rk, bud = X.offers_long(rq), risk_df(spark, risk), X.request_budgets(rq)
    one = totals(X.select_exact(off, rk, bud))
    monkeypatch.setattr(X, "GROUP_ITEMS", group)
    monkeypatch.setattr(X, "PAIRS_AT_ONCE", 50)
    tree = totals(X.select_exact(off, rk, bud))
    assert len(one) > 30 and tree.keys() == one.keys()
    for i, (cost, n, distance) in one.items():
        assert tree[i][:2] == (pytest.approx(cost), n) and n == len(reqs[i][0])
        assert tree[i][2] <= {"Low": 0.75, "Medium": 0.5, "High": 0.25}[reqs[i][1]] + 1e-9


def test_exact_selection_of_a_huge_request(spark):
    n = 20_000
    nth = F.col("id") % n
    offers = spark.range(4 * n).select(F.lit(1).cast("long").alias("request_id"), nth.cast("int").alias("item_pos"), F.concat(F.lit("i"), nth).alias("item"),
                                       F.floor(F.col("id") / n).cast("int").alias("offer_pos"))
    offers = offers.withColumn("country", F.concat(F.lit("C"), F.pmod(F.xxhash64("item_pos", "offer_pos"), F.lit(97)).cast("string")))
    offers = offers.withColumn("cost", (1 + F.pmod(F.xxhash64("offer_pos", "item_pos", F.lit(1)), F.lit(10_000))).cast("double"))
    risk = spark.range(97).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("country"), ((F.col("id") * 37 % 97) / 2_000_000).alias("distance"))
    budgets = spark.createDataFrame([(1, 0.25)], "request_id long, budget double")
    chosen = X.select_exact(offers, risk, budgets)
    cost, items, distance = totals(chosen)[1]
    bound = X.select_relaxed(offers, risk, budgets).select("lower_bound", "total_cost").first()
    assert items == n and distance <= 0.25 + 1e-9
    assert bound["lower_bound"] - 1e-6 <= cost <= bound["total_cost"] + 1e-6


def test_null_scores_and_odd_costs(spark):
    rq = raw_df(spark, [
        '{"items": [{"A": [{"C4": 1.0}]}], "risk_aversion": "Low"}',                     # C4's only score is NULL
        '{"items": [{"A": [{"C4": 1.0}, {"C1": 5.0}]}], "risk_aversion": "Low"}',
        '{"items": [{"A": [{"C1": "NaN"}, {"C2": 3.0}]}], "risk_aversion": "Low"}',
        '{"items": [{"A": [{"C1": "Infinity"}]}], "risk_aversion": "Low"}',
        '{"items": [{"A": [{"C5": 2.0}]}], "risk_aversion": "Low"}'])                    # a NULL and a real score
    risk = spark.createDataFrame([("C1", 0.1), ("C2", 0.1), ("C4", None), ("C5", None), ("C5", 0.2), ("C6", float("nan"))], "country string, distance double")
    off, bud = X.offers_long(rq), X.request_budgets(rq)
    st = {r["request_id"]: r["status"] for r in X.request_status(off, risk, bud, X.request_items(rq)).collect()}
    assert st == {0: "missing_risk", 1: "missing_risk", 2: "ok", 3: "infeasible", 4: "ok"}
    assert sorted(map(tuple, X.missing_risk(off, risk).collect())) == [(0, "C4"), (1, "C4")]
    for select in (X.select_exact, X.select_relaxed):
        assert sorted((r["request_id"], r["country"], r["cost"]) for r in select(off, risk, bud).collect()) == [(2, "C2", 3.0), (4, "C5", 2.0)]


def test_dedup_rules(spark):  # E13
    reqs = [([("A", [("C1", 5.0), ("C2", 7.0), ("C1", 9.0)]), ("B", [("C3", 1.0)]), ("A", [("C4", 2.0)])], "Low")]
    d = X.offers_dedup(X.offers_long(req_df(spark, reqs))).collect()
    by_pos = {}
    for r in d:
        by_pos.setdefault(r["item_pos"], set()).add((r["country"], r["cost"]))
    assert by_pos[0] == {("C4", 2.0)} and by_pos[2] == {("C4", 2.0)} and by_pos[1] == {("C3", 1.0)}
    plain = X.offers_dedup(X.offers_long(req_df(spark, [([("A", [("C1", 5.0), ("C1", 9.0)])], "Low")]))).collect()
    assert [(r["country"], r["cost"]) for r in plain] == [("C1", 9.0)]


def test_status_edges(spark):  # E14, E15, E16, E17
    reqs = [([("A", [("C1", 0.0), ("C2", -3.0)])], "Low"),          # no usable offer
            ([("A", [("C1", 4.0), ("ZZ", 1.0)])], "Low"),           # ZZ has no risk
            ([("A", [("C1", 4.0)]), ("B", [("C2", 2.0)])], "High"),  # 0.125 + 0.125 == 0.25
            ([("A", [("C3", 4.0)])], "medium")]                      # lower case -> 0.5
    risk = {"C1": 0.125, "C2": 0.125, "C3": 0.5}
    rq = req_df(spark, reqs)
    st = {r["request_id"]: (r["status"], r["budget"]) for r in
          X.request_status(X.offers_long(rq), risk_df(spark, risk), X.request_budgets(rq)).collect()}
    assert st[0][0] == "infeasible" and st[1][0] == "missing_risk" and st[2][0] == "ok"
    assert st[3] == ("ok", 0.5)
    miss = X.missing_risk_status(X.offers_long(rq), risk_df(spark, risk)).collect()
    assert [(r["request_id"], r["missing"]) for r in miss] == [(1, ["ZZ"])]


def test_recommendation_json(spark):
    reqs = [([("A", [("C1", 4.0)]), ("B", [("C2", 2.0)])], "Low")]
    rq = req_df(spark, reqs)
    sel = X.select_exact(X.offers_long(rq), risk_df(spark, {"C1": 0.1, "C2": 0.1}), X.request_budgets(rq))
    body = X.recommendation_json(sel).first()["body"]
    assert body == '[{"A":"C1"},{"B":"C2"}]'


@pytest.mark.parametrize("word,budget", [("Low", 0.75), ("Medium", 0.5), ("High", 0.25), ("high", 0.5), (None, 0.5)])
def test_budget_words(spark, word, budget):  # X5, E17
    from riskloom.functions.budget import risk_budget
    df = spark.createDataFrame([(word,)], "w string")
    assert df.select(risk_budget("w").alias("b")).first()["b"] == budget


def raw_df(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "request_id long, json string")


def test_nothing_of_a_request_is_lost(spark):
    rq = raw_df(spark, [
        '{"items": [{"A": [{"C1": 5.0, "C2": 1.0}], "B": [{"C3": 2.0}]}], "risk_aversion": "Low"}',  # two names in one map
        '{"items": [{"A": [{"C1": 4.0}]}, {"B": []}], "risk_aversion": "Low"}',                       # an empty list
        '{"items": [{"A": [{"C1": 4.0}]}, {"A": []}], "risk_aversion": "Low"}',                       # the last list is empty
        '{"items": [], "risk_aversion": "High"}', 'not json', '{"risk_aversion": "Low"}'])
    risk = risk_df(spark, {"C1": 0.1, "C2": 0.1, "C3": 0.1})
    items, off, bud = X.request_items(rq), X.offers_long(rq), X.request_budgets(rq)
    st = {r["request_id"]: r["status"] for r in X.request_status(off, risk, bud, items).collect()}
    assert st == {0: "ok", 1: "infeasible", 2: "infeasible", 3: "ok", 4: "invalid_request", 5: "invalid_request"}
    got = sorted((r["request_id"], r["item"], r["country"]) for r in X.select_exact(off, risk, bud, items).collect())
    assert got == [(0, "A", "C2"), (0, "B", "C3")]
    pos = sorted((r["item_pos"], r["item"], r["offer_pos"], r["country"]) for r in off.filter("request_id = 0").collect())
    assert pos == [(0, "A", 0, "C1"), (0, "A", 1, "C2"), (1, "B", 0, "C3")]


def test_relaxed_has_every_item_whatever_the_multiplier(spark):
    rq = req_df(spark, [([(f"I{k}", [("A", 2e9), ("B", 1e6)]) for k in range(30)], "High")])
    risk = risk_df(spark, {"A": 0.0, "B": 0.01})
    off, bud = X.offers_long(rq), X.request_budgets(rq)
    relaxed, exact = X.select_relaxed(off, risk, bud).collect(), X.select_exact(off, risk, bud).collect()
    assert len(relaxed) == len(exact) == 30
    assert relaxed[0]["lower_bound"] <= sum(r["cost"] for r in exact) + 1e-6 <= relaxed[0]["total_cost"] + 1e-3
    assert sum(r["distance"] for r in relaxed) <= 0.25 + 1e-9


def test_fronts_of_a_large_request_stay_small(spark, monkeypatch):
    """The least cost is far nearer to the dual value than the relaxation's choice is, so fronts need not hold its whole gap."""
    rng = np.random.default_rng(5)
    n, k = 320, 6
    cost, mils = rng.integers(5_000, 90_000, (n, k)), rng.integers(0, 2_000, k)
    budget = int(mils.min() * n + (mils[cost.argmin(1)].sum() - mils.min() * n) // 2) + 13
    least = np.full(budget + 1, np.inf)  # least cost by summed risk in thousandths
    least[0] = 0.0
    for row in cost:
        after = np.full_like(least, np.inf)
        for c, r in zip(row, mils, strict=True):
            after[r:] = np.minimum(after[r:], least[:len(least) - r] + c)
        least = after
    offers = spark.createDataFrame(pd.DataFrame([(1, i, f"p{i}", o, f"C{o}", float(cost[i, o])) for i in range(n) for o in range(k)],
                                                columns=["request_id", "item_pos", "item", "offer_pos", "country", "cost"]))
    offers = offers.withColumn("item_pos", F.col("item_pos").cast("int")).withColumn("offer_pos", F.col("offer_pos").cast("int"))
    risk = spark.createDataFrame([(f"C{o}", float(mils[o]) / 1000) for o in range(k)], "country string, distance double")
    sizes, write = [], X.materialize

    def seen(df, name="table"):
        out = write(df, name)
        if name == "fronts":
            sizes.append(out.agg(F.max(F.size("cost"))).first()[0])
        return out

    monkeypatch.setattr(X, "materialize", seen)
    got = X.select_exact(offers, risk, spark.createDataFrame([(1, budget / 1000)], "request_id long, budget double"))
    assert tuple(got.agg(F.count("*"), F.sum("cost")).first()) == (n, least.min())
    assert max(sizes) < 300


def test_small_requests_in_batches_of_few_rows(spark):
    rng = np.random.default_rng(3)
    data = [(r, i, o, float(rng.integers(1, 50)), float(rng.integers(0, 40)) / 1000, 0.06) for r in range(40) for i in range(r % 4 + 1) for o in range(r % 3 + 1)]
    df = spark.createDataFrame(data, "request_id long, item_pos int, offer_pos int, cost double, distance double, budget double")
    whole = sorted(map(tuple, X._solve_small(df).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        few = X._solve_small(df)
        assert "FlatMapGroups" not in few._jdf.queryExecution().executedPlan().toString()  # no Python call per request
        assert sorted(map(tuple, few.collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for r in range(40):
        lists = [[x for x in data if x[0] == r and x[1] == i] for i in range(r % 4 + 1)]
        fits = [p for p in itertools.product(*lists) if sum(x[4] for x in p) <= 0.06 + 1e-9]
        best = min(fits, key=lambda p: (sum(x[3] for x in p), sum(x[4] for x in p), [x[2] for x in p]), default=())
        assert [(x[1], x[2]) for x in best] == [w[1:] for w in whole if w[0] == r]
