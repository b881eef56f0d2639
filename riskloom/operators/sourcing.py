"""Sourcing decisions: for every item of a request choose one producing country so
that the total cost is lowest and the summed risk stays within the request's budget
(a multiple-choice knapsack).

The reference flattens one request into a dense cost matrix (absent = 0) and hands
a boolean program to a solver. Here requests stay long and sparse (FIXTURES D12):

- ``request_items``  nested JSON -> one row per (request, item), items without offers too
- ``offers_long``    nested JSON -> one row per (request, item, offer)
- ``offers_dedup``   the reference's dictionary rules (last cost wins; a doubled item
                     name gives both positions the last list)
- ``offer_risk``     risk per offered country (broadcast only behind a row count)
- ``request_status`` ok / missing_risk / infeasible / invalid_request, one row per request
- ``cheapest_offer`` cheapest usable offer per item, no budget (a lower bound)
- ``select_relaxed`` Lagrangian relaxation with the multipliers that the offers' own
                     cost/risk hulls have, DataFrame only, for requests of any size;
                     reports a lower bound and the gap
- ``select_exact``   exact Pareto dynamic program, many requests in parallel; a large
                     request is a tree of partial fronts in many tasks
- ``recommendation`` item -> country rows and the JSON list the reference returns

Only offers with cost > 0 are usable (countries that do not offer an item are not
candidates). Feasibility is ``total risk <= budget`` with a 1e-9 tolerance so that
decimal ties (risk exactly equal to the budget) are feasible.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.budget import risk_budget
from riskloom.operators.ranks import running_sums
from riskloom.plans.broadcast import BROADCAST_ROW_LIMIT, bounded_count, broadcast_if_small
from riskloom.session import materialize

EPS = 1e-9
REQUEST_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))))),
    T.StructField("risk_aversion", T.StringType()),
])


def parse_requests(requests: DataFrame, json_col: str = "json") -> DataFrame:
    """``(request_id, json)`` -> ``(request_id, req struct)``. Malformed JSON gives NULL."""
    return requests.select("request_id", F.from_json(F.col(json_col), REQUEST_SCHEMA).alias("req"))


def request_budgets(requests: DataFrame) -> DataFrame:
    """``(request_id, risk_aversion, budget, valid)``, one row per request; ``valid`` is
    false for malformed JSON and for requests without an item list."""
    p = parse_requests(requests)
    return p.select("request_id", F.col("req.risk_aversion").alias("risk_aversion"),
                    risk_budget(F.col("req.risk_aversion")).alias("budget"),
                    F.col("req.items").isNotNull().alias("valid"))


def request_items(requests: DataFrame) -> DataFrame:
    """One row per named item, with its list of offers (which may be empty or NULL).
    ``item_pos`` counts names over the whole request, several names of one map included."""
    p = parse_requests(requests)
    entries = F.expr("flatten(transform(req.items, m -> coalesce(map_entries(m), cast(array() AS "
                     "array<struct<key:string,value:array<map<string,double>>>>))))")
    return p.select("request_id", F.posexplode(entries).alias("item_pos", "e")).select(
        "request_id", F.col("item_pos").cast("int").alias("item_pos"), F.col("e.key").alias("item"), F.col("e.value").alias("lst"))


def offers_long(requests: DataFrame) -> DataFrame:
    """X1 + O2: one row per offer with first-appearance positions (FIXTURES D12);
    ``offer_pos`` counts countries over the item's list, several countries of one map included."""
    entries = F.expr("flatten(transform(lst, m -> coalesce(map_entries(m), cast(array() AS array<struct<key:string,value:double>>))))")
    return request_items(requests).select("request_id", "item_pos", "item", F.posexplode(entries).alias("offer_pos", "e")).select(
        "request_id", "item_pos", "item", F.col("offer_pos").cast("int").alias("offer_pos"),
        F.col("e.key").alias("country"), F.col("e.value").alias("cost"))


def _positions(offers: DataFrame, items: DataFrame | None) -> DataFrame:
    return (offers if items is None else items).select("request_id", "item", "item_pos").distinct()


def offers_dedup(offers: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """A country named twice in one item keeps its first position and its last cost;
    an item name used twice gets, at every position, the offers of its last position.
    With ``items`` (see ``request_items``) a last position without offers counts, too: the
    item then has none at any position."""
    per_item = (offers.groupBy("request_id", "item_pos", "item", "country")
                .agg(F.min("offer_pos").alias("offer_pos"), F.max_by("cost", "offer_pos").alias("cost")))
    positions = _positions(offers, items)
    last_pos = positions.groupBy("request_id", "item").agg(F.max("item_pos").alias("src_pos"))
    src = per_item.withColumnRenamed("item_pos", "src_pos")
    return (positions.join(last_pos, ["request_id", "item"]).join(src, ["request_id", "item", "src_pos"])
            .select("request_id", "item_pos", "item", "offer_pos", "country", "cost"))


def cost_matrix(offers: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The matrix of items x countries of every request, as coordinates: ``item_pos`` (row), ``country_pos``
    (column: the country's place among the request's countries by code), ``cost``. Absent pairs are the implicit 0
    of the reference's dense matrix. The window holds a request's countries, not its offers."""
    dd = offers_dedup(offers, items)
    columns = dd.select("request_id", "country").distinct().withColumn(
        "country_pos", (F.row_number().over(Window.partitionBy("request_id").orderBy("country")) - 1).cast("int"))
    return dd.join(columns, ["request_id", "country"]).select("request_id", "item_pos", "country_pos", "cost")


def usable_offers(offers: DataFrame) -> DataFrame:
    """Offers a request can choose (a finite cost > 0; NaN is no cost)."""
    return offers.filter((F.col("cost") > 0) & (F.col("cost") < float("inf")))


def dedup_risk(risk: DataFrame) -> DataFrame:
    """One score per country. The reference keeps whichever row it read last (no
    order); we keep the largest, a repeatable and cautious choice. A row whose score is NULL or
    NaN is no score: a country with no other row has none."""
    scored = risk.filter(F.col("country").isNotNull() & F.col("distance").isNotNull() & ~F.isnan(F.col("distance").cast("double")))
    return scored.groupBy("country").agg(F.max("distance").alias("distance"))


def _risk_side(risk: DataFrame) -> DataFrame:
    """Deduplicated risk, broadcast-hinted when its counted size is small; made once per top-level call."""
    r = dedup_risk(risk)
    n = bounded_count(r)
    return broadcast_if_small(r, n if n <= BROADCAST_ROW_LIMIT else None)


def _unscored(offers: DataFrame, side: DataFrame) -> DataFrame:
    return offers.select("request_id", "country").distinct().join(side, "country", "left_anti").select("request_id", "country")


def offer_risk(offers: DataFrame, risk: DataFrame) -> DataFrame:
    """Offers with their country's risk (NULL when the country has none)."""
    return offers.join(_risk_side(risk), "country", "left")


def missing_risk(offers: DataFrame, risk: DataFrame) -> DataFrame:
    """Every offered country (any cost, any list position) without a risk score."""
    return _unscored(offers, _risk_side(risk))


def missing_risk_status(offers: DataFrame, risk: DataFrame) -> DataFrame:
    """Per request the sorted list of countries without a score (bounded by the
    number of countries), with ``status='missing_risk'``."""
    return (missing_risk(offers, risk).groupBy("request_id")
            .agg(F.sort_array(F.collect_set("country")).alias("missing"))
            .withColumn("status", F.lit("missing_risk")))


def request_status(offers: DataFrame, risk: DataFrame, budgets: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``(request_id, status, min_risk, budget)``, one row per request of ``budgets``:
    ``invalid_request`` (malformed JSON or no item list), ``missing_risk`` (an offered country
    has no score), ``infeasible`` (an item without a usable offer, or even the least risky
    choices exceed the budget) or ``ok``. Without ``items`` a request without offers counts as
    infeasible; with them, a request of no items is ok and has nothing to choose."""
    return _status(offers, offers_dedup(offers, items), _risk_side(risk), budgets, items)


def _status(offers: DataFrame, dd: DataFrame, side: DataFrame, budgets: DataFrame, items: DataFrame | None) -> DataFrame:
    scored = usable_offers(dd).join(side, "country")
    per_item = scored.groupBy("request_id", "item_pos").agg(F.min("distance").alias("r_min"))
    item_rows = _positions(offers, items).select("request_id", "item_pos").distinct().join(per_item, ["request_id", "item_pos"], "left")
    per_req = item_rows.groupBy("request_id").agg(
        F.sum("r_min").alias("min_risk"), F.count_if(F.col("r_min").isNull()).alias("n_unusable"), F.lit(True).alias("has_items"))
    miss = _unscored(offers, side).select("request_id").distinct().withColumn("has_missing", F.lit(True))
    valid = F.col("valid") if "valid" in budgets.columns else F.lit(True)
    out = (budgets.select("request_id", "budget", valid.alias("valid"))
           .join(per_req, "request_id", "left").join(miss, "request_id", "left"))
    nothing = F.lit(items is None) & F.col("has_items").isNull()
    status = (F.when(~F.col("valid"), "invalid_request").when(F.col("has_missing"), "missing_risk")
              .when(nothing | (F.col("n_unusable") > 0) | (F.col("min_risk") > F.col("budget") + EPS), "infeasible")
              .otherwise("ok"))
    empty = F.col("valid") & F.col("has_items").isNull() & F.lit(items is not None)
    return out.select("request_id", status.alias("status"), F.when(empty, F.lit(0.0)).otherwise(F.col("min_risk")).alias("min_risk"), "budget")


def _prepared(offers: DataFrame, risk: DataFrame, budgets: DataFrame, items: DataFrame | None) -> DataFrame:
    """Undominated candidates of the ok requests with their budget, stored once. The
    deduplicated offers are stored, too, as status and candidates both come from them."""
    side = _risk_side(risk)
    dd = materialize(offers_dedup(offers, items), "offers-dedup")
    ok = _status(offers, dd, side, budgets, items).filter(F.col("status") == "ok").select("request_id", "budget")
    candidates = usable_offers(dd).join(side, "country")
    return materialize(pareto_offers(candidates).join(ok, "request_id").select(
        "request_id", "item_pos", "item", "offer_pos", "country", "cost", "distance", "budget"), "candidates")


def _candidates(offers: DataFrame, risk: DataFrame, items: DataFrame | None = None) -> DataFrame:
    return usable_offers(offers_dedup(offers, items)).join(_risk_side(risk), "country")


def pareto_offers(candidates: DataFrame) -> DataFrame:
    """Inside each item keep only offers that no other offer beats on both cost and risk
    (ties keep the earliest position). No optimal choice is lost, for any budget or
    lambda. The window holds one item: at most one offer per country."""
    w = Window.partitionBy("request_id", "item_pos").orderBy("cost", "distance", "offer_pos")
    return (candidates.withColumn("_prev_min", F.min("distance").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .filter(F.col("_prev_min").isNull() | (F.col("distance") < F.col("_prev_min"))).drop("_prev_min"))


def cheapest_offer(offers: DataFrame, risk: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Cheapest usable offer per item ignoring the budget; ties by risk, then position."""
    c = _candidates(offers, risk, items)
    best = c.groupBy("request_id", "item_pos", "item").agg(
        F.min_by(F.struct("country", "cost", "distance"), F.struct("cost", "distance", "offer_pos")).alias("b"))
    return best.select("request_id", "item_pos", "item", "b.country", "b.cost", "b.distance")


def hull_steps(candidates: DataFrame) -> DataFrame:
    """The lower hull of each item's undominated offers in (cost, risk), one row per vertex:
    ``step`` 0 is the cheapest offer (``lam`` -1); each further one costs ``d_cost`` more than
    the one before, risks ``-d_risk`` less, and is worth it from the multiplier ``lam`` on.
    An item's offers (at most one per country) are one row while its hull is found."""
    pts = candidates.groupBy("request_id", "item_pos", "item", "budget").agg(
        F.sort_array(F.collect_list(F.struct("cost", "distance", "offer_pos", "country"))).alias("pts"))
    slope = "({b}.cost - {a}.cost) / ({a}.distance - {b}.distance)"
    hull = pts.withColumn("hull", F.expr(
        "filter(pts, (p, i) -> coalesce(array_max(transform(slice(pts, 1, i), a -> " + slope.format(a="a", b="p") + ")), -1D) < "
        "coalesce(array_min(transform(slice(pts, i + 2, size(pts)), b -> " + slope.format(a="p", b="b") + ")), double('infinity')))"))
    steps = hull.select("request_id", "item_pos", "item", "budget", "hull", F.posexplode("hull").alias("step", "o"))
    before = F.get("hull", F.col("step") - 1)
    first = F.col("step") == 0
    d_cost, d_risk = F.col("o.cost") - before["cost"], F.col("o.distance") - before["distance"]
    return steps.select("request_id", "item_pos", "item", "budget", "step", "o.country", "o.cost", "o.distance",
                        F.when(first, F.lit(-1.0)).otherwise(d_cost / -d_risk).alias("lam"),
                        F.when(first, F.col("o.cost")).otherwise(d_cost).alias("d_cost"),
                        F.when(first, F.col("o.distance")).otherwise(d_risk).alias("d_risk"))


def select_relaxed(offers: DataFrame, risk: DataFrame, budgets: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Lagrangian relaxation, DataFrame only, for requests of any size.

    Every item starts at its cheapest offer and moves along its hull. All moves of a request
    are ordered by their multiplier; the first place in this order at which the summed risk
    fits the budget is the choice (the end of the order is the least risk, so every ok request
    has one). ``lower_bound`` is the dual value at that multiplier, the best one;
    ``gap = total_cost - lower_bound``. Running sums are spread over range partitions, so a
    huge request isn't one task. Requests with ok status only.
    """
    steps, best = _break_points(_prepared(offers, risk, budgets, items))
    order = ["lam", "item_pos", "step"]
    chosen = steps.drop("total_cost", "total_risk").join(best, "request_id").filter(
        F.struct(*order) <= F.struct(*[F.col(f"b.{c}").alias(c) for c in order]))
    pick = chosen.groupBy("request_id", "item_pos", "item", "budget", "b").agg(
        F.max_by(F.struct("country", "cost", "distance"), "step").alias("o"))
    lam = F.greatest(F.col("b.lam"), F.lit(0.0))
    bound = F.col("b.total_cost") + lam * (F.col("b.total_risk") - F.col("budget"))
    # at multiplier 0 the bound is the cheapest cost itself, whatever risk is left unused
    bound = F.when(lam > 0, bound).otherwise(F.col("b.total_cost"))
    return pick.select("request_id", "item_pos", "item", "o.country", "o.cost", "o.distance", "b.total_cost", "b.total_risk",
                       bound.alias("lower_bound"), (F.col("b.total_cost") - bound).alias("gap"))


def _break_points(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hull moves with the running cost and risk of their request (stored), and per request the first move ``b`` that fits."""
    order = ["lam", "item_pos", "step"]
    steps = running_sums(hull_steps(data).withColumn("one", F.lit(1)), ["request_id"], order,
                         {"total_cost": "d_cost", "total_risk": "d_risk", "n_steps": "one"})
    steps = materialize(steps, "relaxed-steps")
    n_items = steps.filter("step = 0").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_items"))
    fits = steps.join(n_items, "request_id").filter(
        (F.col("n_steps") >= F.col("n_items")) & (F.col("total_risk") <= F.col("budget") + EPS))
    return steps, fits.groupBy("request_id").agg(F.min(F.struct(*order, "total_cost", "total_risk", "budget")).alias("b"))


# ------------------------------------------------------------------ exact selection

#: Requests of more items are solved by a tree over groups of so many items.
GROUP_ITEMS = 64
#: Pairs of states that a merge looks at together.
PAIRS_AT_ONCE = 4_000_000
#: The tree's first bound is this part of the relaxation's gap; a bound that isn't enough is raised so many times.
FIRST_BOUND, BOUND_STEP = 1 / 256, 8


def pareto_keep(cost, risk, first, second):
    """Indexes of the states that no other beats on cost and risk, cheapest first; of equal ones the first by
    (``first``, ``second``)."""
    order = np.lexsort((second, first, risk, cost))
    risk = risk[order]
    before = np.concatenate([[np.inf], np.minimum.accumulate(risk)[:-1]])
    return order[risk < before]


def path_ranks(first, second):
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.lexsort((second, first))] = np.arange(len(first))
    return rank


def pareto_select(item, cost, risk, offer, limit_risk, lam=0.0, limit_excess=np.inf):
    """Undominated choices of one offer per item by a Pareto dynamic program over items in order.

    Arrays are sorted by item. A state is (cost, risk) with a pointer to the state and offer it came
    from; only undominated states are kept whose risk, above the least that the items can have,
    fits ``limit_risk``, and whose ``cost + lam * risk`` is above the least by at most
    ``limit_excess``. Among equal ones the earliest offer positions win. Returns cost, risk and
    path rank of the states, cheapest first, and the trail of (source state, row) per item.
    """
    c, r, rank = np.zeros(1), np.zeros(1), np.zeros(1, dtype=np.int64)
    low = least = 0.0
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    trail = []
    for a, b in zip(starts, np.r_[starts[1:], len(item)]):
        oc, orisk = cost[a:b], risk[a:b]
        least, low = least + orisk.min(), low + (oc + lam * orisk).min()
        nc, nr = (c[:, None] + oc[None, :]).ravel(), (r[:, None] + orisk[None, :]).ravel()
        fits = nr - least <= limit_risk + EPS
        if np.isfinite(limit_excess):
            fits &= nc + lam * nr - low <= limit_excess
        ok = np.flatnonzero(fits)
        src, pick = ok // len(oc), ok % len(oc)
        keep = pareto_keep(nc[ok], nr[ok], rank[src], offer[a:b][pick])
        src, pick, ok = src[keep], pick[keep], ok[keep]
        c, r = nc[ok], nr[ok]
        rank = path_ranks(rank[src], offer[a:b][pick])
        trail.append((src, a + pick))
    return c, r, rank, trail, low, least


def path_rows(trail, state: int) -> list[int]:
    """The rows that a state chose, in item order."""
    rows = []
    for src, row in reversed(trail):
        rows.append(int(row[state]))
        state = src[state]
    return rows[::-1]


def merged_fronts(left, right, limit_risk, lam, limit_excess):
    """Front of the sums of two fronts (dicts of cost, risk, rank arrays and their lows), with both pointers."""
    low, least = left["low"] + right["low"], left["least"] + right["least"]
    excess = [f["cost"] + lam * f["risk"] - f["low"] for f in (left, right)]
    by = np.argsort(excess[1], kind="stable")
    upto = np.searchsorted(excess[1][by], limit_excess - excess[0], "right")
    out = [np.empty(0), np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)]
    a = 0
    while a < len(upto):
        b = a + max(1, int(np.searchsorted(np.cumsum(upto[a:]), PAIRS_AT_ONCE, "right")))
        n = upto[a:b]
        src = np.repeat(np.arange(a, min(b, len(upto))), n)
        pick = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        c, r = left["cost"][src] + right["cost"][pick], left["risk"][src] + right["risk"][pick]
        fits = r - least <= limit_risk + EPS
        part = [np.concatenate([x, y[fits]]) for x, y in zip(out, (c, r, src, pick), strict=True)]
        keep = pareto_keep(part[0], part[1], left["rank"][part[2]], right["rank"][part[3]])
        out, a = [x[keep] for x in part], b
    c, r, src, pick = out
    return {"cost": c, "risk": r, "rank": path_ranks(left["rank"][src], right["rank"][pick]), "low": low, "least": least}, src, pick


CHOICE_SCHEMA = "request_id long, item_pos int, offer_pos int"
FRONT_SCHEMA = ("request_id long, node long, lam double, gap double, slack double, low double, least double, cost array<double>, "
                "risk array<double>, rank array<long>, left_state array<int>, right_state array<int>, picks array<int>, items array<int>")


def _solve_small(data: DataFrame) -> DataFrame:
    """Choices of requests of at most GROUP_ITEMS items, whose rows reach a task sorted: it holds a batch of
    rows and the request that the batch ends in, as a group of its own for every request costs more than its solution."""
    def chosen(table):
        import pyarrow as pa

        request, item, offer, cost, risk, budget = (table.column(c).to_numpy() for c in ("request_id", "item_pos", "offer_pos", "cost", "distance", "budget"))
        starts = np.flatnonzero(np.r_[True, request[1:] != request[:-1]])
        rows = []
        for a, b in zip(starts, np.r_[starts[1:], len(request)], strict=True):
            one = slice(a, b)
            items = np.flatnonzero(np.r_[True, item[one][1:] != item[one][:-1]])
            slack = budget[a] - np.minimum.reduceat(risk[one], items).sum()
            found = pareto_select(item[one], cost[one], risk[one], offer[one], slack)
            rows += [a + row for row in path_rows(found[3], 0)] if len(found[0]) else []
        return table.select(["request_id", "item_pos", "offer_pos"]).take(pa.array(rows, pa.int64())).combine_chunks().to_batches()

    def solve(batches):
        import pyarrow as pa

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            request = table.column("request_id").to_numpy()
            end = int(np.searchsorted(request, request[-1])) if len(request) else 0
            rest = table.slice(end)
            if end:
                yield from chosen(table.slice(0, end))
        if rest is not None and len(rest):
            yield from chosen(rest)

    # A fixed number of partitions on the request id keeps the requests spread over all cores.
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = data.select("request_id", "item_pos", "offer_pos", "cost", "distance", "budget").repartition(parts, "request_id")
    return rows.sortWithinPartitions("request_id", "item_pos", "offer_pos").mapInArrow(solve, CHOICE_SCHEMA)


def _front_row(request_id, node, limits, front, left=(), right=(), picks=(), items=()):
    lam, gap, slack = limits
    return {"request_id": request_id, "node": node, "lam": lam, "gap": gap, "slack": slack, "low": front["low"], "least": front["least"],
            "cost": front["cost"], "risk": front["risk"], "rank": front["rank"], "left_state": left, "right_state": right, "picks": picks, "items": items}


def _leaf_fronts(data: DataFrame, limits: DataFrame) -> DataFrame:
    """Fronts of groups of items, pruned by the relaxation's bound."""
    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_pos", "offer_pos"])
        item, offer = pdf["item_pos"].to_numpy(), pdf["offer_pos"].to_numpy()
        lam, gap, slack = (float(pdf[c].iloc[0]) for c in ("lam", "gap", "slack"))
        c, r, rank, trail, low, least = pareto_select(item, pdf["cost"].to_numpy(), pdf["distance"].to_numpy(), offer, slack, lam, gap)
        picks = offer[np.array([path_rows(trail, s) for s in range(len(c))], dtype=int).ravel()]
        front = {"cost": c, "risk": r, "rank": rank, "low": low, "least": least}
        return pd.DataFrame([_front_row(key[0], key[1], (lam, gap, slack), front, picks=picks, items=np.unique(item))])

    rows = data.join(limits, "request_id").withColumn("node", F.expr(f"item_pos div {GROUP_ITEMS}").cast("long"))
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("request_id", "node", "item_pos", "offer_pos", "cost", "distance", "lam", "gap", "slack").repartition(
        parts, "request_id", "node").groupBy("request_id", "node").applyInPandas(solve, FRONT_SCHEMA)


def _merge_fronts(fronts: DataFrame) -> DataFrame:
    """The next level of the tree: neighbours merged two by two."""
    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        sides = [{**{k: row[k] for k in ("low", "least")}, **{k: np.asarray(row[k]) for k in ("cost", "risk", "rank")}} for _, row in pdf.iterrows()]
        limits = tuple(float(pdf[c].iloc[0]) for c in ("lam", "gap", "slack"))
        if len(sides) == 1:  # the last node, or one beside positions without items
            every = np.arange(len(sides[0]["cost"]))
            front, left, right = sides[0], *((every, ()) if pdf["node"].iloc[0] % 2 == 0 else ((), every))
        else:
            front, left, right = merged_fronts(*sides, limits[2], limits[0], limits[1])
        return pd.DataFrame([_front_row(key[0], key[1], limits, front, left, right)])

    # A fixed number of partitions, as fronts are few bytes for the work that their merging is.
    parts = int(fronts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = fronts.drop("picks", "items", "left_state", "right_state").withColumn("parent", F.expr("node div 2"))
    return pairs.repartition(parts, "request_id", "parent").groupBy("request_id", "parent").applyInPandas(merge, FRONT_SCHEMA)


def _solve_large(data: DataFrame, most_items: int) -> DataFrame:
    """Choices of large requests: a tree of partial Pareto fronts.

    Groups of GROUP_ITEMS items give fronts in separate tasks, and neighbours are merged two by
    two, a level of the tree at a time, so no task holds a request's items. A partial choice is
    dropped if its reduced cost (cost + multiplier x risk) is above its items' least by more than
    a bound. With the gap of the relaxation as bound, no completion of it could cost less than the
    relaxation's own choice, but the least cost is far nearer to the dual value than this choice, and
    fronts grow with the bound. So it starts small: a cheapest choice that costs no more than the dual
    value plus the bound is the answer, as every choice of this cost or less has been kept. A request
    whose cheapest choice costs more goes through the tree again with a larger bound, the
    choice's own cost above the dual value if that is near and never more than the relaxation's gap.
    """
    _, best = _break_points(data)
    least = data.groupBy("request_id", "item_pos").agg(F.min("distance").alias("r")).groupBy("request_id").agg(F.sum("r").alias("least_risk"))
    lam = F.greatest(F.col("b.lam"), F.lit(0.0))
    gap = F.greatest(lam * (F.col("b.budget") - F.col("b.total_risk")), F.lit(0.0))
    limits = best.join(least, "request_id").select(
        "request_id", lam.alias("lam"), gap.alias("whole"), (1e-9 * (1 + F.col("b.total_cost") + lam) + 2 * EPS * lam).alias("rounding"),
        (F.col("b.budget") - F.col("least_risk")).alias("slack"))
    whole = F.col("whole") + F.col("rounding")
    limits = materialize(limits.withColumn("gap", F.col("whole") * FIRST_BOUND + F.col("rounding")), "exact-limits")
    passes = []
    while True:
        levels = _tree(data, limits, most_items)
        root = levels[-1].select("request_id", "low", "least", F.get("cost", F.lit(0)).alias("cost"))
        above = F.col("cost") - F.col("low") + F.col("lam") * (F.col("slack") + F.col("least")) + F.col("rounding")  # the dual value
        judged = limits.join(root, "request_id", "left").withColumn("above", above)
        judged = judged.withColumn("solved", (F.col("gap") >= whole) | F.coalesce(F.col("above") <= F.col("gap"), F.lit(False)))
        judged = materialize(judged, "judged")
        solved = judged.filter("solved").select("request_id")
        passes.append([level.join(solved, "request_id", "left_semi") for level in levels])
        more = F.col("gap") * BOUND_STEP
        near = F.when(F.col("above") + F.col("rounding") <= more, F.col("above") + F.col("rounding")).otherwise(more)
        limits = judged.filter("NOT solved").withColumn("gap", F.least(near, whole)).select(*limits.columns)
        if limits.isEmpty():
            return _chosen([reduce(DataFrame.unionByName, level) for level in zip(*passes, strict=True)])


def _tree(data: DataFrame, limits: DataFrame, most_items: int) -> list[DataFrame]:
    """The fronts of the requests of ``limits`` by level, the leaves first."""
    levels = [materialize(_leaf_fronts(data, limits), "fronts")]
    nodes = (most_items - 1) // GROUP_ITEMS + 1
    while nodes > 1:
        levels.append(materialize(_merge_fronts(levels[-1]), "fronts"))
        nodes = (nodes + 1) // 2
    return levels


def _chosen(levels: list[DataFrame]) -> DataFrame:
    """The way down the tree to the choice of every item."""
    # Fronts are sorted by cost, so the root's first state is the answer.
    at = levels[-1].select("request_id", "node", F.lit(0).alias("state"))
    for above, level in zip(levels[:0:-1], levels[-2::-1]):
        both = at.join(above.select("request_id", "node", "left_state", "right_state"), ["request_id", "node"])
        child = F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.get("left_state", F.col("state")).alias("state")),
                                  F.struct((2 * F.col("node") + 1).alias("node"), F.get("right_state", F.col("state")).alias("state"))))
        at = materialize(both.select("request_id", child.alias("c")).select("request_id", "c.node", "c.state").filter("state IS NOT NULL"), "states")
    leaves = at.join(levels[0].select("request_id", "node", "picks", "items"), ["request_id", "node"])
    picked = leaves.select("request_id", "state", "picks", F.size("items").alias("n"), F.posexplode("items").alias("k", "item_pos"))
    return picked.select("request_id", "item_pos", F.get("picks", F.col("state") * F.col("n") + F.col("k")).alias("offer_pos"))


def select_exact(offers: DataFrame, risk: DataFrame, budgets: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Exact selection (FIXTURES D15). Requests are solved in parallel, large ones by a tree of
    tasks. Dominated offers are pruned in Spark first (inside an item an offer is dropped when
    another costs no more and risks no more). Only requests with ok status have rows (see
    request_status)."""
    data = _prepared(offers, risk, budgets, items)
    sizes = data.groupBy("request_id").agg((F.max("item_pos") + 1).alias("n"))
    large = materialize(sizes.filter(F.col("n") > GROUP_ITEMS), "large-requests")
    most_items = large.agg(F.max("n")).first()[0]
    if most_items is None:
        choices = _solve_small(data)
    else:
        choices = _solve_small(data.join(large, "request_id", "left_anti")).unionByName(
            _solve_large(materialize(data.join(large.select("request_id"), "request_id", "left_semi"), "large-candidates"), most_items))
    return data.join(choices, ["request_id", "item_pos", "offer_pos"]).select(
        "request_id", "item_pos", "item", "country", "cost", "distance", F.lit("optimal").alias("status"))


def recommendation(selection: DataFrame) -> DataFrame:
    """X11: item -> country rows of the chosen offers."""
    return selection.select("request_id", "item_pos", "item", "country")


def recommendation_json(selection: DataFrame) -> DataFrame:
    """X11: the reference's reply body, a JSON list of ``{item: country}`` in item order.
    The collected list is one request's items."""
    per = selection.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("item_pos", "item", "country"))).alias("s"))
    return per.select("request_id", F.to_json(F.transform("s", lambda e: F.create_map(e["item"], e["country"]))).alias("body"))


def country_names(codes: DataFrame, dictionary: DataFrame, code_col: str = "country") -> DataFrame:
    """Display name for a code, falling back to the code itself. The dictionary is
    a fixed-size dimension (one row per code), broadcast behind a row count."""
    d = dictionary.select(F.col("code").alias(code_col), F.col("name"))
    n = bounded_count(d)
    d = broadcast_if_small(d, n if n <= BROADCAST_ROW_LIMIT else None)
    return codes.join(d, code_col, "left").withColumn("name", F.coalesce(F.col("name"), F.col(code_col)))


def country_code_of(dictionary: DataFrame) -> DataFrame:
    """Name -> the first code of that name in dictionary order."""
    return dictionary.groupBy("name").agg(F.min_by("code", "pos").alias("code"))


def offers_named(offers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The offer listing with country names."""
    return country_names(offers_dedup(offers), dictionary)
