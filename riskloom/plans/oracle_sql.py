"""DuckDB SQL text for the oracle side of every registered query.

Plain SQL over the driver's views, kept apart from the DataFrame code
(windows with NTILE, joins, enumeration). Floating results are rounded to 6
places on both sides; integer sums are cast to BIGINT (DuckDB's SUM is HUGEINT).
"""

from __future__ import annotations

from riskloom.functions.codes import ROOT_CODES
from riskloom.plans.fixtures import AS_OF, DICTIONARY_SQL, EVENT_KEY, EVENTS_SQL, OFFERS_SQL, RISK_SQL, APPETITE_SQL

KEY = ", ".join(EVENT_KEY)
CODES = ", ".join(str(int(c)) for c in ROOT_CODES)


def start_sql(months: int, as_of: str = AS_OF) -> str:
    return f"CAST(CAST(date_trunc('week', DATE '{as_of}') AS DATE) + INTERVAL ({int(months)}) MONTH AS DATE)"


def ev_cte() -> str:
    return f"ev AS ({EVENTS_SQL})"


def filtered_cte(months: int, by_country: bool = True, as_of: str = AS_OF) -> str:
    cond = "AND country IS NOT NULL" if by_country else ""
    return f"""f AS (
  SELECT *, CAST(date_trunc('week', event_date) AS DATE) AS week FROM ev
  WHERE TRY_CAST(root_code AS INTEGER) IN ({CODES})
    AND event_date >= {start_sql(months, as_of)} AND event_date <= DATE '{as_of}' {cond})"""


def weekly_sql(months: int = -2, by_country: bool = True, with_totals: bool = True, with_centres: bool = True) -> str:
    g = "country, week" if by_country else "week"
    part = "country, week" if by_country else "week"
    totals = f"""t AS (SELECT {g}, CAST(SUM(num_mentions) AS BIGINT) AS total_mentions,
  CAST(SUM(num_sources) AS BIGINT) AS total_sources, CAST(SUM(num_articles) AS BIGINT) AS total_articles
  FROM f GROUP BY {g})"""
    halves = f"""h AS (SELECT {g}, avg_tone, goldstein,
  NTILE(2) OVER (PARTITION BY {part} ORDER BY avg_tone ASC NULLS LAST, {KEY}) AS tn,
  NTILE(2) OVER (PARTITION BY {part} ORDER BY goldstein ASC NULLS LAST, {KEY}) AS gn FROM f),
c AS (SELECT {g}, AVG(avg_tone) AS center_tone, AVG(goldstein) AS center_goldstein
  FROM h WHERE tn = 1 AND gn = 1 GROUP BY {g})"""
    ctes = [ev_cte(), filtered_cte(months, by_country)]
    if with_totals:
        ctes.append(totals)
    if with_centres:
        ctes.append(halves)
    head = "WITH " + ",\n".join(ctes)
    centres = "round(c.center_tone, 6) AS center_tone, round(c.center_goldstein, 6) AS center_goldstein"
    if with_totals and with_centres:
        return f"{head}\nSELECT t.*, {centres} FROM t JOIN c USING ({g})"
    if with_totals:
        return f"{head}\nSELECT * FROM t"
    return f"{head}\nSELECT {g}, {centres} FROM c"


def weekly_median_sql(months: int = -2) -> str:
    return f"""WITH {ev_cte()}, {filtered_cte(months)}
SELECT country, week, round(median(avg_tone), 6) AS median_avg_tone, round(median(goldstein), 6) AS median_goldstein
FROM f GROUP BY country, week"""


def halves_sql(value: str, months: int = -2) -> str:
    return f"""WITH {ev_cte()}, {filtered_cte(months)}
SELECT {KEY}, country, week,
  CAST(NTILE(2) OVER (PARTITION BY country, week ORDER BY {value} ASC NULLS LAST, {KEY}) AS BIGINT) AS half
FROM f"""


def with_ev(select: str) -> str:
    return f"WITH {ev_cte()}\n{select}"


__all__ = ["weekly_sql", "weekly_median_sql", "halves_sql", "with_ev", "ev_cte", "filtered_cte", "start_sql",
           "KEY", "CODES", "OFFERS_SQL", "RISK_SQL", "DICTIONARY_SQL", "APPETITE_SQL"]


# ------------------------------------------------------------------ forecast family

METRIC_NAMES = ("total_mentions", "total_sources", "total_articles", "center_tone", "center_goldstein")


def series_ctes(months: int = -2, direction: str = "forward") -> list[str]:
    """CTEs up to ``st``: (country, metric, week, y, t, n); t oldest first (forward) or newest first."""
    order = "week" if direction == "forward" else "week DESC"
    g = "country, week"
    union = "\n  UNION ALL ".join(
        f"SELECT country, '{m}' AS metric, week, CAST({m} AS DOUBLE) AS y FROM wm" for m in METRIC_NAMES)
    return [ev_cte(), filtered_cte(months),
            f"""t AS (SELECT {g}, CAST(SUM(num_mentions) AS BIGINT) AS total_mentions,
  CAST(SUM(num_sources) AS BIGINT) AS total_sources, CAST(SUM(num_articles) AS BIGINT) AS total_articles
  FROM f GROUP BY {g})""",
            f"""h AS (SELECT {g}, avg_tone, goldstein,
  NTILE(2) OVER (PARTITION BY {g} ORDER BY avg_tone ASC NULLS LAST, {KEY}) AS tn,
  NTILE(2) OVER (PARTITION BY {g} ORDER BY goldstein ASC NULLS LAST, {KEY}) AS gn FROM f)""",
            f"""c AS (SELECT {g}, AVG(avg_tone) AS center_tone, AVG(goldstein) AS center_goldstein
  FROM h WHERE tn = 1 AND gn = 1 GROUP BY {g})""",
            "wm AS (SELECT t.*, c.center_tone, c.center_goldstein FROM t JOIN c USING (country, week))",
            f"ser AS ({union})",
            f"""st AS (SELECT *, row_number() OVER (PARTITION BY country, metric ORDER BY {order}) AS t,
  count(*) OVER (PARTITION BY country, metric) AS n FROM ser)""",
            """sl AS (SELECT *, lag(y, 1) OVER w AS y_lag1, lag(y, 2) OVER w AS y_lag2, lag(y, 3) OVER w AS y_lag3,
  lag(y, 4) OVER w AS y_lag4 FROM st WINDOW w AS (PARTITION BY country, metric ORDER BY t))"""]


def _zsql(lag: int) -> str:
    y = ["y", "y_lag1", "y_lag2", "y_lag3", "y_lag4"]
    return (f"CASE d WHEN 0 THEN {y[lag]} WHEN 1 THEN {y[lag]} - {y[lag + 1]} "
            f"ELSE {y[lag]} - 2 * {y[lag + 1]} + {y[lag + 2]} END")


def ar_ctes(months: int = -2, upto: str = "train", direction: str = "forward") -> list[str]:
    """Adds ``fc``: (country, metric, p, d, q, forecast) for the nine q = 0 orders."""
    return series_ctes(months, direction) + ar_fit_ctes(upto)


def ar_fit_ctes(upto: str = "train", tag: str = "") -> list[str]:
    """The fit CTEs over ``sl``; ``tag`` suffixes every CTE name so that a second copy
    (for example on all points, ``upto='all'``) can live in the same query."""
    m = "n - 1" if upto == "train" else "n"
    reg = "t >= d + p + 1 AND t <= m"
    pdg, rw, sm, nq, co, zh, fc = (f"{x}{tag}" for x in ("pdg", "rw", "sm", "nq", "co", "zh", "fc"))
    return [
        f"{pdg} AS (SELECT a.p, b.d FROM (VALUES (0), (1), (2)) a(p), (VALUES (0), (1), (2)) b(d))",
        f"""{rw} AS (SELECT sl.country, sl.metric, sl.t, sl.y, sl.y_lag1, {m} AS m, {pdg}.p, {pdg}.d,
  {_zsql(0)} AS zt,
  CASE WHEN p >= 1 THEN {_zsql(1)} ELSE 0.0 END AS x1,
  CASE WHEN p >= 2 THEN {_zsql(2)} ELSE 0.0 END AS x2,
  {_zsql(1)} AS zprev
  FROM sl CROSS JOIN {pdg})""",
        f"""{sm} AS (SELECT country, metric, p, d, count(*) FILTER (WHERE {reg}) AS E,
  sum(zt) FILTER (WHERE {reg}) AS Sy, sum(x1) FILTER (WHERE {reg}) AS S1, sum(x2) FILTER (WHERE {reg}) AS S2,
  sum(x1 * x1) FILTER (WHERE {reg}) AS S11, sum(x1 * x2) FILTER (WHERE {reg}) AS S12,
  sum(x2 * x2) FILTER (WHERE {reg}) AS S22, sum(x1 * zt) FILTER (WHERE {reg}) AS S1y,
  sum(x2 * zt) FILTER (WHERE {reg}) AS S2y,
  max(y) FILTER (WHERE t = m) AS ym, max(y_lag1) FILTER (WHERE t = m) AS ym1,
  max(zt) FILTER (WHERE t = m) AS zm, max(zprev) FILTER (WHERE t = m) AS zm1, count(*) FILTER (WHERE y IS NULL) AS gaps
  FROM {rw} GROUP BY country, metric, p, d)""",
        f"""{nq} AS (SELECT *,
  CASE WHEN d = 0 THEN S11 - S1 * S1 / NULLIF(CAST(E AS DOUBLE), 0) ELSE S11 END AS a11,
  CASE WHEN d = 0 THEN S12 - S1 * S2 / NULLIF(CAST(E AS DOUBLE), 0) ELSE S12 END AS a12,
  CASE WHEN d = 0 THEN S22 - S2 * S2 / NULLIF(CAST(E AS DOUBLE), 0) ELSE S22 END AS a22,
  CASE WHEN d = 0 THEN S1y - S1 * Sy / NULLIF(CAST(E AS DOUBLE), 0) ELSE S1y END AS b1,
  CASE WHEN d = 0 THEN S2y - S2 * Sy / NULLIF(CAST(E AS DOUBLE), 0) ELSE S2y END AS b2 FROM {sm})""",
        f"""{co} AS (SELECT *,
  CASE p WHEN 0 THEN 0.0 WHEN 1 THEN b1 / NULLIF(a11, 0)
         ELSE (b1 * a22 - b2 * a12) / NULLIF(a11 * a22 - a12 * a12, 0) END AS phi1,
  CASE WHEN p = 2 THEN (a11 * b2 - a12 * b1) / NULLIF(a11 * a22 - a12 * a12, 0) ELSE 0.0 END AS phi2 FROM {nq})""",
        f"""{zh} AS (SELECT *,
  (CASE WHEN d = 0 THEN (Sy - phi1 * S1 - phi2 * S2) / NULLIF(CAST(E AS DOUBLE), 0) ELSE 0.0 END)
  + (CASE WHEN p >= 1 THEN phi1 * zm ELSE 0.0 END) + (CASE WHEN p = 2 THEN phi2 * zm1 ELSE 0.0 END) AS zhat FROM {co})""",
        f"""{fc} AS (SELECT country, metric, p, d, 0 AS q,
  CASE WHEN E >= greatest(p + CASE WHEN d = 0 THEN 1 ELSE 0 END, 1) AND isfinite(yh) AND gaps = 0 THEN yh END AS forecast
  FROM (SELECT *, CASE d WHEN 0 THEN zhat WHEN 1 THEN ym + zhat ELSE 2 * ym - ym1 + zhat END AS yh FROM {zh}) x)""",
    ]


def _orthogonal(source: str, tag: str, variables: list[str], target: str, carried: str, tolerance: float) -> list[str]:
    """Regression by orthogonal projections, step by step: every variable is taken out of the later ones and
    the target, with rows of weight ``w`` = 1 counting. ``bad`` marks groups ``g`` in which a variable repeats
    the ones before. What is left of the target is the residual, and of a row with weight 0 and target 0 minus
    its prediction."""
    first = ", ".join(f"sum(w * {v} * {v}) OVER (PARTITION BY g) AS n_{v}" for v in variables)
    out = [f"{tag}0 AS (SELECT *, {first}, sum(w * {target} * {target}) OVER (PARTITION BY g) AS n_{target}, false AS bad FROM {source})"]
    for i, v in enumerate(variables):
        rest = [*variables[i + 1:], target]
        norm = f"sum(w * {v} * {v}) OVER (PARTITION BY g)"
        cols = ", ".join(f"{u} - coalesce(sum(w * {u} * {v}) OVER (PARTITION BY g) / nullif({norm}, 0), 0) * {v} AS {u}" for u in rest)
        kept = ", ".join(f"n_{x}" for x in [*variables, target])
        out.append(f"{tag}{i + 1} AS (SELECT {carried}, g, w, {kept}, {cols}, bad OR (use_{v} AND NOT coalesce({norm} > {tolerance} * n_{v}, false)) AS bad, "
                   + ", ".join(f"use_{x}" for x in variables) + f" FROM {tag}{i})")
    return out


def arma_ctes(months: int = -2) -> list[str]:
    """Adds ``ma``: (country, metric, p, d, q, forecast) for the 18 q > 0 orders, by orthogonal projections."""
    long_fit = _orthogonal("l1", "lo", ["o", "a", "b"], "v", "country, metric, d, t, m, e_rows", 1e-4)
    fit = _orthogonal("ds", "hr", ["o", "a", "b", "s", "u"], "v", "country, metric, p, d, q, probe, e_rows", 1e-4)
    return [
        "ce AS (SELECT country, metric, n - 1 AS m, avg(y) FILTER (WHERE t <= n - 1) AS mu, count(*) FILTER (WHERE y IS NULL) AS gaps FROM sl GROUP BY ALL)",
        """zd AS (SELECT sl.country, sl.metric, t, m, d, CASE d WHEN 0 THEN y - mu WHEN 1 THEN y - y_lag1 ELSE y - 2 * y_lag1 + y_lag2 END AS z
  FROM sl JOIN ce ON ce.country = sl.country AND ce.metric = sl.metric JOIN (VALUES (0), (1), (2)) dd(d) ON t <= m WHERE gaps = 0)""",
        "zl AS (SELECT *, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2 FROM zd WINDOW w AS (PARTITION BY country, metric, d ORDER BY t))",
        """l1 AS (SELECT country, metric, d, t, m, country || chr(1) || metric || chr(1) || d AS g, 1 AS w, count(*) OVER (PARTITION BY country, metric, d) AS e_rows,
  CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END AS o, z1 AS a, z2 AS b, z AS v, d = 0 AS use_o, true AS use_a, true AS use_b FROM zl WHERE t >= d + 3)""",
        *long_fit,
        """sh AS (SELECT country, metric, d, t, v AS e FROM (SELECT *, sum(v * v) OVER (PARTITION BY g) AS left_over FROM lo3) x
  WHERE NOT bad AND e_rows > CASE WHEN d = 0 THEN 3 ELSE 2 END AND left_over > 1e-9 * n_v)""",
        """ze AS (SELECT zl.*, sh.e, lag(sh.e, 1) OVER w AS e1, lag(sh.e, 2) OVER w AS e2 FROM zl LEFT JOIN sh USING (country, metric, d, t)
  WINDOW w AS (PARTITION BY country, metric, d ORDER BY t))""",
        "oq AS (SELECT a.p, b.q FROM (VALUES (0), (1), (2)) a(p), (VALUES (1), (2)) b(q))",
        """eq AS (SELECT country, metric, p, d, q, 'no' AS probe, 1 AS w, CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END AS o, CASE WHEN p >= 1 THEN z1 ELSE 0 END AS a,
    CASE WHEN p = 2 THEN z2 ELSE 0 END AS b, e1 AS s, CASE WHEN q = 2 THEN e2 ELSE 0 END AS u, z AS v FROM ze, oq WHERE t >= d + 3 + q AND e1 IS NOT NULL
  UNION ALL SELECT country, metric, p, d, q, 'next', 0, CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN p >= 1 THEN z ELSE 0 END,
    CASE WHEN p = 2 THEN z1 ELSE 0 END, e, CASE WHEN q = 2 THEN e1 ELSE 0 END, 0 FROM ze, oq WHERE t = m
  UNION ALL SELECT country, metric, p, d, q, name, 0, 0, CASE name WHEN 'a' THEN 1 ELSE 0 END, CASE name WHEN 'b' THEN 1 ELSE 0 END,
    CASE name WHEN 's' THEN 1 ELSE 0 END, CASE name WHEN 'u' THEN 1 ELSE 0 END, 0 FROM ze, oq, (VALUES ('a'), ('b'), ('s'), ('u')) pr(name) WHERE t = m)""",
        """ds AS (SELECT *, country || chr(1) || metric || chr(1) || p || chr(1) || d || chr(1) || q AS g, d = 0 AS use_o, p >= 1 AS use_a, p = 2 AS use_b, true AS use_s, q = 2 AS use_u,
  sum(w) OVER (PARTITION BY country, metric, p, d, q) AS e_rows FROM eq)""",
        *fit,
        """pr AS (SELECT country, metric, p, d, q, bool_or(bad) AS bad, max(e_rows) AS e_rows, max(CASE probe WHEN 'next' THEN -v END) AS zhat,
  coalesce(max(CASE WHEN probe = 'a' AND p >= 1 THEN -v END), 0) AS f1, coalesce(max(CASE WHEN probe = 'b' AND p = 2 THEN -v END), 0) AS f2,
  coalesce(max(CASE probe WHEN 's' THEN -v END), 0) AS h1, coalesce(max(CASE WHEN probe = 'u' AND q = 2 THEN -v END), 0) AS h2
  FROM hr5 GROUP BY country, metric, p, d, q)""",
        """fi AS (SELECT pr.*, mu + zhat AS y0, sl.y + zhat AS y1, 2 * sl.y - sl.y_lag1 + zhat AS y2 FROM pr JOIN ce USING (country, metric)
  JOIN sl ON sl.country = pr.country AND sl.metric = pr.metric AND sl.t = ce.m
  WHERE NOT bad AND e_rows >= p + q + CASE WHEN d = 0 THEN 1 ELSE 0 END AND abs(f2) < 1 AND f1 + f2 < 1 AND f2 - f1 < 1
    AND abs(h2) < 1 AND -h1 - h2 < 1 AND h1 - h2 < 1)""",
        """ma AS (SELECT s.country, s.metric, oq.p, dd.d, oq.q, CASE dd.d WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END AS forecast
  FROM (SELECT DISTINCT country, metric FROM st WHERE n > 1) s CROSS JOIN oq CROSS JOIN (VALUES (0), (1), (2)) dd(d)
  LEFT JOIN fi ON fi.country = s.country AND fi.metric = s.metric AND fi.p = oq.p AND fi.d = dd.d AND fi.q = oq.q)""",
    ]


def all_best_ctes(months: int = -2) -> list[str]:
    """Adds ``bo``: the winner of all 27 orders."""
    return ar_ctes(months) + arma_ctes(months) + [
        "fa AS (SELECT * FROM fc UNION ALL SELECT * FROM ma)",
        """sc AS (SELECT fa.*, power(st.y - fa.forecast, 2) AS mse FROM fa
  JOIN st ON st.country = fa.country AND st.metric = fa.metric AND st.t = st.n WHERE fa.forecast IS NOT NULL)""",
        """bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, metric ORDER BY mse, p, d, q) AS rk FROM sc) x WHERE rk = 1)""",
    ]


def best_ctes(months: int = -2, direction: str = "forward") -> list[str]:
    """Adds ``bo``: the winning q = 0 order per series with its forecast and error."""
    return ar_ctes(months, direction=direction) + [
        """sc AS (SELECT fc.*, power(st.y - fc.forecast, 2) AS mse FROM fc
  JOIN st ON st.country = fc.country AND st.metric = fc.metric AND st.t = st.n
  WHERE fc.forecast IS NOT NULL)""",
        """bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, metric ORDER BY mse, p, d, q) AS rk
  FROM sc) x WHERE rk = 1)""",
    ]


def forecast_table_sql(months: int = -2, direction: str = "forward", orders: str = "ar", digits: int = 6) -> str:
    piv = ",\n  ".join(f"max(CASE WHEN metric = '{m}' THEN forecast END) AS {m}" for m in METRIC_NAMES)
    complete = " AND ".join(f"w.{m} IS NOT NULL" for m in METRIC_NAMES)
    outs = ", ".join(f"round(CASE WHEN {complete} THEN w.{m} ELSE 0.0 END, {digits}) AS {m}" for m in METRIC_NAMES)
    ctes = (best_ctes(months, direction) if orders == "ar" else all_best_ctes(months)) + [f"wd AS (SELECT country, {piv} FROM bo GROUP BY country)",
                                "cn AS (SELECT DISTINCT country FROM ev WHERE country IS NOT NULL)"]
    return ("WITH " + ",\n".join(ctes) +
            f"\nSELECT cn.country, {outs}, NOT ({complete}) AS is_fallback"
            "\nFROM cn LEFT JOIN wd w ON cn.country = w.country")


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ------------------------------------------------------------------ SOM / risk family

def som_ctes(months: int = -2, sigma: float = 1.0, rate: float = 0.5) -> list[str]:
    """Adds: stt (feature stats), feat (z-scored weekly vectors), cb0 (grid init),
    bm (best-matching unit on cb0), cb1 (one batch epoch), um (distance map of cb1),
    fv (scaled forecast vectors), fr (risk per forecast row)."""
    ms = METRIC_NAMES
    stats = ", ".join(f"avg(CAST({m} AS DOUBLE)) AS m{i}, stddev_samp(CAST({m} AS DOUBLE)) AS s{i}" for i, m in enumerate(ms))
    scaled = ", ".join(f"CASE WHEN s{i} > 0 THEN (CAST({m} AS DOUBLE) - m{i}) / s{i} ELSE 0.0 END AS f{i}" for i, m in enumerate(ms))
    rng = ", ".join(f"min(f{i}) AS lo{i}, max(f{i}) AS hi{i}" for i in range(5))
    init = ", ".join(f"lo{i} + (hi{i} - lo{i}) * ({'gx.x' if i % 2 == 0 else 'gy.y'} + 0.5) / 5 AS w{i}" for i in range(5))
    d2 = " + ".join(f"(f{i} - w{i}) * (f{i} - w{i})" for i in range(5))
    sums = ", ".join(f"sum(f{i}) AS s{i}" for i in range(5))
    h = f"exp(-((cb0.x - ag.bx) * (cb0.x - ag.bx) + (cb0.y - ag.by) * (cb0.y - ag.by)) / (2.0 * {sigma} * {sigma}))"
    nums = ", ".join(f"sum({h} * ag.s{i}) AS num{i}" for i in range(5))
    upd = ", ".join(f"CASE WHEN den > 0 THEN w{i} + {rate} * (num{i} / den - w{i}) ELSE w{i} END AS w{i}" for i in range(5))
    dist = " + ".join(f"(a.w{i} - b.w{i}) * (a.w{i} - b.w{i})" for i in range(5))
    fscaled = ", ".join(f"CASE WHEN s{i} > 0 THEN (CAST(fo.{m} AS DOUBLE) - m{i}) / s{i} ELSE 0.0 END AS f{i}"
                        for i, m in enumerate(ms))
    fvals = ", ".join(f"CASE WHEN {' AND '.join(f'w.{x} IS NOT NULL' for x in ms)} THEN w.{m} ELSE 0.0 END AS {m}" for m in ms)
    piv = ", ".join(f"max(CASE WHEN metric = '{m}' THEN forecast END) AS {m}" for m in METRIC_NAMES)
    return best_ctes(months) + [
        f"wd AS (SELECT country, {piv} FROM bo GROUP BY country)",
        "cn AS (SELECT DISTINCT country FROM ev WHERE country IS NOT NULL)",
        f"stt AS (SELECT {stats} FROM wm)",
        f"feat AS (SELECT country, week, {scaled} FROM wm, stt)",
        f"rng AS (SELECT {rng} FROM feat WHERE f0 + f1 + f2 + f3 + f4 IS NOT NULL)",
        f"cb0 AS (SELECT CAST(gx.x AS INTEGER) AS x, CAST(gy.y AS INTEGER) AS y, {init} FROM rng, range(5) gx(x), range(5) gy(y))",
        f"""bm AS (SELECT * REPLACE (CASE WHEN d2 IS NOT NULL THEN bmu_x END AS bmu_x, CASE WHEN d2 IS NOT NULL THEN bmu_y END AS bmu_y)
  FROM (SELECT feat.*, cb0.x AS bmu_x, cb0.y AS bmu_y, {d2} AS d2,
  row_number() OVER (PARTITION BY feat.country, feat.week ORDER BY {d2}, cb0.x, cb0.y) AS rk
  FROM feat, cb0) z WHERE rk = 1)""",
        f"ag AS (SELECT bmu_x AS bx, bmu_y AS by, count(*) AS n, {sums} FROM bm WHERE bmu_x IS NOT NULL GROUP BY bmu_x, bmu_y)",
        f"""sw AS (SELECT cb0.x, cb0.y, any_value(cb0.w0) AS w0, any_value(cb0.w1) AS w1, any_value(cb0.w2) AS w2,
  any_value(cb0.w3) AS w3, any_value(cb0.w4) AS w4, {nums}, sum({h} * ag.n) AS den
  FROM cb0, ag GROUP BY cb0.x, cb0.y)""",
        f"cb1 AS (SELECT x, y, {upd} FROM sw)",
        f"""us AS (SELECT a.x, a.y, sum(sqrt({dist})) AS u_sum FROM cb1 a JOIN cb1 b
  ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY a.x, a.y)""",
        "um AS (SELECT x, y, CASE WHEN max(u_sum) OVER () > 0 THEN u_sum / max(u_sum) OVER () ELSE 0.0 END AS u FROM us)",
        f"fo AS (SELECT cn.country, {fvals} FROM cn LEFT JOIN wd w ON cn.country = w.country)",
        f"fv AS (SELECT fo.country, {fscaled} FROM fo, stt)",
        f"""fb AS (SELECT * FROM (SELECT fv.*, cb1.x AS bmu_x, cb1.y AS bmu_y,
  row_number() OVER (PARTITION BY fv.country ORDER BY {d2.replace('w', 'cb1.w')}, cb1.x, cb1.y) AS rk FROM fv, cb1) z WHERE rk = 1)""",
        "fr AS (SELECT fb.country, um.u AS distance FROM fb LEFT JOIN um ON fb.bmu_x = um.x AND fb.bmu_y = um.y)",
    ]


def mean_map_ctes() -> list[str]:
    """Adds to ``som_ctes``: umm (distance map of cb1 by mean instead of summed distances)."""
    dist = " + ".join(f"pow(a.w{i} - b.w{i}, 2)" for i in range(5))
    return [
        f"""near AS (SELECT a.x, a.y, (SELECT avg(sqrt({dist})) FROM cb1 b
  WHERE greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1) AS u_mean FROM cb1 a)""",
        "umm AS (SELECT x, y, coalesce(u_mean / nullif((SELECT max(u_mean) FROM near), 0), 0.0) AS u FROM near)",
    ]


def som_init_ctes(source: str, seed: int = 7) -> list[str]:
    """Adds ``k0``: the first 25 rows of ``source`` (id, f0..f4) by md5 of id and seed, cycled if fewer."""
    fs = ", ".join(f"f{i}" for i in range(5))
    ws = ", ".join(f"f{i} AS w{i}" for i in range(5))
    return [
        f"tr AS MATERIALIZED (SELECT id, {fs} FROM {source} WHERE f0 + f1 + f2 + f3 + f4 IS NOT NULL)",
        f"rn AS (SELECT {fs}, row_number() OVER (ORDER BY md5(id || '|{seed}'), id) - 1 AS i, count(*) OVER () AS n FROM tr)",
        f"k0 AS MATERIALIZED (SELECT CAST(c.i // 5 AS INTEGER) AS x, CAST(c.i % 5 AS INTEGER) AS y, {ws} FROM range(25) c(i) JOIN rn ON rn.i = c.i % least(rn.n, 25))",
    ]


def som_train_ctes(source: str, epochs: int = 10, seed: int = 7, sigma: float = 1.0, rate: float = 0.5) -> list[str]:
    """Adds ``k0`` to ``k{epochs}``: the codebook after every epoch, unrolled."""
    out = som_init_ctes(source, seed)
    d2 = " + ".join(f"(tr.f{i} - k.w{i}) * (tr.f{i} - k.w{i})" for i in range(5))
    fs = ", ".join(f"tr.f{i}" for i in range(5))
    for t in range(epochs):
        decay = 1.0 / (1.0 + t / (epochs / 2.0))
        s, r = sigma * decay, rate * decay
        near = f"exp(-((k.x - b.x) * (k.x - b.x) + (k.y - b.y) * (k.y - b.y)) / (2.0 * {s!r} * {s!r}))"
        ups = ", ".join(f"CASE WHEN sum({near} * b.n) > 0 THEN any_value(k.w{i}) + {r!r} * (sum({near} * b.s{i}) / sum({near} * b.n) - any_value(k.w{i})) ELSE any_value(k.w{i}) END AS w{i}" for i in range(5))
        out += [
            f"""b{t} AS MATERIALIZED (SELECT x, y, count(*) AS n, {", ".join(f"sum(f{i}) AS s{i}" for i in range(5))}
  FROM (SELECT {fs}, k.x, k.y, row_number() OVER (PARTITION BY tr.id ORDER BY {d2}, k.x, k.y) AS o FROM tr CROSS JOIN k{t} k) z WHERE o = 1 GROUP BY x, y)""",
            f"k{t + 1} AS MATERIALIZED (SELECT k.x, k.y, {ups} FROM k{t} k CROSS JOIN b{t} b GROUP BY k.x, k.y)"]
    return out


WEIGHTS = ", ".join(f"round(w{i}, 6) AS w{i}" for i in range(5))


def reference_train_ctes() -> list[str]:
    """Global weekly metrics over four months, unscaled, as ``gf`` (id, f0..f4)."""
    fs = ", ".join(f"CAST({m} AS DOUBLE) AS f{i}" for i, m in enumerate(METRIC_NAMES))
    return [f"gw AS MATERIALIZED ({weekly_sql(-4, by_country=False)})", f"gf AS (SELECT CAST(week AS VARCHAR) AS id, {fs} FROM gw)"]


def reference_risk_sql() -> str:
    """Per-country forecasts scored on the codebook trained on global weeks, both unscaled."""
    dist = " + ".join(f"(a.w{i} - b.w{i}) * (a.w{i} - b.w{i})" for i in range(5))
    d2 = " + ".join(f"(fo.{m} - k.w{i}) * (fo.{m} - k.w{i})" for i, m in enumerate(METRIC_NAMES))
    ctes = reference_train_ctes() + som_train_ctes("gf") + som_ctes() + [
        f"""gu AS (SELECT a.x, a.y, sum(sqrt({dist})) AS u FROM k10 a JOIN k10 b
  ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY a.x, a.y)""",
        f"gb AS (SELECT fo.country, k.x, k.y, row_number() OVER (PARTITION BY fo.country ORDER BY {d2}, k.x, k.y) AS o FROM fo CROSS JOIN k10 k)",
    ]
    return with_ctes(ctes, "SELECT gb.country, round(CASE WHEN m > 0 THEN u / m ELSE 0.0 END, 6) AS distance FROM gb JOIN gu ON gu.x = gb.x AND gu.y = gb.y "
                           "CROSS JOIN (SELECT max(u) AS m FROM gu) top WHERE o = 1")


# ------------------------------------------------------------------ sourcing family

def budget_case(col: str = "risk_aversion") -> str:
    return f"CASE {col} WHEN 'Low' THEN 0.75 WHEN 'Medium' THEN 0.5 WHEN 'High' THEN 0.25 ELSE 0.5 END"


def sourcing_ctes() -> list[str]:
    """o (offers), rk (risk), bg (budgets), bad (requests with an unscored country),
    u (usable scored offers of scored requests), its (item rank k), ni (items per request),
    st (request status)."""
    return [
        f"ol AS ({OFFERS_SQL})",
        """o1 AS (SELECT request_id, item_pos, item, country, min(offer_pos) AS offer_pos, arg_max(cost, offer_pos) AS cost
  FROM ol GROUP BY ALL)""",
        "lp AS (SELECT request_id, item, max(item_pos) AS src FROM ol GROUP BY ALL)",
        """o AS (SELECT ps.request_id, ps.item_pos, ps.item, o1.offer_pos, o1.country, o1.cost
  FROM (SELECT DISTINCT request_id, item, item_pos FROM ol) ps JOIN lp USING (request_id, item)
  JOIN o1 ON o1.request_id = ps.request_id AND o1.item = ps.item AND o1.item_pos = lp.src)""",
        f"rk AS ({RISK_SQL})",
        f"""bg AS (SELECT request_id, risk_aversion, CAST({budget_case()} AS DOUBLE) AS budget
  FROM (SELECT request_id, {APPETITE_SQL} AS risk_aversion FROM (SELECT DISTINCT request_id FROM ol) r0) r1)""",
        "bad AS (SELECT DISTINCT ol.request_id FROM ol LEFT JOIN rk USING (country) WHERE rk.distance IS NULL)",
        """u0 AS (SELECT o.request_id, o.item_pos, o.item, o.offer_pos, o.country, o.cost, rk.distance
  FROM o JOIN rk USING (country) WHERE o.cost > 0)""",
        "u AS (SELECT * FROM u0 WHERE request_id NOT IN (SELECT request_id FROM bad))",
        """its AS (SELECT request_id, item_pos,
  CAST(dense_rank() OVER (PARTITION BY request_id ORDER BY item_pos) - 1 AS INTEGER) AS k
  FROM (SELECT DISTINCT request_id, item_pos FROM o) x)""",
        "ni AS (SELECT request_id, count(*) AS nitems FROM its GROUP BY request_id)",
        """pi AS (SELECT its.request_id, its.item_pos, min(u0.distance) AS r_min FROM its
  LEFT JOIN u0 ON u0.request_id = its.request_id AND u0.item_pos = its.item_pos GROUP BY its.request_id, its.item_pos)""",
        """rs AS (SELECT pi.request_id, sum(r_min) AS min_risk, count(*) FILTER (WHERE r_min IS NULL) AS n_unusable,
  any_value(bg.budget) AS budget FROM pi JOIN bg USING (request_id) GROUP BY pi.request_id)""",
        """sts AS (SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM bad) THEN 'missing_risk'
  WHEN n_unusable > 0 OR min_risk > budget + 1e-9 THEN 'infeasible' ELSE 'ok' END AS status, min_risk, budget FROM rs)""",
    ]


def exact_sql() -> str:
    ctes = sourcing_ctes() + [
        "uk AS (SELECT u.*, its.k FROM u JOIN its USING (request_id, item_pos))",
        """comb AS (
  SELECT uk.request_id, uk.k, uk.cost AS tc, uk.distance AS tr, [uk.offer_pos] AS path
  FROM uk JOIN bg USING (request_id) WHERE uk.k = 0 AND uk.distance <= bg.budget + 1e-9
  UNION ALL
  SELECT c.request_id, uk.k, c.tc + uk.cost, c.tr + uk.distance, list_append(c.path, uk.offer_pos)
  FROM comb c JOIN uk ON uk.request_id = c.request_id AND uk.k = c.k + 1 JOIN bg ON bg.request_id = c.request_id
  WHERE c.tr + uk.distance <= bg.budget + 1e-9)""",
        """best AS (SELECT * FROM (SELECT comb.*, row_number() OVER (PARTITION BY comb.request_id ORDER BY tc, tr, path) AS rn
  FROM comb JOIN ni USING (request_id) WHERE comb.k = ni.nitems - 1) z WHERE rn = 1)""",
        """sel AS (SELECT uk.request_id, uk.item_pos, uk.item, uk.country, uk.cost, uk.distance, 'optimal' AS status
  FROM best JOIN uk ON uk.request_id = best.request_id AND uk.offer_pos = best.path[uk.k + 1])""",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes)


def exact_large_sql() -> str:
    """Least cost by risk in thousandths, item by item; only costs that no lower risk reaches are carried on."""
    return f"""WITH RECURSIVE ol AS ({OFFERS_SQL}), rk AS ({RISK_SQL}),
br AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS request_id FROM part),
li AS (SELECT request_id * 4 + item_pos AS p_partkey, country, arg_max(cost, offer_pos) AS cost FROM ol WHERE cost > 0 AND country <> 'UNSCORED' GROUP BY ALL),
o AS MATERIALIZED (SELECT br.request_id, dense_rank() OVER (PARTITION BY br.request_id ORDER BY p_partkey) AS k, cost, CAST(round(rk.distance * 1000) AS BIGINT) AS r
  FROM li JOIN br USING (p_partkey) JOIN rk USING (country)),
it AS (SELECT request_id, k, min(r) AS lo, arg_min(r, cost * 1000 + r) AS hi FROM o GROUP BY ALL),
bg AS MATERIALIZED (SELECT request_id, max(k) AS n, (sum(lo) + sum(hi)) // 2 AS budget FROM it GROUP BY request_id),
rest AS MATERIALIZED (SELECT request_id, k, sum(lo) OVER (PARTITION BY request_id ORDER BY k DESC) - lo AS after FROM it),
pt AS MATERIALIZED (SELECT * FROM (SELECT *, min(r) OVER (PARTITION BY request_id, k ORDER BY cost, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM o) z WHERE pm IS NULL OR r < pm),
dp AS (
  SELECT request_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS r, CAST(0 AS DOUBLE) AS cost FROM bg
  UNION ALL
  SELECT request_id, k, r, cost FROM (
    SELECT s.*, min(cost) OVER (PARTITION BY request_id ORDER BY r, cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cheaper FROM (
      SELECT dp.request_id, pt.k, dp.r + pt.r AS r, min(dp.cost + pt.cost) AS cost FROM dp JOIN pt ON pt.request_id = dp.request_id AND pt.k = dp.k + 1
      JOIN bg ON bg.request_id = dp.request_id JOIN rest ON rest.request_id = dp.request_id AND rest.k = pt.k
      WHERE dp.r + pt.r + rest.after <= bg.budget GROUP BY ALL) s) z WHERE cheaper IS NULL OR cost < cheaper)
SELECT dp.request_id, CAST(n AS BIGINT) AS n_items, min(cost) AS total_cost FROM dp JOIN bg ON bg.request_id = dp.request_id AND dp.k = bg.n GROUP BY dp.request_id, n"""


def relaxed_sql() -> str:
    """Hull vertices by self-joins of each item's undominated offers, then running sums."""
    same = "b.request_id = a.request_id AND b.item_pos = a.item_pos"
    ctes = sourcing_ctes() + [
        """pt AS (SELECT * FROM (SELECT u.*, min(distance) OVER (PARTITION BY request_id, item_pos ORDER BY cost, distance, offer_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM u
  WHERE request_id IN (SELECT request_id FROM sts WHERE status = 'ok')) z WHERE pm IS NULL OR distance < pm)""",
        f"""lo AS (SELECT a.request_id, a.item_pos, a.offer_pos, max((a.cost - b.cost) / (b.distance - a.distance)) AS s
  FROM pt a JOIN pt b ON {same} AND b.cost < a.cost GROUP BY ALL)""",
        f"""hi AS (SELECT a.request_id, a.item_pos, a.offer_pos, min((b.cost - a.cost) / (a.distance - b.distance)) AS s
  FROM pt a JOIN pt b ON {same} AND b.cost > a.cost GROUP BY ALL)""",
        """hv AS (SELECT pt.*, lag(pt.cost) OVER w AS c0, lag(distance) OVER w AS r0 FROM pt
  LEFT JOIN lo USING (request_id, item_pos, offer_pos) LEFT JOIN hi USING (request_id, item_pos, offer_pos)
  WHERE coalesce(lo.s, -1) < coalesce(hi.s, CAST('infinity' AS DOUBLE))
  WINDOW w AS (PARTITION BY pt.request_id, pt.item_pos ORDER BY pt.cost))""",
        """sp AS (SELECT hv.*, CASE WHEN c0 IS NULL THEN -1.0 ELSE (cost - c0) / -(distance - r0) END AS lam,
  coalesce(cost - c0, cost) AS dc, coalesce(distance - r0, distance) AS dr FROM hv)""",
        """ru AS (SELECT sp.*, sum(dc) OVER w AS tc, sum(dr) OVER w AS tr, count(*) OVER w AS k,
  count(*) FILTER (WHERE c0 IS NULL) OVER (PARTITION BY request_id) AS n FROM sp
  WINDOW w AS (PARTITION BY request_id ORDER BY lam, item_pos, cost ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        """bl AS (SELECT * FROM (SELECT ru.*, bg.budget, row_number() OVER (PARTITION BY request_id ORDER BY lam, item_pos, cost) AS rn
  FROM ru JOIN bg USING (request_id) WHERE k >= n AND tr <= budget + 1e-9) z WHERE rn = 1)""",
        """pk AS (SELECT * FROM (SELECT ru.*, row_number() OVER (PARTITION BY ru.request_id, ru.item_pos ORDER BY ru.cost DESC) AS rn
  FROM ru JOIN bl ON bl.request_id = ru.request_id
  WHERE (ru.lam, ru.item_pos, ru.cost) <= (bl.lam, bl.item_pos, bl.cost)) z WHERE rn = 1)""",
        """lb AS (SELECT request_id, CASE WHEN lam > 0 THEN tc + lam * (tr - budget) ELSE tc END AS lower_bound FROM bl)""",
    ]
    return "WITH " + ",\n".join(ctes)
