"""Weekly metrics per country (or globally): three sums and two robust centres.

The reference computes, per week, the sums of mentions, sources and articles and
the mean tone and Goldstein score over the rows that are in the lower half of the
week by tone *and* in the lower half by Goldstein (``NTILE(2) = 1`` on both). It
joins the two results on the week, which drops weeks where the halves do not
overlap, and semi-joins a set of recent weeks that can never remove a row.

``weekly_metrics`` does the same in one aggregate: one filtered scan, exact
lower-half flags, then one ``groupBy`` with three sums, two conditional averages
and ``count_if(both) > 0`` in place of the inner join. ``weekly_metrics_join`` is
the literal form, kept as a test twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.codes import ROOT_CODES, root_code_in
from riskloom.functions.dates import as_date, lookback_start, week_of
from riskloom.operators.ranks import group_medians, lower_half_flags

# Canonical event columns (see riskloom.sources.files for the raw-file adapter).
EVENT_COLUMNS = ("country", "event_date", "root_code", "num_mentions", "num_sources",
                 "num_articles", "avg_tone", "goldstein")
METRICS = ("total_mentions", "total_sources", "total_articles", "center_tone", "center_goldstein")


def lookback_filter(ev: DataFrame, as_of, months: int) -> DataFrame:
    """Events from ``add_months(week_of(as_of), months)`` up to and including as_of.
    Stored weeks (``week``, and the ``week_folder`` of a bucketed table) are bounded too, so
    the scan reads only the folders of the weeks in the window."""
    start = lookback_start(as_of, months)
    out = ev.filter((F.col("event_date") >= start) & (F.col("event_date") <= F.lit(as_date(as_of))))
    for stored in [c for c in ("week", "week_folder") if c in ev.columns]:
        out = out.filter((F.col(stored) >= F.trunc(start, "week")) & (F.col(stored) <= F.lit(as_date(as_of))))
    return out


def root_code_filter(ev: DataFrame, codes=ROOT_CODES, strict: bool = False) -> DataFrame:
    return ev.filter(root_code_in("root_code", codes, strict))


def one_country(ev: DataFrame, code: str) -> DataFrame:
    if code is None or code == "":
        raise ValueError("a country code is required")
    return ev.filter(F.col("country") == F.lit(code))


def distinct_countries(ev: DataFrame) -> DataFrame:
    """Distinct non-NULL countries (a NULL country cannot name a forecast row)."""
    return ev.select("country").filter(F.col("country").isNotNull()).distinct()


def dropped_countries(ev: DataFrame) -> DataFrame:
    """Events that no country series can take, by reason (one row)."""
    return ev.agg(F.count_if(F.col("country").isNull()).alias("null_country"),
                  F.count_if(F.col("country") == "").alias("empty_country"))


def recent_weeks(ev: DataFrame, as_of, months: int) -> DataFrame:
    return lookback_filter(ev, as_of, months).select(week_of("event_date").alias("week")).distinct()


def unrest_events(ev: DataFrame, as_of, months: int = -2, codes=ROOT_CODES, strict_codes: bool = False,
                  by: Sequence[str] = ("country",), drop_partial_weeks: bool = False) -> DataFrame:
    """The event rows every weekly metric is computed from, with a ``week`` column.
    Rows with a NULL grouping column are dropped (they cannot name a series)."""
    out = root_code_filter(lookback_filter(ev, as_of, months), codes, strict_codes)
    for b in by:
        out = out.filter(F.col(b).isNotNull())
    if "week" not in ev.columns:  # a stored week keeps the table's buckets usable
        out = out.withColumn("week", week_of("event_date"))
    if drop_partial_weeks:
        out = out.filter((F.col("week") >= lookback_start(as_of, months))
                         & (F.date_add(F.col("week"), 6) <= F.lit(as_date(as_of))))
    return out


def _totals(ev: DataFrame, group: Sequence[str]) -> DataFrame:
    return ev.groupBy(*group).agg(
        F.sum("num_mentions").cast("long").alias("total_mentions"),
        F.sum("num_sources").cast("long").alias("total_sources"),
        F.sum("num_articles").cast("long").alias("total_articles"))


def weekly_totals(ev: DataFrame, as_of, months: int = -2, by: Sequence[str] = ("country",), **kw) -> DataFrame:
    """A1/A2: weekly sums per ``by`` (``by=()`` for the global grain)."""
    f = unrest_events(ev, as_of, months, by=by, **kw)
    return _totals(f, [*by, "week"])


def lower_half_mean(ev: DataFrame, as_of, months: int = -2, by: Sequence[str] = ("country",),
                    key: Sequence[str] = ("event_id",), strategy: str = "counts", **kw) -> DataFrame:
    """A3/A4: mean tone and Goldstein over the overlap of both lower halves."""
    f = unrest_events(ev, as_of, months, by=by, **kw)
    return _centre_agg(f, [*by, "week"], key, strategy, with_totals=False)


def _centre_agg(f: DataFrame, group: list[str], key: Sequence[str], strategy: str, with_totals: bool) -> DataFrame:
    # Only what the aggregate reads; rows at a threshold are ranked among themselves.
    needed = dict.fromkeys([*group, *key, "avg_tone", "goldstein", *(["num_mentions", "num_sources", "num_articles"] if with_totals else [])])
    flagged, (lt, lg) = lower_half_flags(f.select(*needed), group, ["avg_tone", "goldstein"], key, strategy)
    both = F.col(lt) & F.col(lg)
    aggs = []
    if with_totals:
        aggs += [F.sum("num_mentions").cast("long").alias("total_mentions"),
                 F.sum("num_sources").cast("long").alias("total_sources"),
                 F.sum("num_articles").cast("long").alias("total_articles")]
    aggs += [F.avg(F.when(both, F.col("avg_tone"))).alias("center_tone"),
             F.avg(F.when(both, F.col("goldstein"))).alias("center_goldstein"),
             F.count_if(both).alias("_n_core")]
    # count_if > 0, not "average is not null": a week whose kept rows all have NULL tone stays.
    return flagged.groupBy(*group).agg(*aggs).filter(F.col("_n_core") > 0).drop("_n_core")


def weekly_metrics(ev: DataFrame, as_of, months: int = -2, by: Sequence[str] = ("country",),
                   center: str = "lower_half_mean", key: Sequence[str] = ("event_id",),
                   codes=ROOT_CODES, strict_codes: bool = False, strategy: str = "counts",
                   drop_partial_weeks: bool = False) -> DataFrame:
    """Wide weekly metrics (FIXTURES D6) for every ``by`` group in one pass.

    ``center='lower_half_mean'`` reproduces the reference values (weeks without an
    overlap of both lower halves are dropped); ``center='median'`` gives true medians
    and keeps every week. ``by=()`` is the global grain used for SOM training.
    """
    if center not in ("lower_half_mean", "median"):
        raise ValueError("center must be 'lower_half_mean' or 'median'")
    f = unrest_events(ev, as_of, months, codes, strict_codes, by, drop_partial_weeks)
    group = [*by, "week"]
    if center == "lower_half_mean":
        return _centre_agg(f, group, key, strategy, with_totals=True)
    med = group_medians(f, group, ["avg_tone", "goldstein"], strategy)
    return (_totals(f, group).join(med, group, "inner")
            .withColumnRenamed("median_avg_tone", "center_tone")
            .withColumnRenamed("median_goldstein", "center_goldstein"))


def weekly_median(ev: DataFrame, as_of, months: int = -2, by: Sequence[str] = ("country",),
                  strategy: str = "counts", **kw) -> DataFrame:
    """A5: true medians of tone and Goldstein per group and week."""
    f = unrest_events(ev, as_of, months, by=by, **kw)
    return group_medians(f, [*by, "week"], ["avg_tone", "goldstein"], strategy)


def tone_halves(ev: DataFrame, value: str, as_of, months: int = -2, by: Sequence[str] = ("country",),
                key: Sequence[str] = ("event_id",), strategy: str = "counts", **kw) -> DataFrame:
    """Every filtered event with its NTILE(2) bucket (1 or 2) by ``value``."""
    f = unrest_events(ev, as_of, months, by=by, **kw)
    flagged, (flag,) = lower_half_flags(f, [*by, "week"], [value], key, strategy)
    return flagged.withColumn("half", F.when(F.col(flag), 1).otherwise(2).cast("long")).drop(flag)


def weekly_metrics_join(ev: DataFrame, as_of, months: int = -2, by: Sequence[str] = ("country",),
                        key: Sequence[str] = ("event_id",), codes=ROOT_CODES, strict_codes: bool = False) -> DataFrame:
    """J1 + J2, the literal form: totals JOIN centres ON week, semi-joined to recent weeks.
    Uses one window per group (fine for tests; the default plan is ``weekly_metrics``)."""
    f = unrest_events(ev, as_of, months, codes, strict_codes, by)
    group = [*by, "week"]
    totals = _totals(f, group)
    wt = Window.partitionBy(*group).orderBy(F.col("avg_tone").asc_nulls_last(), *key)
    wg = Window.partitionBy(*group).orderBy(F.col("goldstein").asc_nulls_last(), *key)
    centres = (f.withColumn("_tn", F.ntile(2).over(wt)).withColumn("_gn", F.ntile(2).over(wg))
               .filter((F.col("_tn") == 1) & (F.col("_gn") == 1))
               .groupBy(*group).agg(F.avg("avg_tone").alias("center_tone"),
                                    F.avg("goldstein").alias("center_goldstein")))
    joined = totals.join(centres, group, "inner")
    return joined.join(recent_weeks(ev, as_of, months), "week", "left_semi")


def weekly_desc(weekly: DataFrame) -> DataFrame:
    """O1: newest week first (presentation only; series code orders by ``t``)."""
    return weekly.orderBy(F.col("week").desc(), *[F.col(c) for c in weekly.columns if c != "week"])
