"""Exact order statistics per group that never put a whole group into one task.

Lower halves (``NTILE(2) = 1``) and medians need the position of a row inside its group. A
window over ``PARTITION BY group`` is exact but hands every row of a group to a single task:
one hot country-week (or the single group of a global grain) then becomes one straggler.

``value_thresholds`` finds the value at a rank from counts:

1. rows are counted per (group, value), combined before the shuffle, all values in one pass;
2. the counts are summed per (group, coarse value), a few thousand steps however many values
   there are, and cumulated to the step that holds the rank;
3. only the values inside this step are cumulated to the value itself.

A half is then a comparison with its threshold. Rows *at* a threshold that takes only some of
them are the only ones that are ranked, by their keys. Nothing of the data's size is written,
and the counts may as well come from a table that is kept up to date (``weight``).

``running_sums`` numbers all rows of a group or cumulates columns over them:

1. range-partition all rows by (group, order), note each row's partition and store the
   table, so that everything below reads the same split of the rows;
2. sum per (group, partition). This table has at most partitions + groups rows; a window
   over it gives each piece of a group its start;
3. a window inside each piece adds the running sum of the rows before.

Rows that are equal in every column are interchangeable: a half takes exactly its number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans.broadcast import BROADCAST_ROW_LIMIT
from riskloom.session import materialize

#: Up to so many rows at one threshold are ranked by a window; more are dealt over ranges.
WINDOW_ROWS = 1_000_000
#: Coarse steps per doubling of a value.
STEPS = 256

def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, str],
                 partitions: int | None = None) -> DataFrame:
    """``df`` plus, for each ``name: column`` of ``sums``, the sum of the column over the
    group's rows up to and including this one in ``order`` (names of non-null columns that
    order the rows totally, but for equal rows), and ``{name}_all``, the group's sum."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *group, *order).withColumn("_piece", F.spark_partition_id())
    laid = materialize(laid, "laid-out")
    pieces = laid.groupBy(*group, "_piece").agg(*[F.sum(c).alias(f"_{n}_piece") for n, c in sums.items()])
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*group, "_piece",
                           *[F.coalesce(F.sum(f"_{n}_piece").over(upto), F.lit(0)).alias(f"_{n}_start") for n in sums],
                           *[F.sum(f"_{n}_piece").over(whole).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        laid = laid.withColumn(f"_{n}_inside", F.sum(c).over(inside))
    out = join_same(laid, pieces, [*group, "_piece"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_{n}_start") + F.col(f"_{n}_inside"))
    return out.drop("_piece", *[f"_{n}_start" for n in sums], *[f"_{n}_inside" for n in sums])


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal columns, in which NULL equals NULL; all columns of ``left`` and the others of ``right``."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in on])
    return left.join(right, same).drop(*[f"_r_{c}" for c in on])


def coarse_step(value: Column) -> Column:
    """A whole number that never falls as the value rises: equal steps of its logarithm, so any spread of
    values has a few thousand of them. NaN comes after infinity; null for null."""
    size = F.abs(value)
    step = F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.floor(F.log2(size) * STEPS) + 1100 * STEPS))
    far = F.lit(3000.0 * STEPS)
    step = F.when(F.isnan(value), far + 1).when(size == float("inf"), F.signum(value) * far).otherwise(step)
    return F.when(value.isNotNull(), step).cast("long")


def value_thresholds(df: DataFrame, group: Sequence[str], values: Sequence[str], ranks: Callable[[Column], list[Column]],
                     weight: str | None = None, nulls: bool = True) -> DataFrame:
    """The values at the given 1-based ranks (``ranks(n)`` maps a group's size to them; NULLs are last, or
    left out). One row per group, number of the value and rank: ``which``, ``rank``, ``v``, ``n`` (the group's
    rows), ``before`` (rows with smaller values) and ``at`` (rows with this one). ``weight``: a column with the
    number of rows that a row stands for."""
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    rows = df.select(*group, one.alias("one"), pairs.alias("p")).select(*group, "one", "p.which", "p.v")
    counts = (rows if nulls else rows.filter(F.col("v").isNotNull())).groupBy(*group, "which", "v").agg(F.sum("one").alias("at"))
    counts = counts.withColumn("step", coarse_step(F.col("v")))
    each = [*group, "which"]
    upto = Window.partitionBy(*each).orderBy(F.col("step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.groupBy(*each, "step").agg(F.sum("at").alias("rows"))
    steps = (steps.withColumn("start", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
             .withColumn("n", F.sum("rows").over(Window.partitionBy(*each))))
    steps = steps.withColumn("rank", F.explode(F.array_distinct(F.array(*ranks(F.col("n"))))))
    steps = steps.filter((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + F.col("rows"))).drop("rows")
    inside = join_same(counts, steps, [*each, "step"])
    order = Window.partitionBy(*each, "step", "rank").orderBy(F.col("v").asc_nulls_last())  # a rank has one step: dealt as for the join
    inside = inside.withColumn("upto", F.col("start") + F.sum("at").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("before", F.col("upto") - F.col("at"))
    return (inside.filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
            .select(*each, "rank", "v", "n", "before", "at"))


def half_thresholds(df: DataFrame, group: Sequence[str], values: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per group: for value number i the last value ``_t{i}`` of its lower half, how many of
    the rows with this value belong to it (``_need{i}``) and how many there are (``_at{i}``). Up to
    BROADCAST_ROW_LIMIT rows are local to the driver, as they are broadcast later; more are stored."""
    found = value_thresholds(df, group, values, lambda n: [F.floor((n + 1) / 2).cast("long")], weight)
    mine = [F.max(F.when(F.col("which") == i, c)).alias(f"_{name}{i}") for i in range(len(values))
            for name, c in (("t", F.col("v")), ("need", F.col("rank") - F.col("before")), ("at", F.col("at")))]
    found = found.groupBy(*group).agg(*mine)
    some = found.limit(BROADCAST_ROW_LIMIT + 1).collect()
    if len(some) <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df.sparkSession.createDataFrame(some, found.schema))
    return materialize(found, "half-thresholds")


def with_sides(df: DataFrame, thresholds: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``df`` plus ``_side{i}``: whether the row is in the lower half by value i, NULL if its key decides."""
    out = join_same(df, thresholds, group)
    for i, v in enumerate(values):
        value, last = F.col(v).cast("double"), F.col(f"_t{i}")
        below = F.when(value.isNull(), False).when(last.isNull(), True).otherwise(value < last)
        at = F.when(value.eqNullSafe(last), F.when(F.col(f"_need{i}") == F.col(f"_at{i}"), True)).otherwise(below)
        out = out.withColumn(f"_side{i}", at)
    return out


def undecided(values: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"_side{i}").isNull() for i in range(len(values))])


def rank_ties(ties: DataFrame, most: Sequence[int], group: Sequence[str], values: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Decides the NULL sides of ``ties`` by key, then a hash of the row. ``most``: for each value the most
    rows that any group has at a threshold that takes some of them."""
    columns = [c for c in ties.columns if not c.startswith(("_t", "_need", "_at", "_side"))]
    out = ties.withColumn("_row_hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    order = [*key, "_row_hash"]
    out = out.select("*", *[F.col(f"_side{i}").isNull().alias(f"_tie{i}") for i in range(len(values))])
    for i, v in enumerate(values):
        side, need = F.col(f"_side{i}"), F.col(f"_need{i}")
        if most[i] <= WINDOW_ROWS:  # no group has more rows to rank, so a task may hold them
            upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # one for all values
            rank = F.count_if(F.col(f"_tie{i}")).over(upto)
            out = out.withColumn(f"_side{i}", F.coalesce(side, rank <= need))
        else:
            ranked = running_sums(out.filter(side.isNull()).withColumn("_one", F.lit(1)), group, order, {"_rank": "_one"})
            ranked = ranked.withColumn(f"_side{i}", F.col("_rank") <= need).select(*out.columns)
            out = out.filter(side.isNotNull()).unionByName(ranked)
    return out.drop("_row_hash", *[f"_tie{i}" for i in range(len(values))])


def most_ties(thresholds: DataFrame, values: Sequence[str]) -> list[int]:
    row = thresholds.agg(*[F.max(F.when(F.col(f"_need{i}") < F.col(f"_at{i}"), F.col(f"_at{i}"))) for i in range(len(values))]).first()
    return [x or 0 for x in row]


def lower_half_flags(df: DataFrame, group: Sequence[str], values: Sequence[str], key: Sequence[str],
                     strategy: str = "counts") -> tuple[DataFrame, list[str]]:
    """Add one boolean ``_low_{value}`` per value: row is in NTILE(2) bucket 1 of its
    group when ordered by that value ascending, NULLs last, ties by ``key``.

    ``strategy='ranges'`` deals all rows at a threshold over ranges, however few they are;
    ``'window'`` is the literal window form, one task per group, for comparison."""
    if strategy not in ("counts", "ranges", "window"):
        raise ValueError("strategy must be 'counts', 'ranges' or 'window'")
    names = [f"_low_{v}" for v in values]
    if strategy == "window":
        out = df
        for v, name in zip(values, names):
            w = Window.partitionBy(*group).orderBy(F.col(v).asc_nulls_last(), *[F.col(k).asc() for k in key])
            out = out.withColumn(name, F.ntile(2).over(w) == 1)
        return out, names
    thresholds = half_thresholds(df, group, values)
    most = [n * (WINDOW_ROWS + 1) if strategy == "ranges" else n for n in most_ties(thresholds, values)]
    sides = with_sides(df, thresholds, group, values)
    flags = [F.col(f"_side{i}").alias(name) for i, name in enumerate(names)]
    if not any(most):
        return sides.select(*df.columns, *flags), names
    tied = undecided(values)
    ties = rank_ties(sides.filter(tied), most, group, values, key)
    return sides.filter(~tied).select(*df.columns, *flags).unionByName(ties.select(*df.columns, *flags)), names


def group_medians(df: DataFrame, group: Sequence[str], values: Sequence[str], strategy: str = "counts") -> DataFrame:
    """Exact median (mean of the two middle values when the count is even) of each
    value per group, NULLs ignored. Output: group + ``median_{value}``. The two middle
    ranks of all values come from one set of counts."""
    if strategy == "window":
        return df.groupBy(*group).agg(*[F.median(v).alias(f"median_{v}") for v in values])
    found = value_thresholds(df, group, values, lambda n: [F.floor((n + 1) / 2).cast("long"), (F.floor(n / 2) + 1).cast("long")], nulls=False)
    groups = df.select(*group, F.lit(None).cast("int").alias("which"), F.lit(None).cast("double").alias("v")).distinct()
    rows = found.select(*group, "which", "v").unionByName(groups)  # a group without values has NULL medians
    return rows.groupBy(*group).agg(*[F.avg(F.when(F.col("which") == i, F.col("v"))).alias(f"median_{v}") for i, v in enumerate(values)])
