"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

#: A word is a run of characters other than these six (space, tab, line feed, vertical tab, form feed, return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words of a text, without user functions; null and blank texts give an empty array."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, f"[{SPACE_CLASS}]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as a long, without building the words; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def boxed(df: DataFrame, name: str = "row_in") -> DataFrame:
    """The whole input row in one struct column, so that no name of the input can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unboxed(df: DataFrame, added: list[str], name: str = "row_in") -> DataFrame:
    """The input's columns again, with ``added``; an input column named like an added one is replaced."""
    fields = df.schema[name].dataType.names
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in fields if c not in added], *added)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again. Spark removes the shuffle files of a step
    once its plan is collected as garbage; asked for here, before the next step needs the disk."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return materialize(df, name)


def running_totals(df: DataFrame, order: list[str], value: str, total: str, parts: int) -> DataFrame:
    """``df`` plus ``total``: the sum of ``value`` over all rows before this one in ``order``.

    A range partitioning by ``order`` is written once with the number of the partition; sums of
    whole partitions (one row each) give every partition its start, and a window inside the
    partition the rest. No task sees more than its range. Ties must not matter to the caller.
    """
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.join(F.broadcast(starts), "_part")  # one row per partition
            .withColumn(total, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_part", "_start"))


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))
