"""Nightly incremental runs as Structured Streaming (S10, weekly totals and metrics on streams).

The reference re-runs every night and decides what is new by probing storage file
by file. A file stream source with ``trigger(availableNow=True)`` does the same
bookkeeping in its checkpoint: each run processes exactly the files added since
the previous run, then stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.codes import ROOT_CODES
from riskloom.functions.dates import week_of
from riskloom.operators.ranks import half_thresholds, join_same, most_ties, rank_ties, undecided, with_sides
from riskloom.operators.weekly import lookback_filter, root_code_filter
from riskloom.session import materialize, read_if_exists
from riskloom.sources.files import EVENT_TSV_SCHEMA


def incremental_load(spark: SparkSession, source_dir: str, sink_path: str, checkpoint_path: str,
                     schema: T.StructType = EVENT_TSV_SCHEMA, glob: str = "*.csv") -> int:
    """Load every event file added to ``source_dir`` since the last run into the
    Parquet table at ``sink_path``; returns the number of rows this run appended."""
    before = read_if_exists(spark, sink_path)
    held = before.count() if before is not None else 0  # from file footers
    stream = (spark.readStream.schema(schema).option("sep", "\t").option("header", "false")
              .option("mode", "FAILFAST").option("pathGlobFilter", glob).csv(source_dir)
              .withColumn("source_file", F.input_file_name()))
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint_path)
         .outputMode("append").trigger(availableNow=True).start(sink_path))
    q.awaitTermination()
    after = read_if_exists(spark, sink_path)
    return (after.count() if after is not None else 0) - held


def utc_week(ts: Column, kind: T.DataType) -> Column:
    """Monday of the UTC week, whatever the session's time zone; a time without zone counts as UTC."""
    day = ts.cast("date") if isinstance(kind, (T.TimestampNTZType, T.DateType)) else F.date_from_unix_date(
        F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return F.trunc(day, "week")


def weekly_totals_stream(spark: SparkSession, events_stream: DataFrame, sink_path: str, checkpoint_path: str,
                         key: str = "user_id", ts_col: str = "ts", value_col: str = "value",
                         watermark: str = "14 days") -> None:
    """Weekly count and sum per key on a stream. Runs until the available input is consumed.

    Totals merge by addition, so a micro-batch only writes its own ones, in a folder named by its
    number below ``sink_path`` (a retried batch writes the same folder again), and nothing is held
    as state or read back but the newest event time of the batches before. Rows that are older
    than this by more than ``watermark`` are late: a streaming aggregate would drop them; here
    they go to a folder of their own beside the others (``late=true``), the corrections.
    ``current_weekly_totals`` adds all up, ``late_rows`` counts the late ones.
    """
    kind = events_stream.schema[ts_col].dataType

    def batch(df: DataFrame, number: int) -> None:
        weekly_totals_batch(df, number, sink_path, kind, key, ts_col, value_col, watermark)

    q = (events_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def weekly_totals_batch(df: DataFrame, number: int, sink_path: str, kind: T.DataType, key: str, ts_col: str, value_col: str, watermark: str) -> None:
    """Writes the totals of one micro-batch, on-time and late rows apart."""
    spark, ts = df.sparkSession, F.col(ts_col)
    horizon = F.lit(None).cast(kind)
    stored = read_if_exists(spark, sink_path)
    if stored is not None:
        newest = stored.filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        if newest is not None:
            horizon = F.lit(newest).cast(kind) - F.expr(f"INTERVAL {watermark}")
    rows = df.filter(ts.isNotNull()).withColumn("late", F.coalesce(ts < horizon, F.lit(False)))
    totals = rows.groupBy(F.col(key), utc_week(ts, kind).alias("week"), "late").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(value_col).alias("total_value"), F.max(ts).alias("newest"))
    totals.write.mode("overwrite").partitionBy("late").parquet(f"{sink_path.rstrip('/')}/batch={number}")


def current_weekly_totals(spark: SparkSession, sink_path: str, key: str = "user_id") -> DataFrame:
    """All that the stream has seen, late rows included: one row per key and week."""
    return spark.read.parquet(sink_path).groupBy(key, "week").agg(
        F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value"))


def late_rows(spark: SparkSession, sink_path: str) -> DataFrame:
    """Late rows by micro-batch and week (none: no row)."""
    return (spark.read.parquet(sink_path).filter(F.col("late").cast("boolean")).groupBy("batch", "week").agg(F.sum("n_events").alias("n_late")))


def events_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file stream; ``files_per_batch`` bounds a micro-batch (default: all new files)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


SUMS = {"total_mentions": "num_mentions", "total_sources": "num_sources", "total_articles": "num_articles"}
CENTRES = ("avg_tone", "goldstein")


def weekly_metrics_stream(spark: SparkSession, events_stream: DataFrame, state_path: str, metrics_table: str,
                          checkpoint_path: str, as_of, months: int = -2, by=("country",), key=("event_id",),
                          codes=ROOT_CODES, strict_codes: bool = False) -> None:
    """Weekly metrics (lower-half centres included) kept current from a stream of events.

    NTILE cannot run on a stream, but the halves follow from counts. The state below
    ``state_path`` holds, by week and micro-batch, *cells* (group, day, tone, Goldstein score) with
    their number of events and sums, and the *keys* of each cell's events. Cells merge by
    addition, so a batch only adds its own (a retried batch writes the same folders again); the
    metrics of the weeks it touches are recomputed from cells, and of the keys only those in cells
    at a threshold are ranked. The event rows themselves are neither stored nor read again.
    """
    def batch(df: DataFrame, number: int) -> None:
        weekly_metrics_batch(df, number, state_path, metrics_table, as_of, months, by, key, codes, strict_codes)

    q = (events_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def weekly_metrics_batch(df: DataFrame, number: int, state_path: str, metrics_table: str, as_of, months: int = -2, by=("country",),
                         key=("event_id",), codes=ROOT_CODES, strict_codes: bool = False) -> None:
    """Adds one micro-batch to the state and replaces the metrics of the weeks it touches."""
    spark = df.sparkSession
    ev = root_code_filter(df, codes, strict_codes).withColumn("week", week_of("event_date"))
    for b in ["week", *by]:
        ev = ev.filter(F.col(b).isNotNull())
    cell = [*by, "week", "event_date", *CENTRES]
    cells = ev.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(name) for name, c in SUMS.items()])
    for name, part in (("cells", cells), ("keys", ev.select(*cell, *key))):
        part.write.mode("overwrite").partitionBy("week").parquet(f"{state_path.rstrip('/')}/{name}/batch={number}")
    seen = read_if_exists(spark, f"{state_path.rstrip('/')}/cells/batch={number}")
    if seen is None or "week" not in seen.columns:  # no event with one of the codes
        return
    # Weeks inside the lookback, a few at most whatever the number of events.
    touched = [r["week"] for r in lookback_filter(seen, as_of, months).select("week").distinct().collect()]
    if not touched:
        return
    fresh = materialize(weekly_metrics_from_state(spark, state_path, as_of, months, by, key, touched), "weekly-stream")
    # A touched week whose recomputation is empty has no row to overwrite its old one with.
    empty = set(touched) - {r["week"] for r in fresh.select("week").distinct().collect()}
    for week in sorted(empty):
        _delete(spark, f"{metrics_table.rstrip('/')}/week={week}")
    (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("week").parquet(metrics_table))


def weekly_metrics_from_state(spark: SparkSession, state_path: str, as_of, months: int = -2, by=("country",), key=("event_id",),
                              weeks=None) -> DataFrame:
    """Weekly metrics as of any date, from the stream's state alone (``weeks``: only these)."""
    group, values = [*by, "week"], list(CENTRES)

    def read(name):
        table = lookback_filter(spark.read.parquet(f"{state_path.rstrip('/')}/{name}"), as_of, months)
        return table if weeks is None else table.filter(F.col("week").isin(list(weeks)))

    cell = [*group, "event_date", *CENTRES]
    cells = read("cells").groupBy(*cell).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])
    thresholds = half_thresholds(cells, group, values, weight="n")
    most = most_ties(thresholds, values)
    sides = with_sides(cells, thresholds, group, values)
    both = F.col("_side0") & F.col("_side1")
    columns = [*group, *values, *SUMS, "n"]
    parts = sides.select(*columns, F.when(undecided(values), False).otherwise(both).alias("both"))
    if any(most):
        # Keys stand for one event each; their cells' sums are counted above.
        tied = sides.filter(undecided(values)).drop("n", *SUMS)
        keys = rank_ties(join_same(tied, read("keys"), cell), most, group, values, key)
        parts = parts.unionByName(keys.select(*group, *values, *[F.lit(0).cast("long").alias(c) for c in SUMS], F.lit(1).cast("long").alias("n"), both.alias("both")))
    core = [F.col("both") & F.col(v).isNotNull() for v in values]
    out = parts.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[(F.sum(F.when(k, F.col(v) * F.col("n"))) / F.sum(F.when(k, F.col("n")))).alias(f"center_{v.removeprefix('avg_')}") for k, v in zip(core, values, strict=True)],
        F.sum(F.when(F.col("both"), F.col("n"))).alias("_core"))
    return out.filter(F.col("_core") > 0).drop("_core")
