import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import weekly as W
from riskloom.plans import fixtures as FX
from riskloom.session import work_path
from riskloom.sources import files as SF
from riskloom.streaming import incremental as ST
from tests.conftest import SMALL, rows

COLS = ["country", "week", "total_mentions", "total_sources", "total_articles"]


def test_stream_metrics_equal_batch_and_rerun_is_idempotent(spark):
    ev = FX.events(spark, SMALL)
    src = work_path(spark, "src")
    ev.repartitionByRange(3, "event_date").write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    table, metrics, chk = work_path(spark, "t"), work_path(spark, "m"), work_path(spark, "c")
    ST.weekly_metrics_stream(spark, stream, table, metrics, chk, FX.AS_OF, -4, key=FX.EVENT_KEY)
    batch = W.weekly_metrics(ev, FX.AS_OF, -4, key=FX.EVENT_KEY)
    first = rows(spark.read.parquet(metrics), *COLS)
    assert first == rows(batch, *COLS)
    ST.weekly_metrics_stream(spark, spark.readStream.schema(ev.schema).parquet(src), table, metrics, chk,
                             FX.AS_OF, -4, key=FX.EVENT_KEY)
    assert rows(spark.read.parquet(metrics), *COLS) == first


def test_state_takes_four_batches_and_a_retried_one(spark):
    ev = FX.events(spark, SMALL)
    state, metrics = work_path(spark, "st"), work_path(spark, "m")
    parts = ev.withColumn("part", F.pmod(F.xxhash64(*FX.EVENT_KEY), F.lit(4))).cache()  # every week in every batch
    for n in (0, 1, 2, 2, 3, 1):  # batches 2 and 1 come again
        ST.weekly_metrics_batch(parts.filter(F.col("part") == n).drop("part"), n, state, metrics, FX.AS_OF, -4, key=FX.EVENT_KEY)
    batch = W.weekly_metrics(ev, FX.AS_OF, -4, key=FX.EVENT_KEY)
    full = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*batch.columns).fillna(-99.0).collect())
    assert full(spark.read.parquet(metrics)) == full(batch)
    # another date and lookback from the same state, without the events
    later = ST.weekly_metrics_from_state(spark, state, "2001-05-02", -2, key=FX.EVENT_KEY)
    assert full(later) == full(W.weekly_metrics(ev, "2001-05-02", -2, key=FX.EVENT_KEY))
    for line in later._jdf.queryExecution().executedPlan().toString().splitlines():
        if "ReadSchema" in line:  # cells, or keys without the events' other columns
            assert "num_mentions" not in line


def test_late_rows_are_kept_and_counted(spark):
    schema = "user_id string, ts timestamp_ntz, value double"
    src, sink, chk = work_path(spark, "late"), work_path(spark, "late-sink"), work_path(spark, "late-chk")
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[("a", day(40), 1.0), ("b", day(41), 2.0), ("a", None, 9.0)],
               [("a", day(3), 4.0), ("a", day(2), 8.0), ("b", day(26), 16.0), ("c", day(28), 32.0)],  # three are over 14 days behind
               [("a", day(3), 64.0), ("a", day(60), 128.0)]]
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
        ST.weekly_totals_stream(spark, spark.readStream.schema(schema).parquet(src), sink, chk)
    got = sorted((r.user_id, r.week, r.n_events, r.total_value) for r in ST.current_weekly_totals(spark, sink).collect())
    want = {}
    for user, ts, value in (r for b in batches for r in b if r[1] is not None):
        k = user, (ts - dt.timedelta(days=ts.weekday())).date()
        want[k] = want.get(k, (0, 0.0))[0] + 1, want.get(k, (0, 0.0))[1] + value
    assert got == sorted((*k, *v) for k, v in want.items())
    assert sum(r.n_late for r in ST.late_rows(spark, sink).collect()) == 4
    # a retried batch writes its own folder again
    kind = spark.createDataFrame([], schema).schema["ts"].dataType
    ST.weekly_totals_batch(spark.createDataFrame(batches[2], schema), 2, sink, kind, "user_id", "ts", "value", "14 days")
    again = sorted((r.user_id, r.week, r.n_events, r.total_value) for r in ST.current_weekly_totals(spark, sink).collect())
    assert again == got


def test_weeks_do_not_depend_on_the_time_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:30:00' AS n, timestamp'2024-01-01 00:30:00+00:00' AS l")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Los_Angeles", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = df.select(*[ST.utc_week(F.col(c), df.schema[c].dataType).alias(c) for c in "nl"]).first()
            assert tuple(got) == (dt.date(2024, 1, 1), dt.date(2024, 1, 1)), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_incremental_load_reads_only_new_files(spark):
    ev = FX.events(spark, SMALL).selectExpr("l_orderkey as event_id", "sqldate", "root_code", "country",
                                            "num_mentions", "num_sources", "num_articles", "avg_tone", "goldstein")
    src = work_path(spark, "tsv")
    SF.write_tsv(ev.limit(100), src + "/a")
    sink, chk = work_path(spark, "sink"), work_path(spark, "chk")
    assert ST.incremental_load(spark, src + "/*", sink, chk) == 100
    assert ST.incremental_load(spark, src + "/*", sink, chk) == 0
    SF.write_tsv(ev, src + "/b")
    n = ev.count()
    assert ST.incremental_load(spark, src + "/*", sink, chk) == n
    assert spark.read.parquet(sink).count() == 100 + n


def test_stream_query_writes_files_of_bounded_size(spark, monkeypatch):
    from riskloom.plans import registry as R

    paths, fresh = [], R.work_path
    monkeypatch.setattr(R, "work_path", lambda s, name: paths.append(fresh(s, name)) or paths[-1])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        R.QUERIES["weekly_metrics_stream"](spark, SMALL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    files = spark.read.parquet(paths[0]).groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert files[0] > 8 and files[1] <= files[2] / 8
