"""An event layout for repeated group-bys: buckets of (country, week) inside folders of weeks.

A table in this layout is grouped, or ranked by a window, by country and week without an exchange,
and a lookback still reads its weeks' folders only. The rows are shuffled once, when they are
written. Both columns are in the bucket key, so that one country is spread over its weeks; a single
(country, week) is read by one task, which is the limit of the layout: where one such group is too
much for a task, use ``store_events``, whose plans spread a group over tasks.

Each write is a version of its own and counts from its commit (``log.py``), which holds the columns
and the number of buckets, so a session needs no shared catalog to read it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.dates import week_of
from riskloom.sources.log import TableLog

KEYS = ("country", "week")
FOLDER = "week_folder"
#: Rows of a bucket on average, and the most buckets that Spark writes (spark.sql.sources.bucketing.maxBuckets).
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 100_000


def store_bucketed(events: DataFrame, table_root: str, buckets: int, bucket_rows: int = BUCKET_ROWS) -> str:
    """Events (``country``, ``event_date``, any others) -> a new version, in ``buckets`` buckets, or in more if
    they would hold over ``bucket_rows`` rows each, as a bucket is one task. Rows without a country are kept
    (in a bucket of their own value); those without a date are in no week's folder."""
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    spark = events.sparkSession
    log = TableLog(spark, table_root)
    folder, name = f"b-{uuid.uuid4().hex}", f"riskloom_write_{uuid.uuid4().hex}"
    rows = events.withColumn("week", week_of("event_date"))
    buckets = min(max(buckets, -(-events.count() // bucket_rows)), MOST_BUCKETS)
    layout = json.dumps({"buckets": buckets, "columns": rows.schema.jsonValue()})
    rows = rows.withColumn(FOLDER, F.col("week")).repartition(buckets, *KEYS)  # the buckets' own hash: one file per bucket and week
    path = f"{table_root.rstrip('/')}/{folder}"
    writer = rows.write.format("parquet").partitionBy(FOLDER).bucketBy(buckets, *KEYS).sortBy(*KEYS)
    writer.option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files lie at a path of their own
    while not log.commit(log.latest() + 1, folder=folder, layout=layout):
        pass  # another writer took the number
    return path


def read_bucketed(spark: SparkSession, table_root: str) -> DataFrame:
    """The last committed version, as a bucketed table of this session."""
    commits = TableLog(spark, table_root).commits()
    last = F.max_by(F.struct("folder", "layout"), "version")
    row = None if commits is None else commits.filter(F.col("layout").isNotNull()).agg(last.alias("last")).select("last.*").first()
    if row is None or row["folder"] is None:
        raise FileNotFoundError(f"no bucketed version under {table_root}")
    layout, name = json.loads(row["layout"]), f"riskloom_read_{row['folder'][2:]}"
    if not spark.catalog.tableExists(name):
        fields = StructType.fromJson(layout["columns"]).fields
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
        keys = ", ".join(KEYS)
        path = f"{table_root.rstrip('/')}/{row['folder']}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}, {FOLDER} date) USING parquet PARTITIONED BY ({FOLDER}) "
                  f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
