"""Adapters that shape the driver's test tables into the engine's inputs.

Every adapter exists twice: as a DataFrame function (what the engine reads) and as
SQL text (what the DuckDB oracle reads). Both read the whole tables.

- ``events``    (T1) event rows from lineitem x supplier x nation
- ``offers``    (T3) sourcing offers: one request per group of four parts
- ``requests``  (T3) the same offers as nested JSON requests
- ``risk``      (T3) a risk score per nation, in thousandths
- ``dictionary``     code -> name dictionary with two codes per name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixture reference date and the unique event key of the lineitem-based events.
AS_OF = "2001-07-15"
EVENT_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- events

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    day = F.col("l_shipdate").cast("date")
    return (li.join(su, li.l_suppkey == su.s_suppkey).join(na, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(*EVENT_KEY,
                    day.alias("event_date"),
                    F.date_format(day, "yyyyMMdd").alias("sqldate"),
                    F.when(F.col("l_partkey") % 7 == 0, F.lpad((F.lit(1) + F.col("l_partkey") % 20).cast("string"), 2, "0"))
                    .otherwise((F.lit(1) + F.col("l_partkey") % 20).cast("string")).alias("root_code"),
                    F.when(F.col("l_orderkey") % 97 != 0, F.col("n_name")).alias("country"),
                    F.col("l_quantity").cast("int").alias("num_mentions"),
                    F.col("l_linenumber").cast("int").alias("num_sources"),
                    (F.lit(1) + F.col("l_suppkey") % 10).cast("int").alias("num_articles"),
                    F.when(F.col("l_orderkey") % 13 != 0, ((cents % 2001) - 1000).cast("double") / 100).alias("avg_tone"),
                    ((((cents.cast("long") / 7).cast("long") % 201) - 100).cast("double") / 10).alias("goldstein")))


EVENTS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(l_shipdate AS DATE) AS event_date,
       strftime(CAST(l_shipdate AS DATE), '%Y%m%d') AS sqldate,
       CASE WHEN l_partkey % 7 = 0 THEN lpad(CAST(1 + l_partkey % 20 AS VARCHAR), 2, '0') ELSE CAST(1 + l_partkey % 20 AS VARCHAR) END AS root_code,
       CASE WHEN l_orderkey % 97 <> 0 THEN n_name END AS country,
       CAST(l_quantity AS INTEGER) AS num_mentions,
       CAST(l_linenumber AS INTEGER) AS num_sources,
       CAST(1 + l_suppkey % 10 AS INTEGER) AS num_articles,
       CASE WHEN l_orderkey % 13 <> 0 THEN CAST((CAST(round(l_extendedprice * 100) AS BIGINT) % 2001) - 1000 AS DOUBLE) / 100 END AS avg_tone,
       CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) // 7) % 201) - 100 AS DOUBLE) / 10 AS goldstein
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


# ---------------------------------------------------------------- sourcing

def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12 offers: request = four consecutive parts, item = part, offer = supplier nation,
    cost = cheapest unit price in cents over all its lines. Some offers cost nothing or less, some
    items have no usable offer, some countries have no score, some offer twice, and some items
    bear the name of the request's first one."""
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per = (li.join(su, li.l_suppkey == su.s_suppkey).join(na, F.col("s_nationkey") == F.col("n_nationkey"))
           .groupBy("l_partkey", "n_nationkey", "n_name")
           .agg(F.min(F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity"))).alias("cost")))
    part, nation = F.col("l_partkey"), F.col("n_nationkey")
    cost = (F.when(part % 41 == 0, 0.0).when((part % 11 == 0) & (nation % 5 == 0), 0.0)
            .when((part % 13 == 0) & (nation % 7 == 0), -5.0).otherwise(F.col("cost")))
    name = F.when((part % 29 == 0) & (nation == 1), "UNSCORED").otherwise(F.col("n_name"))
    again = F.explode(F.when((part % 17 == 0) & (nation % 3 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    per = per.select("l_partkey", "n_nationkey", name.alias("n_name"), cost.alias("cost"), again.alias("again"))
    per = per.withColumn("cost", F.col("cost") + 10 * F.col("again")).withColumn("request_id", F.floor(F.col("l_partkey") / 4).cast("long"))
    # Dealt once by request: the window and the nesting of the requests need no exchange of their own.
    per = per.repartition("request_id")
    w = Window.partitionBy("request_id", "l_partkey").orderBy("again", "n_nationkey")
    named = part - F.when((part % 4 == 3) & (F.floor(part / 4) % 19 == 0), 3).otherwise(0)
    return per.select(
        "request_id",
        (F.col("l_partkey") % 4).cast("int").alias("item_pos"),
        F.concat(F.lit("part-"), named.cast("long").cast("string")).alias("item"),
        (F.row_number().over(w) - 1).cast("int").alias("offer_pos"),
        F.col("n_name").alias("country"),
        F.col("cost").cast("double").alias("cost"))


OFFERS_SQL = """
SELECT CAST(l_partkey // 4 AS BIGINT) AS request_id,
       CAST(l_partkey % 4 AS INTEGER) AS item_pos,
       'part-' || CAST(l_partkey - CASE WHEN l_partkey % 4 = 3 AND (l_partkey // 4) % 19 = 0 THEN 3 ELSE 0 END AS VARCHAR) AS item,
       CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY again, n_nationkey) - 1 AS INTEGER) AS offer_pos,
       CASE WHEN l_partkey % 29 = 0 AND n_nationkey = 1 THEN 'UNSCORED' ELSE n_name END AS country,
       CAST(CASE WHEN l_partkey % 41 = 0 OR (l_partkey % 11 = 0 AND n_nationkey % 5 = 0) THEN 0
                 WHEN l_partkey % 13 = 0 AND n_nationkey % 7 = 0 THEN -5 ELSE cost END + 10 * again AS DOUBLE) AS cost
FROM (SELECT l_partkey, n_nationkey, n_name, min(round(l_extendedprice * 100 / l_quantity)) AS cost
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      GROUP BY l_partkey, n_nationkey, n_name) per
JOIN (VALUES (0), (1)) twice(again) ON again = 0 OR (l_partkey % 17 = 0 AND n_nationkey % 3 = 0)
"""


def appetite_word(request_id) -> F.Column:
    rid = F.col(request_id) if isinstance(request_id, str) else request_id
    return (F.when(rid % 4 == 0, "Low").when(rid % 4 == 1, "Medium").when(rid % 4 == 2, "High")
            .otherwise("unknown"))


APPETITE_SQL = ("CASE request_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' "
                "WHEN 2 THEN 'High' ELSE 'unknown' END")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11 requests ``(request_id, json)`` in the reference's nested shape, built from the offers.
    Nesting is per request and item, so every collected list is one small request."""
    off = offers(spark, sf_dir)
    items = (off.groupBy("request_id", "item_pos", "item")
             .agg(F.sort_array(F.collect_list(F.struct("offer_pos", "country", "cost"))).alias("o"))
             .select("request_id", "item_pos",
                     F.to_json(F.create_map(F.col("item"), F.transform(
                         "o", lambda s: F.create_map(s["country"], s["cost"])))).alias("entry")))
    reqs = (items.groupBy("request_id")
            .agg(F.sort_array(F.collect_list(F.struct("item_pos", "entry"))).alias("its"))
            .select("request_id",
                    F.concat(F.lit('{"items":['), F.array_join(F.transform("its", lambda s: s["entry"]), ","),
                             F.lit('],"risk_aversion":"'), appetite_word("request_id"), F.lit('"}')).alias("json")))
    return reqs


ODD_REQUESTS = 10_000_000


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of unusual shape, six per nation: broken JSON, no items, several names in one map, an item
    without offers, no item list, and a name whose second list replaces the first one."""
    na, name, n = table(spark, sf_dir, "nation"), F.col("n_name"), F.col("n_nationkey").cast("string")
    offer = F.concat(F.lit('[{"'), name, F.lit('": 1'), n, F.lit('.5}]'))
    head, tail = F.lit('{"items": ['), F.lit('], "risk_aversion": "Low"}')
    shapes = [F.concat(F.lit("{broken "), name), F.concat(head, tail),
              F.concat(head, F.lit('{"A": '), offer, F.lit(', "B": '), offer, F.lit("}"), tail),
              F.concat(head, F.lit('{"A": '), offer, F.lit('}, {"B": []}'), tail), F.lit('{"risk_aversion": "Low"}'),
              F.concat(head, F.lit('{"A": [{"UNKNOWN": 1}]}, {"A": '), offer, F.lit("}"), tail)]
    return na.select(F.posexplode(F.array(*shapes)).alias("k", "json"), "n_nationkey").select(
        (F.lit(ODD_REQUESTS) + 10 * F.col("n_nationkey") + F.col("k")).cast("long").alias("request_id"), "json")


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 risk per nation, in thousandths (integers keep sums and ties exact)."""
    na = table(spark, sf_dir, "nation")
    scored = na.select(F.col("n_name").alias("country"),
                       ((F.col("n_nationkey") * 37) % 101 / 1000.0).cast("double").alias("distance"))
    # every fifth nation has a second, lower score: the larger one counts
    again = na.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("country"), F.lit(0.0).alias("distance"))
    # a row without a score is none
    unknown = na.filter("n_nationkey = 1").select(F.lit("UNSCORED").alias("country"), F.lit(None).cast("double").alias("distance"))
    return scored.unionByName(again).unionByName(unknown)


RISK_SQL = "SELECT n_name AS country, CAST(((n_nationkey * 37) % 101) / 1000.0 AS DOUBLE) AS distance FROM nation"


# ---------------------------------------------------------------- dictionary

def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code -> display name with two codes per name (the nation name itself first,
    then a short alias), so the first-code rule has something to decide."""
    na = table(spark, sf_dir, "nation")
    name = F.initcap(F.regexp_replace("n_name", "_", " "))
    first = na.select((F.col("n_nationkey") * 2).cast("int").alias("pos"), F.col("n_name").alias("code"), name.alias("name"))
    alias = na.select((F.col("n_nationkey") * 2 + 1).cast("int").alias("pos"),
                      F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), name.alias("name"))
    return first.unionByName(alias)


DICTIONARY_SQL = """
SELECT CAST(n_nationkey * 2 AS INTEGER) AS pos, n_name AS code,
       upper(substr(replace(n_name, '_', ' '), 1, 1)) || lower(substr(replace(n_name, '_', ' '), 2)) AS name FROM nation
UNION ALL
SELECT CAST(n_nationkey * 2 + 1 AS INTEGER) AS pos, 'N' || CAST(n_nationkey AS VARCHAR) AS code,
       upper(substr(replace(n_name, '_', ' '), 1, 1)) || lower(substr(replace(n_name, '_', ' '), 2)) AS name FROM nation
"""


# ---------------------------------------------------------------- archives

def write_archives(df: DataFrame, path: str, member: Column, prefix: str) -> None:
    """Rows as tab-separated members of zip archives ``{prefix}{member}.zip``, one member each, streamed by the
    tasks to any file system that a URI names; a repeated task writes the same archives again."""
    columns, root = df.columns, path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path

    def pack(frames):
        import zipfile

        import pandas as pd
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        open_now, names = None, []
        for frame in frames:
            for name, part in frame.groupby("_member", sort=False):
                if open_now is None or open_now[0] != name:
                    close(open_now)
                    out = store.open_output_stream(f"{folder}/{prefix}{name}.zip")
                    archive = zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED)
                    open_now = name, archive.open(f"{name}.tsv", "w", force_zip64=True), archive, out
                    names.append(name)
                open_now[1].write(part[columns].to_csv(sep="\t", header=False, index=False, lineterminator="\n").encode())
        close(open_now)
        if names:  # an empty frame has no text column to convert
            yield pd.DataFrame({"member": names})

    def close(opened):
        for x in (opened or ())[1:]:
            x.close()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges, not hashes: with fewer members than partitions no task gets two large ones.
    rows = df.select(member.alias("_member"), *columns).repartitionByRange(parts, "_member").sortWithinPartitions("_member")
    rows.mapInPandas(pack, "member string").write.format("noop").mode("overwrite").save()
