"""Event files: tab-separated loads, zip archives, manifests, appends and table refresh, JSON
files (S5-S9, S11, S12).

All reads declare their schema (no inference) and all writes go to folders under
the session's shared checkpoint folder or a caller-given path; nothing is staged on
the driver.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.broadcast import BROADCAST_ROW_LIMIT, bounded_count, broadcast_if_small
from riskloom.session import materialize, read_if_exists
from riskloom.sources.log import TableLog

# Canonical event file layout written and read by this package.
EVENT_TSV_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("sqldate", T.StringType()),
    T.StructField("root_code", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("num_mentions", T.IntegerType()),
    T.StructField("num_sources", T.IntegerType()),
    T.StructField("num_articles", T.IntegerType()),
    T.StructField("avg_tone", T.DoubleType()),
    T.StructField("goldstein", T.DoubleType()),
])

# Fixed values (public event codebook): 1-based positions of the needed columns in the
# 58-column daily event files. The other columns are read as text and dropped.
GDELT_POSITIONS = {
    "event_id": 1, "sqldate": 2, "root_code": 29, "goldstein": 31, "num_mentions": 32,
    "num_sources": 33, "num_articles": 34, "avg_tone": 35, "country": 52,
}
GDELT_WIDTH = 58
GDELT_TYPES = {"event_id": "long", "goldstein": "double", "avg_tone": "double",
               "num_mentions": "int", "num_sources": "int", "num_articles": "int"}


def read_tsv(spark: SparkSession, paths, schema: T.StructType = EVENT_TSV_SCHEMA, mode: str = "FAILFAST") -> DataFrame:
    """Tab-separated, no header, CSV quoting; one bad row fails the load by default.
    Adds ``source_file`` (the file each row came from)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = (spark.read.schema(schema).option("sep", "\t").option("header", "false").option("quote", '"')
          .option("mode", mode).csv(paths))
    return df.withColumn("source_file", F.input_file_name())


def read_gdelt_events(spark: SparkSession, paths, mode: str = "FAILFAST") -> DataFrame:
    """Raw 58-column event files -> the canonical columns, by position."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(GDELT_WIDTH)])
    raw = read_tsv(spark, paths, schema, mode)
    cols = []
    for name, pos in GDELT_POSITIONS.items():
        c = F.col(f"_c{pos - 1}")
        cols.append((c.cast(GDELT_TYPES[name]) if name in GDELT_TYPES else c).alias(name))
    return raw.select(*cols, "source_file")


def canonical_events(raw: DataFrame, empty_country: str = "null") -> DataFrame:
    """Typed engine columns from a loaded file: ``event_date`` parsed from ``sqldate``.
    An empty country field is NULL in Spark; ``empty_country='keep'`` maps it to ''."""
    out = raw.withColumn("event_date", F.to_date("sqldate", "yyyyMMdd"))
    if empty_country == "keep":
        out = out.withColumn("country", F.coalesce(F.col("country"), F.lit("")))
    return out


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """Write rows as tab-separated text without header (the event file layout)."""
    cols = list(columns or [f.name for f in EVENT_TSV_SCHEMA.fields])
    df.select(*cols).write.mode(mode).option("sep", "\t").option("header", "false").csv(path)
    return path


# ------------------------------------------------------------------ archives

def archive_members(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """The directories of all archives: (archive, member, size). Nothing is decompressed, and
    where tasks can open the archives no other bytes of them are read."""
    def listed(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with _opened(archive, content) as fh, zipfile.ZipFile(fh) as zf:
                    out += [(archive, i.filename, i.file_size) for i in zf.infolist() if not i.is_dir()]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)],
                                             ["archive", "member", "size"])

    return _archives(spark, path, glob)[0].mapInArrow(listed, "archive string, member string, size long")


def _archives(spark: SparkSession, path: str, glob: str) -> tuple[DataFrame, bool]:
    """(path, content) of all archives, and whether tasks can open the files by their paths. If so, content is NULL and
    not read by Spark, which would hold a whole archive in memory, several times over; else it has all bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    first = files.select("path").head(1)
    in_place = not first or _opens(first[0]["path"])
    return files.select("path", F.lit(None).cast("binary").alias("content") if in_place else F.col("content")), in_place


def _opened(path: str, content=None):
    """An archive for random access: its file, of which only what is asked for is read, or its bytes."""
    from urllib.parse import quote

    import pyarrow as pa
    from pyarrow import fs

    if content is not None and content.is_valid:
        return pa.BufferReader(content.as_buffer())
    store, name = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/@"))
    return io.BufferedReader(store.open_input_file(name), 1 << 20)


def _opens(path: str) -> bool:
    """Whether the file can be opened without Spark (not in a store that only Spark's readers know)."""
    try:
        with _opened(path) as fh:
            fh.read(1)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def wanted_members(members: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """(archive, member) to expand: of a name in several archives the last archive's, as the reference's
    overwriting of same-named members leaves it, and none whose name is expanded already."""
    winners = members.groupBy("member").agg(F.max("archive").alias("archive"))
    if expanded is not None:
        winners = winners.join(expanded.select("member").distinct(), "member", "left_anti")
    return winners.select("archive", "member")


def expand_archives(spark: SparkSession, path: str, expanded: DataFrame | None = None,
                    glob: str = "*.zip", lines_per_batch: int = 10_000) -> DataFrame:
    """Archives -> ``(archive, member, line)``, streamed member by member in line
    batches (no member is held whole in memory).

    What to expand is decided on the archives' directories first: ``expanded`` (``member``
    column) lists members that are skipped, and a name in several archives is taken from the last.
    Only the members that are left are decompressed, so a run without new members
    decompresses nothing.
    """
    wanted = wanted_members(archive_members(spark, path, glob), expanded)
    # One row per archive with its wanted members; the archives stay in the tasks of their scan if it is small.
    lists = materialize(wanted.groupBy("archive").agg(F.collect_list("member").alias("members")), "members")
    n = bounded_count(lists)
    lists = broadcast_if_small(lists, n if n <= BROADCAST_ROW_LIMIT else None)
    files, in_place = _archives(spark, path, glob)
    files = files.withColumnRenamed("path", "archive").join(lists, "archive").select("archive", "content", "members")
    if n > BROADCAST_ROW_LIMIT and in_place:  # the joined rows are short, and by their size all archives would go to one task
        files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")

    def unpack(batches):
        import pyarrow as pa

        def told(archive, member, lines):
            return pa.RecordBatch.from_arrays([pa.array([archive] * len(lines)), pa.array([member] * len(lines)), pa.array(lines, pa.string())],
                                              ["archive", "member", "line"])

        for batch in batches:
            for archive, content, members in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                with _opened(archive, content) as packed, zipfile.ZipFile(packed) as zf:
                    for member in members:
                        with zf.open(member) as fh:
                            lines = []
                            for raw in io.TextIOWrapper(fh, encoding="utf-8", newline="\n"):
                                lines.append(raw.rstrip("\n"))
                                if len(lines) >= lines_per_batch:
                                    yield told(archive, member, lines)
                                    lines = []
                            if lines:
                                yield told(archive, member, lines)

    return files.mapInArrow(unpack, "archive string, member string, line string")


def parse_lines(lines: DataFrame, schema: T.StructType = EVENT_TSV_SCHEMA) -> DataFrame:
    """Parse expanded TSV lines with the file schema (``from_csv``, tab separated)."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    parsed = lines.select("archive", "member", F.from_csv("line", ddl, {"sep": "\t", "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", "archive", "member")


# ------------------------------------------------------------------ manifests, appends, refresh

def write_manifest(spark: SparkSession, data_path: str, manifest_path: str, glob: str = "*.csv") -> str:
    """Write a load manifest naming the data files under ``data_path``: one JSON line
    ``{"url": ..., "mandatory": true}`` per file, written by the tasks that list them."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
              .load(data_path).select(F.col("path").alias("url"), F.lit(True).alias("mandatory")))
    listed.write.mode("overwrite").json(manifest_path)
    return manifest_path


def read_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    """(url, mandatory) per file, from JSON lines or from one document ``{"entries": [...]}``."""
    rows = spark.read.schema("url string, mandatory boolean, entries array<struct<url: string, mandatory: boolean>>").json(manifest_path)
    one = F.array(F.struct("url", "mandatory"))
    return rows.select(F.explode(F.coalesce("entries", one)).alias("e")).select("e.url", "e.mandatory").filter(F.col("url").isNotNull())


def _comparable(path: Column) -> Column:
    """A file's path without the empty authority that listings write in different ways, and unescaped."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, "^file:/+", "file:/")


def load_manifest(spark: SparkSession, manifest_path: str, data_path: str, schema: T.StructType = EVENT_TSV_SCHEMA) -> DataFrame:
    """The rows of exactly the files that the manifest names, in one scan below ``data_path``.
    The scan meets the manifest on the hidden file path, so no list of paths reaches the driver;
    lines of other files are dropped before they are parsed. A mandatory file that isn't there
    is an error, as a load that lacks it must not count."""
    manifest = read_manifest(spark, manifest_path).select(_comparable(F.col("url")).alias("file"), "mandatory").distinct()
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(data_path)
             .select(_comparable(F.col("path")).alias("file")))
    lost = manifest.filter(F.coalesce("mandatory", F.lit(False))).join(there, "file", "left_anti").select("file").head(1)
    if lost:
        raise FileNotFoundError(f"the manifest needs {lost[0]['file']}")
    lines = (spark.read.option("recursiveFileLookup", "true").text(data_path)
             .select("value", F.col("_metadata.file_path").alias("source_file")))
    lines = lines.withColumn("file", _comparable(F.col("source_file"))).join(manifest.select("file").distinct(), "file", "left_semi")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = lines.select("source_file", F.from_csv("value", ddl, {"sep": "\t", "quote": '"', "mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", "source_file")


def append_events(rows: DataFrame, table_path: str, partition_by: Sequence[str] = ()) -> int:
    """Append the rows of source files that the table doesn't hold yet (the reference
    appends blindly, so a rerun duplicates rows). Returns the number of newly appended files.

    Rows go to a folder of their own below ``data``, their file names to a small table beside it
    (``files``), and a commit makes both count. What is held already is read from these names,
    never from the data. If another load commits first, files that it brought as well go
    from this one, and it tries again.
    """
    spark, log = rows.sparkSession, TableLog(rows.sparkSession, table_path)
    root, fresh = table_path.rstrip("/"), rows
    while True:
        version = log.latest()
        seen = loaded_files(spark, table_path)
        if seen is not None:
            fresh = fresh.join(seen, "source_file", "left_anti")
        load = uuid.uuid4().hex
        writer = fresh.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/data/load={load}")
        written = read_if_exists(spark, f"{root}/data/load={load}")
        if written is None:  # a partitioned write of no rows leaves no file
            return 0
        written.select("source_file").distinct().write.parquet(f"{root}/files/load={load}")
        n_files = spark.read.parquet(f"{root}/files/load={load}").count()
        if not n_files:
            return 0
        if log.commit(version + 1, load=load):
            return n_files
        fresh = written.select(*rows.columns)


def loaded_files(spark: SparkSession, table_path: str) -> DataFrame | None:
    """(source_file) of all committed loads; None before the first."""
    commits = TableLog(spark, table_path).commits()
    if commits is None:
        return None
    files = spark.read.parquet(f"{table_path.rstrip('/')}/files")
    return files.join(commits.filter(F.col("load").isNotNull()).select("load"), "load", "left_semi").select("source_file").distinct()


def read_events(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows of all committed loads of an event table."""
    commits = TableLog(spark, table_path).commits()
    if commits is None:
        raise FileNotFoundError(f"no committed load under {table_path}")
    data = spark.read.parquet(f"{table_path.rstrip('/')}/data")
    return data.join(commits.filter(F.col("load").isNotNull()).select("load"), "load", "left_semi").drop("load")


def store_events(rows: DataFrame, table_path: str, empty_country: str = "null") -> int:
    """Loaded event rows -> the event table: typed ``event_date`` (DATE, so date
    predicates reach the scan) and partitioned by Monday ``week``, so a lookback reads
    only its weeks' folders. Source files already stored are skipped."""
    typed = canonical_events(rows, empty_country).withColumn("week", F.trunc("event_date", "week"))
    return append_events(typed, table_path, partition_by=("week",))


def refresh_table(df: DataFrame, table_root: str) -> str:
    """Full refresh without an empty moment: write a new folder, then commit it as the next
    version. Nothing that a reader uses is ever deleted or overwritten, so ``read_current`` works at
    every moment (the reference deletes, then inserts), and two refreshes at once give two versions."""
    log = TableLog(df.sparkSession, table_root)
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table_root.rstrip('/')}/{folder}")
    while not log.commit(log.latest() + 1, folder=folder):
        pass  # another refresh took the number
    return f"{table_root.rstrip('/')}/{folder}"


def read_current(spark: SparkSession, table_root: str) -> DataFrame:
    commits = TableLog(spark, table_root).commits()
    row = None if commits is None else commits.filter(F.col("folder").isNotNull()).agg(F.max_by("folder", "version")).first()
    if row is None or row[0] is None:
        raise FileNotFoundError(f"no table version under {table_root}")
    return spark.read.parquet(f"{table_root.rstrip('/')}/{row[0]}")


# ------------------------------------------------------------------ JSON files

def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Request files, one JSON document each, to ``(request_id, json, source_file)``, and the files that are
    set aside because they hold no JSON object with an item list. A request's id is a hash of its file's path;
    the text goes on as it is, so the order of names and of doubled keys is that of the file."""
    files = spark.read.format("text").option("wholetext", "true").load(path).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("source_file"))
    files = files.select(F.xxhash64("source_file").alias("request_id"), "json", "source_file")
    known = F.from_json("json", "items array<map<string,array<map<string,double>>>>")["items"].isNotNull()
    return files.filter(known), files.filter(~known)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of code -> name as ``(pos, code, name)``, in the file's order (which decides between two
    codes of one name). A file that is no JSON object is an error."""
    files = spark.read.format("text").option("wholetext", "true").load(path)
    entries = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return files.select(F.posexplode(F.map_entries(entries)).alias("pos", "e")).select("pos", F.col("e.key").alias("code"), F.col("e.value").alias("name"))


def write_json_object(entries: DataFrame, path: str, order: str, key: str, value: str) -> str:
    """Write a small dictionary as one JSON object with its keys in the given order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, key, value)))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.regexp_replace(F.to_json(F.create_map(e[key], e[value])), r"^\{|\}$", "")), ",\n"), F.lit("}"))
    entries.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


# ------------------------------------------------------------------ SOM codebook

def save_codebook(codebook: DataFrame, path: str) -> str:
    codebook.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_codebook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("x", "y", "w")
