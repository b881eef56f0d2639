"""Index pages and file listings: which files exist and which are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HREF_PATTERN = r'href="([^"]*)"'


def link_harvest(pages: DataFrame, suffix: str = ".zip", only_matching: bool = False) -> DataFrame:
    """Every ``href`` of every page with its position and whether it ends in ``suffix``.
    ``only_matching=True`` keeps just the matching links (the reference's archive list)."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF_PATTERN), 1)).alias("pos", "href"))
    links = links.withColumn("pos", F.col("pos").cast("int")).withColumn("is_archive", F.col("href").endswith(suffix))
    return links.filter("is_archive") if only_matching else links


def new_files(listing: DataFrame, stored: DataFrame, name_col: str = "name") -> DataFrame:
    """Names in ``listing`` not yet in ``stored`` (one anti join instead of one probe per file)."""
    return listing.select(name_col).distinct().join(stored.select(name_col).distinct(), name_col, "left_anti")


def new_file_count(listing: DataFrame, stored: DataFrame, name_col: str = "name") -> DataFrame:
    """S3: how many new files there are (one row)."""
    return new_files(listing, stored, name_col).agg(F.count(F.lit(1)).cast("long").alias("new_files"))


def file_keys(names: DataFrame, prefix: str, name_col: str = "name") -> DataFrame:
    """Storage key of each file: ``prefix + name``."""
    return names.withColumn("key", F.concat(F.lit(prefix), F.col(name_col)))


def url_path(url_col: str = "url"):
    """Path part of a URL (no scheme, host, query or fragment)."""
    return F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/[^?#]*)", 1)


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """S4 + A7: list a folder completely (path, name, length, modified) without reading
    file contents: the binary-file source prunes the ``content`` column."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path).select("path", "length", "modificationTime")
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length",
                     F.col("modificationTime").alias("modified"))
