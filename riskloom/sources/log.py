"""What a table holds, as a log of commits beside its data.

Every write goes to a folder of its own first; it counts from the moment its commit is there:
a small JSON file ``_log/<number>.json`` that is created only if absent, so of two writers that
want the same number one gets it and the other has to look again. Readers take the folders
that the log names; a write that crashed before its commit is never seen.

Creating a file only if it is absent is atomic on HDFS and on object stores whose connector
writes conditionally; a plain local folder (tests, one machine) checks first and writes then, so a
writer there also reads its commit back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import read_if_exists

ENTRY = "load string, folder string, layout string, token string"


class TableLog:
    def __init__(self, spark: SparkSession, table_path: str):
        self.spark, self.folder = spark, f"{table_path.rstrip('/')}/_log"

    def commits(self) -> DataFrame | None:
        """(version, load, folder, layout), one row per commit; None before the first."""
        files = read_if_exists(self.spark, self.folder, "text")  # tells an absent folder from one that can't be read
        if files is None:
            return None
        rows = self.spark.read.schema(ENTRY).json(self.folder)
        version = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long")
        return rows.select(version.alias("version"), "load", "folder", "layout")

    def latest(self) -> int:
        """The highest number taken, 0 before the first commit."""
        rows = self.commits()
        return 0 if rows is None else rows.agg(F.max("version")).first()[0] or 0

    def commit(self, version: int, **entry: str) -> bool:
        """Whether this writer got the number."""
        jvm, token = self.spark._jvm, uuid.uuid4().hex
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version:020d}.json")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path.getParent())
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Exception as e:  # Py4JJavaError: another writer was faster
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps({**entry, "token": token}).encode()))
        out.close()
        rows = self.spark.read.schema(ENTRY).json(path.toString())
        return rows.filter(F.col("token") == token).count() == 1
