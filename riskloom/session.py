"""Session helpers: a sane local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_WORK_ROOT: str | None = None


def local_session(cpus: int | str = "*", app: str = "riskloom", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the local bench. On a cluster, build your own session;
    every operator only relies on the settings below being reasonable, not exact."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; we read it from the session.
    Only when it is unset and the master is local (tests, bench, the driver's
    smoke run) do we set a fresh folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster run needs a shared folder")
    global _LOCAL_WORK_ROOT
    if _LOCAL_WORK_ROOT is None:
        _LOCAL_WORK_ROOT = tempfile.mkdtemp(prefix="riskloom-")
    sc.setCheckpointDir(os.path.join(_LOCAL_WORK_ROOT, "checkpoints"))
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/riskloom-work/{name}-{uuid.uuid4().hex[:12]}"


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet"):
    """The table at ``path``, or None if nothing is there. Any other failure to read is raised:
    taking it for an empty table would lose or repeat rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def materialize(df, name: str = "table"):
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint folder and
    reading it back (one pass; survives lost executors, unlike cached blocks)."""
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` and ``work_path`` have left below this session's
    checkpoint folder. Call it at the end of a run, when its results are written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-work")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
