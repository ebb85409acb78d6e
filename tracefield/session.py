"""Session helpers: local test session and lineage cutting on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 10_000


def local_session(app: str = "tracefield", cpus: str = "8", shuffle: str = "8") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRACEFIELD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A rule list made on the driver, broadcast where its row count, checked here, allows.

    Without the hint the optimizer takes such a table for huge and would rather
    ship, or shuffle on a handful of rule keys, the data joined to it. Longer
    lists are left to the optimizer.
    """
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MAX_SMALL_ROWS else table


_local_folders: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream state: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster an
    unset folder is an error, since a machine-local one would not survive the
    loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _local_folders:
        _local_folders[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[sc.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read it back.

    Against ``DataFrame.checkpoint`` this computes the rows once instead of
    twice, gives the optimizer true sizes and pruned columns, and carries no
    inferred constraints along, which in a loop would double with every round.
    """
    path = f"{work_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int):
    """At most so many rows go to Python at once in what is run here: cells of a megabyte must not come by the ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
