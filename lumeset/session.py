"""Spark sessions for local work; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lumeset", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all run in one process; else raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="lumeset-"))
    return f"file://{_own_folder[0]}"


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: what follows survives lost executors without computing df anew, and an
    expensive df that is used twice is computed once. Each call takes a new folder.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lumeset/{uuid.uuid4().hex}"
    if (passing := _passing.get()) is not None:
        passing.append(folder)
    df.write.options(**options).parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Folders that the innermost distilled() has stored so far.
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


def distilled(spark: SparkSession, name: str, make: Callable[[], DataFrame], **options: object) -> DataFrame:
    """materialise what ``make`` returns, then delete the tables that it stored on the way. Nothing else may read those."""
    stored: list[str] = []
    before = _passing.set(stored)
    try:
        made = make()
    finally:
        _passing.reset(before)
    out = materialise(made, name, **options)
    for folder in stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out
