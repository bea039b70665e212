"""Tables that several plans read are written once, so that none of them carries the plan behind."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="broadsheet-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, which is deleted by forget()."""
    path = f"{_folder(spark)}/broadsheet/settled-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """The DataFrame as a written table in the shared folder. It stays there until forget(), at the latest the program's end.

    The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def forget() -> None:
    """Deletes all settled tables; what reads them must be done."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
