"""Shared helpers: input tables, shared working folder, Arrow batch limits, bounded text chunks."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker: bounds a worker's memory when texts are long.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
_stashed: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keeps the batches that Python workers get small, whatever the session's defaults are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder as spark.checkpoint.dir names it; where it is unset (tests), a local one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            where = got.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="broadsheet-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/broadsheet/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings (dots as __) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes a DataFrame as Parquet to the shared folder and reads it again: short lineage, and executors can be lost.

    It stays until drop_stash(), at the latest until the program's end: results read their last stash when they are read.

    The shuffle files of the write go when it ends, not whenever the driver happens to collect its garbage.
    """
    path = new_path(df.sparkSession, label)
    _stashed[path] = df.sparkSession
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop_stash(*frames: DataFrame) -> None:
    """Deletes the files of stashed DataFrames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            _stashed.pop(path, None)


@atexit.register
def _drop_all() -> None:
    while _stashed:
        path, spark = _stashed.popitem()
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def check_new(df: DataFrame, *names: str) -> None:
    """ValueError if the input has one of these columns already, in any case."""
    have = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in have:
            raise ValueError(f"the input already has a column {name}")


def fresh_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with the DataFrame's own."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with at most `limit` characters each, but for a single longer text; null counts as empty."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield start, part


def crc32_text(col) -> F.Column:
    return F.crc32(F.encode(col.cast("string"), "utf-8"))


def worker_temp() -> str:
    """A scratch folder of this executor alone, for what DuckDB spills; DuckDB makes it when it spills and removes its files with the database."""
    return os.path.join(tempfile.gettempdir(), f"duck-{os.getpid()}")
