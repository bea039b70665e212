"""Streaming additions: the job log as a stream, and blocks that land in a folder turned into articles batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import jobs


def progress_counts(updates: DataFrame, time: str = "ts", stage: str = "stage", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Updates by stage and window of time; what comes later than `late` is left out."""
    return updates.withWatermark(time, late).groupBy(F.window(time, width), stage).agg(F.count(F.lit(1)).alias("n"))


def latest_status(updates: DataFrame, target: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Keeps the latest update of each key in `target`: a batch is merged with the state before it, each batch in a folder of its own, so one that runs again writes the same. The last two states are kept."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/{number - 1}"))
        jobs.latest(own, key, order).write.mode("overwrite").parquet(f"{target}/{number}")
        # The state before the last one is not needed even if this batch runs again.
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing(spark: SparkSession, folder: str, schema: StructType, run: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch plan on the Parquet files that have come since; pages are self-contained, so a page's blocks must come in one file."""

    def batch(blocks: DataFrame, number: int) -> None:
        run(blocks).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
