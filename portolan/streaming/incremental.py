"""Re-analysis as a stream: files that arrive are extracted batch by batch and replace their applications' rows.

An extra: batches are idempotent, because a batch that runs again replaces the same partitions with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.sources.store import replace_app_rows

FILES = "app_name string, path string, text string"


def arriving_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Parquet files of source texts as they appear in ``folder``."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(folder)


def analyse_as_they_come(files: DataFrame, extract: Callable[[DataFrame], DataFrame], store: str, checkpoint: str):
    """Starts a query that writes ``extract(batch)`` (with app_name) to ``store``, replacing the applications of each batch."""

    def batch(rows: DataFrame, _: int) -> None:
        replace_app_rows(extract(rows).withColumn("app_id", F.xxhash64("app_name")), store)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, user_id) per application and window, for streams and tables alike; on a stream later ones than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", size), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
