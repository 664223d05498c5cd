"""Reader state as streams (an extension: the originals are page-local callbacks).

The same operators as in ``operators.state``; late rows are bounded by a watermark.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.state import latest_progress
from folioframe.schema import CLIENT_PROGRESS
from folioframe.session import remove_folder


def read_progress(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of client progress."""
    reader = spark.readStream.schema(CLIENT_PROGRESS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def with_event_time(events: DataFrame, late: str = "7 days") -> DataFrame:
    """``at`` from the epoch milliseconds, watermarked: rows later than ``late`` may be dropped."""
    return events.withColumn("at", F.timestamp_millis("updatedAt")).withWatermark("at", late)


def distinct_events(events: DataFrame) -> DataFrame:
    """Repeated rows dropped within the watermark."""
    return events.dropDuplicatesWithinWatermark(["userId", "bookId", "percent", "updatedAt"])


def reading_activity(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Events and readers' furthest percent per book and window of event time."""
    return events.where("bookId is not null").groupBy(F.window("at", window), "bookId").agg(F.count(F.lit(1)).alias("n"), F.max("percent").alias("furthest"))


def latest_state_writer(folder: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: fold a batch into the latest-progress table under ``folder``.

    Batch ``n`` writes version ``n`` from version ``n - 1``; a batch that runs again rewrites its
    own version, so the result is the same.  A missing version before it is an error, as going on
    would lose the state; batch 0 begins anew.  The last ``keep`` versions stay, older ones go.
    """
    if keep < 2:
        raise ValueError("the version before must be kept")

    def path(n: int) -> str:
        return os.path.join(folder, f"v{n}")

    def done(spark: SparkSession, n: int) -> bool:
        mark = spark._jvm.org.apache.hadoop.fs.Path(path(n) + "/_SUCCESS")
        return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest_progress(batch)
        if n:
            if not done(spark, n - 1):
                raise RuntimeError(f"version {n - 1} of the state isn't in {folder}")
            new = latest_progress(spark.read.parquet(path(n - 1)).unionByName(new))
        new.write.mode("overwrite").parquet(path(n))
        if n >= keep:
            remove_folder(spark, path(n - keep))

    return write


def read_state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The table as a batch left it."""
    return spark.read.parquet(os.path.join(folder, f"v{version}"))


def append_events(events: DataFrame, folder: str) -> None:
    """Append client events (progress, openings, shelf toggles) to the log that streams read; nothing is rewritten."""
    events.write.mode("append").parquet(folder)


def refresh_view(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """Run ``write`` on what is new every ``every``: a view is at most that old.  Returns the running query."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
