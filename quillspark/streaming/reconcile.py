"""Incremental index upkeep as a stream of page versions, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each page."""
    w = Window.partitionBy("space_id", "path").orderBy(F.col("modified_ns").desc(), F.col("body").desc())
    return versions.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def upserted(index: DataFrame, batch: DataFrame) -> DataFrame:
    """The index with the pages of a batch replaced or added."""
    fresh = newest(batch).select(*index.columns)
    return index.join(fresh.select("space_id", "path"), ["space_id", "path"], "left_anti").select(*index.columns).unionByName(fresh)


def keep_index(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch as a version of the index table; readers take the newest with :func:`newest`.

    A batch that is run again overwrites its own partition, so a retry adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each kind in tumbling windows (an extension: the reference counts without event time)."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", size).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
