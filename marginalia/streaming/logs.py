"""Append-only logs as streams: idempotent append by content hash, counts of windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_once(stream: DataFrame, content: list[str], target: str, checkpoint: str, at: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends rows whose content was not there before, in what has come so far; runs what is available, then ends.

    The state holds one hash per content, and with an event time `at` only those within `late`.
    Batch numbers name the folders, so a batch that is written again replaces itself.
    """
    rows = stream.withColumn("content_hash", F.sha2(F.concat_ws("|", *content).cast("binary"), 256))
    rows = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"]) if at else rows.dropDuplicates(["content_hash"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def windowed(stream: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts of tumbling windows; a window is final once the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
