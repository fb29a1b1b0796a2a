"""Micro-batch ingest: new files → entries → appended once.

The checkpoint of the file source takes the place of scan state; the anti-join on the dedup key makes replays harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.functions.text import dedup_key
from annalist.operators.catalog import new_entries
from annalist.sources.tail import register


def with_key(entries: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return entries.withColumn("dedup_key", dedup_key(blank("project"), blank("source_path"), blank("source_ref"), blank("title"), blank("body")))


def append_new(entries: DataFrame, table_path: str) -> None:
    """Append the entries that the table doesn't hold yet."""
    spark = entries.sparkSession
    keyed = with_key(entries)
    try:
        held = spark.read.parquet(table_path).select("dedup_key")
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        held = keyed.limit(0).select("dedup_key")
    new_entries(keyed, held).write.mode("append").parquet(table_path)


def ingest_stream(
    spark: SparkSession, folder: str, project: str, reader: Callable[[DataFrame], DataFrame], table_path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start ingesting files that appear in `folder`; without `every` it takes what is there and ends."""
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder)
    files = files.select(F.lit(project).alias("project"), F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_new(reader(batch), table_path))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def tail_stream(
    spark: SparkSession, folder: str, entries_of: Callable[[DataFrame], DataFrame], table_path: str, checkpoint: str, every: str | None = None, pattern: str = "*"
) -> StreamingQuery:
    """Start ingesting lines appended to files in `folder`; `entries_of` makes entries of (path, byte_offset, value). Without `every` it
    takes what is there and ends. Replays after a lost driver are harmless: an entry of the same key is written once."""
    register(spark)
    lines = spark.readStream.format("tail").option("pattern", pattern).load(folder)
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_new(entries_of(batch), table_path))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def tumbling_usage(calls: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls a window and client, of a stream with `called_at`; rows later than `late` are left out."""
    return calls.withWatermark("called_at", late).groupBy(F.window("called_at", width), "client").agg(F.count(F.lit(1)).alias("calls"))


def first_sightings(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of entries without repeats of a key within the watermark."""
    return entries.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["dedup_key"])
