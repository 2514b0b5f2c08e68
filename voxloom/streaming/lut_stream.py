"""Streaming extensions: table counts kept up to date, and ingest of a landing folder.

Counts are additive, so every micro-batch leaves its own counts, at most ``ibins * gbins``
rows, as a run of the table store.  The run is named after the batch: a batch that is
replayed after a failure replaces its run and counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.lut import LutSpec, lut_counts, update_store


def voxel_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_counts(stream: DataFrame, label: Column, spec: LutSpec = LutSpec()) -> DataFrame:
    """The batch aggregation, unchanged, over a stream (update or complete mode)."""
    return lut_counts(stream, label, spec)


def count_batch(batch: DataFrame, number: int, label: Column, store: str, name: str, spec: LutSpec = LutSpec()) -> None:
    """Add one micro-batch to the store."""
    update_store(batch.sparkSession, store, lut_counts(batch, label, spec), f"{name}-{number}")


def keep_counts(stream: DataFrame, label: Column, store: str, checkpoint: str, name: str = "stream",
                spec: LutSpec = LutSpec()) -> StreamingQuery:
    """Count all that has arrived into ``store`` (``lut.read_store`` sums it); ``name`` tells streams of one store apart."""
    return (stream.writeStream.foreachBatch(lambda batch, number: count_batch(batch, number, label, store, name, spec))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest(spark: SparkSession, landing: str, table: str, schema: T.StructType, checkpoint: str) -> StreamingQuery:
    """Append arriving slice files to a slice table, exactly once, partitioned by case."""
    stream = spark.readStream.schema(schema).parquet(landing).withColumn("arrived", F.current_timestamp())
    return (stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
            .partitionBy("case_id").trigger(availableNow=True).start())
