"""Structured Streaming forms of operations that advance over new data.

These are our own extension: a finite run with ``availableNow`` picks up what came since its
checkpoint and stops, so a stream is a batch that remembers where it ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], output_mode: str = "append") -> None:
    """Give each new micro-batch to ``sink`` and stop when there is none left."""
    query = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(output_mode)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, where: str = "true") -> None:
    """Append rows of files that arrived since the last run; a repeated batch is written once."""
    stream = spark.readStream.schema(schema).parquet(source).where(where)
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def windowed(stream: DataFrame, time: str, width: str, keys: Sequence[str], measure: str, late: str, slide: str | None = None) -> DataFrame:
    """count and sum by window and keys, for rows at most ``late`` behind the newest."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        stream.withWatermark(time, late).groupBy(w.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
    )


def first_by_key(stream: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of a key that arrives; repeats within the watermark go. For append mode."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def latest_by_key(stream: DataFrame, time: str, keys: Sequence[str]) -> DataFrame:
    """The row of each key with the latest time so far. For update or complete mode: a key's state is one row."""
    row = F.struct(*[F.col(f"`{c}`") for c in stream.columns])
    return stream.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.col(time)).alias("_row")).select("_row.*")
