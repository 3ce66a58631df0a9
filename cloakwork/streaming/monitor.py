"""Streaming: group sizes in event-time windows against k, with a watermark; and stream-static Bloom linkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path


def window_groups(events: DataFrame, keys: Sequence[str], k: int, size: str = "30 days", late: str | None = "2 days", time: str = "ts") -> DataFrame:
    """(window_start, keys, n, anonymous): rows of each group in each tumbling window. Works on streams and tables."""
    own = events.withWatermark(time, late) if late and events.isStreaming else events
    per = own.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("window_start"), *keys, "n", (F.col("n") >= k).alias("anonymous"))


def run_to_table(stream: DataFrame, spark: SparkSession, name: str = "stream") -> DataFrame:
    """Runs a streaming aggregation over all that is there now; its last full state is the result."""
    out, marks = new_path(spark, name), new_path(spark, f"{name}-marks")
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def link_stream(stream: DataFrame, blocks: DataFrame, keys_of) -> DataFrame:
    """(id1, id2) of each streamed record and the static records that share a block key. keys_of: records to (id, key)."""
    return keys_of(stream).withColumnRenamed("id", "id1").join(blocks.withColumnRenamed("id", "id2"), "key").select("id1", "id2")
