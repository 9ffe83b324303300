"""Structured Streaming into grid tables, and windowed aggregates of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lattica.sources.writer import GridWriter


def write_stream(stream: DataFrame, writer: GridWriter, checkpoint: str, order: str | None = None, mode: str = "upsert", scheme: str = "month") -> DataStreamWriter:
    """Each micro-batch goes through ``writer.sink``; writing a batch again changes nothing.

    Of keys that repeat within a batch, the row of the greatest ``order`` (a column, which is not
    written) stays; without it, repeated keys are an error.
    """

    def one(batch: DataFrame, _: int) -> None:
        if order is not None:
            fields = [c for c in batch.columns if c not in ("sym", "time", order)]
            last = F.max_by(F.struct(*(F.col(c) for c in fields)), order).alias("r")
            batch = batch.groupBy("sym", "time").agg(last).select("sym", "time", *(F.col("r").getField(c).alias(c) for c in fields))
        writer.sink(batch, mode=mode, scheme=scheme)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def bars(ticks: DataFrame, width: str, value: str, watermark: str | None = None) -> DataFrame:
    """Open, high, low, close and count of ``value`` by sym and time window; batch or stream."""
    time = F.col("time").cast("timestamp")
    df = ticks.withColumn("__t", time)
    if watermark:
        df = df.withWatermark("__t", watermark)
    out = df.groupBy("sym", F.window("__t", width).alias("w")).agg(
        F.min_by(value, "time").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "time").alias("close"), F.count("*").alias("n")
    )
    return out.select("sym", F.col("w.start").cast("timestamp_ntz").alias("time"), "open", "high", "low", "close", "n")
