"""Windows on event time, the same expression for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamps without a zone, which watermarks refuse, as UTC timestamps."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, size: str, by: str, ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """start, by, n, total per window; `late` sets the watermark after which a window is final."""
    e = event_time(df, ts)
    e = e.withWatermark(ts, late) if late else e
    g = e.groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(df: DataFrame, size: str, step: str, by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    e = event_time(df, ts)
    e = e.withWatermark(ts, late) if late else e
    return e.groupBy(F.window(ts, size, step), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(df: DataFrame, gap: str, by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """start, end (of the last event, without the gap), by, n per session."""
    e = event_time(df, ts)
    e = e.withWatermark(ts, late) if late else e
    g = e.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    return g.select(F.col("session_window.start").alias("start"), F.col("last_ts").alias("end"), by, "n")


def stream_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
