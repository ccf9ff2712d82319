"""History and requests as streams: events arrive as files, batches are appended or folded into a table of latest values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def history_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_history(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends every batch once: the file sink's log makes a repeated batch a no-op."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_requests(stream: DataFrame, key: str, value: str, request: str) -> DataFrame:
    """The answer to the latest request per key, kept as streaming state of one row a key; stale answers lose."""
    return stream.groupBy(key).agg(F.max_by(value, request).alias(value), F.max(request).alias(request))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window; the watermark bounds the state and says how late an event may be."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def drained(frame: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns its result table; for tests and small checks."""
    name = f"drained_{uuid.uuid4().hex}"
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
