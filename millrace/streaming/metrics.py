"""Structured Streaming over the append logs: windowed metric means and the latest record of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def records(spark: SparkSession, path: str, schema: StructType | str, files: int = 1000) -> DataFrame:
    """A stream of JSON lines that appear below path, so many files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def window_means(stream: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Mean and count of value by key and window; rows later than the watermark are left out, and closed windows leave the state."""
    by = [F.window(time, width).alias("window"), F.col(key)]
    out = stream.withWatermark(time, late).groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "mean", "n")


def once(stream: DataFrame, time: str, *key: str, late: str = "1 hour") -> DataFrame:
    """Rows without repetitions of their key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def latest(stream: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key, for output mode update or complete; its state is one row per key."""
    names = stream.columns
    last = stream.select(F.struct(*names).alias("row"), F.col(time).alias("__time"), F.col(key).alias("__key"))
    return last.groupBy("__key").agg(F.max_by("row", "__time").alias("row")).select("row.*")
