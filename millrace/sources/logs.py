"""Append logs of experiments: metric rows, events, prediction samples, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = "timestamp timestamp, step long, metrics map<string, double>"
EVENTS = "timestamp timestamp, event string, data map<string, string>"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def metric_rows(df: DataFrame, step: str, *names: str) -> DataFrame:
    """A row of the metric log for each row of df; null metrics are left out."""
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names]), lambda e: e["value"].isNotNull()))
    return df.select(F.current_timestamp().alias("timestamp"), F.col(step).cast("long").alias("step"), pairs.alias("metrics"))


def read_metrics(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """timestamp, step and a column for each metric named."""
    rows = spark.read.schema(METRICS).json(path)
    return rows.select("timestamp", "step", *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names])


def event(df: DataFrame, name: str, **data: Column) -> DataFrame:
    pairs = F.create_map(*[x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]) if data else F.create_map().cast("map<string, string>")
    return df.select(F.current_timestamp().alias("timestamp"), F.lit(name).alias("event"), pairs.alias("data"))


def prediction_samples(predictions: DataFrame, ordinal: str, most: int = 50) -> DataFrame:
    """The first rows by ordinal, with whether they are right; the limit is the operator."""
    return predictions.withColumn("correct", F.col("prediction") == F.col("reference")).orderBy(ordinal).limit(most)


def expired_checkpoints(checkpoints: DataFrame, keep: int, run: str | None = None) -> DataFrame:
    """checkpoints: epoch, path (and a run column). Those that retention deletes: all but the last `keep`; 0 deletes nothing."""
    if keep <= 0:
        return checkpoints.limit(0)
    by = Window.partitionBy(*([run] if run else [])).orderBy(F.desc("epoch"))
    return checkpoints.withColumn("__rank", F.row_number().over(by)).filter(F.col("__rank") > keep).drop("__rank")
