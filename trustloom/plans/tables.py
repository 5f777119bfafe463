"""The provided tables as inputs of the operators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.scalar import epoch_ns


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    """One float series per user and event type."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("host"), F.lit("/node/bm").alias("path"),
        F.lit("").alias("entity"), F.col("event_type").alias("metric"), epoch_ns("ts").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("v_num"),
        F.lit(None).cast("string").alias("v_str"), F.lit("float").alias("vtype"),
        F.lit(0).alias("counter"), F.lit("").alias("unit"))


def event_ticks(spark: SparkSession, folder: str, *only: str) -> DataFrame:
    """Series per user that share their ticks: value (float), k (counter), kind (text); all or the named ones."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("double")

    def metric(name: str, number: Column, text: Column, vtype: str, counter: int) -> Column:
        return F.struct(F.lit(name).alias("metric"), number.cast("double").alias("v_num"),
                        text.cast("string").alias("v_str"), F.lit(vtype).alias("vtype"),
                        F.lit(counter).alias("counter"))
    metrics = {"value": metric("value", F.col("value"), F.lit(None), "float", 0), "k": metric("k", k, F.lit(None), "int", 1),
               "kind": metric("kind", F.lit(None), F.col("event_type"), "str", 0)}
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("host"), epoch_ns("ts").alias("ts"),
        F.col("event_id").alias("seq"), F.explode(F.array(*[metrics[m] for m in only or metrics])).alias("m"))
    return events.select("host", F.lit("/node/bm").alias("path"), F.lit("").alias("entity"),
                         "m.metric", "ts", "seq", "m.v_num", "m.v_str", "m.vtype", "m.counter",
                         F.lit("").alias("unit"))


def stored_range(df: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    """Inclusive ns bounds on a stored timestamp column, in the column's own type so that the scan can prune.

    Stored timestamps have microseconds: a lower bound is rounded up, an upper one down.
    """
    def moment(us: int) -> Column:
        return F.lit(datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(tzinfo=None, microsecond=us % 1_000_000)).cast("timestamp_ntz")
    if start is not None:
        df = df.filter(F.col(column) >= moment(-(-start // 1000)))
    if end is not None:
        df = df.filter(F.col(column) <= moment(end // 1000))
    return df


def event_scores(spark: SparkSession, folder: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Health scores per device in a time range: ``id, ts, seq, score``."""
    return stored_range(table(spark, folder, "events"), "ts", start, end).select(
        F.col("user_id").alias("id"), epoch_ns("ts").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("score"))
