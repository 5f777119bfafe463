"""Streaming trust indexes and answers to requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trustloom.functions.scalar import half_even
from trustloom.operators.trust import requested_scores, trust_strict
from trustloom.session import shared_dir
from trustloom.streaming.state import read_state, touched_buckets, write_state


def running_trust(scores: DataFrame) -> DataFrame:
    """Sum and count per device as streaming state; use with update mode."""
    return scores.groupBy("id").agg(F.sum(F.col("score") / 100).alias("total"),
                                    F.count(F.lit(1)).alias("counter"))


def update_table(updates: DataFrame, path: str, checkpoint: str,
                 **trigger: object) -> StreamingQuery:
    """Append each micro-batch's changed rows with its batch number; a retry rewrites its own folder."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return (updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start())


def latest_updates(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Newest row per key of an update table."""
    rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        key, *[F.col(f"_r.{c}") for c in rest])


def stream_trust(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """Run the stream over all available input and return the trust table."""
    kind = scores.schema["id"].dataType.simpleString()
    path, checkpoint = shared_dir(spark, "trust"), shared_dir(spark, "trust-offsets")
    update_table(running_trust(scores), path, checkpoint).awaitTermination()
    table = latest_updates(spark, path, f"id {kind}, total DOUBLE, counter BIGINT")
    return table.select("id", half_even(F.col("total") / F.col("counter"), 4).alias("trust_index"),
                        "counter")


def strict_trust_stream(scores: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Step-rounded running mean per device in arrival order; the state table at ``path`` holds ``id, trust_index, counter``.

    Every message is folded, after the device's state from the batches before. Devices without a fresh message keep their state.
    """
    kind = scores.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"id {kind}, trust_index double, counter bigint")

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        before = read_state(spark, path, schema, number, touched_buckets(batch, ["id"]))
        write_state(trust_strict(batch, before), path, number, ["id"])
        batch.unpersist()
    return (scores.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
            .trigger(**(trigger or {"availableNow": True})).start())


def strict_trust_table(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The newest state of all devices."""
    return read_state(spark, path, StructType.fromDDL(f"id {kind}, trust_index double, counter bigint"), 1 << 62)


def answer_requests(requests: DataFrame, machines: DataFrame, scores: DataFrame, path: str,
                    checkpoint: str, **trigger: object) -> StreamingQuery:
    """Join each micro-batch of requests to the newest scores and append the answers as JSON."""
    def save(batch: DataFrame, number: int) -> None:
        requested_scores(batch, machines, scores).write.mode("overwrite").json(
            f"{path}/batch={number}")
    return (requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
            .trigger(**(trigger or {"availableNow": True})).start())
