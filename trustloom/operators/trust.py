"""Trust indexes from health scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.scalar import half_even, uuid5_dns
from trustloom.functions.skew import exact_quantile
from trustloom.operators.flatten import TRUST_PATH, health_values, time_range

# The dimensions of a wide score row.
DIMENSIONS = ("CPUs", "Sensors", "Mem", "Proc", "Disks", "Nets")


def snapshot_trust(snapshots: DataFrame) -> DataFrame:
    """Add ``trust_index``: mean of the numeric health values of the row, 2 digits.

    Rows without a numeric value keep NULL. Works inside the row, no shuffle. Snapshots with a ``numbers`` column know their
    values' types; without it text of plain digits counts.
    """
    typed = "numbers" in snapshots.columns
    values = health_values(F.col("numbers" if typed else "data"), typed)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    mean = F.when(F.size(values) > 0, half_even(total / F.size(values), 2))
    return snapshots.withColumn("trust_index", mean)


def with_trust_entry(snapshots: DataFrame) -> DataFrame:
    """Write the index back into the message map, replacing an older one."""
    scored = snapshot_trust(snapshots)
    entry = F.create_map(F.lit(TRUST_PATH), F.col("trust_index").cast("string"))
    rest = F.map_filter(F.col("data"), lambda k, _: k != TRUST_PATH)
    return scored.withColumn("data", F.when(F.col("trust_index").isNotNull(),
                                            F.map_concat(rest, entry)).otherwise(F.col("data")))


def scores_from_snapshots(snapshots: DataFrame, start: int | None = None,
                          end: int | None = None) -> DataFrame:
    """``id, ts, score`` of messages in a time range that carry both id and index."""
    rows = snapshots.select("id", F.col("timestamp").cast("bigint").alias("ts"),
                            F.col("data").getItem(TRUST_PATH).try_cast("double").alias("score"))
    rows = time_range(rows, "ts", start, end)
    return rows.filter(F.col("id").isNotNull() & F.col("score").isNotNull())


def trust_per_device(scores: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """Mean of score/100 per device, 4 digits, with the message count.

    A partial and a final aggregate: a hot device reaches the shuffle as one row per task.
    """
    return scores.groupBy(key).agg(
        half_even(F.avg(F.col(score) / 100), 4).alias("trust_index"),
        F.count(F.lit(1)).alias("counter"))


def fold_strict(messages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running mean rounded to 4 digits at each message, with the count; rows come sorted by device and place.

    A row with a ``counter`` is the state of its device so far: mean and count instead of a score.
    """
    device, mean, count = None, 0.0, 0
    for batch in messages:
        done = []
        for key, score, counter in zip(batch["id"], batch["score"], batch["counter"]):
            if key != device:
                if device is not None:
                    done.append((device, mean, count))
                device, mean, count = key, 0.0, 0
            if counter >= 0:
                mean, count = score, counter
                continue
            mean = round((mean * count + score / 100) / (count + 1), 4)
            count += 1
        yield pd.DataFrame(done, columns=["id", "trust_index", "counter"])
    if device is not None:
        yield pd.DataFrame([(device, mean, count)], columns=["id", "trust_index", "counter"])


def trust_strict(scores: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Step-rounded running mean per device in arrival order (``id, ts, seq, score``), going on from ``before`` (an earlier result).

    Every message is folded. A step depends on the rounded result of the one before, so a device is read by one task, in order
    and with constant memory; the sort before it spills. ``trust_per_device`` has no such order.
    """
    kind = scores.schema["id"].dataType.simpleString()
    rows = scores.filter("id IS NOT NULL AND score IS NOT NULL").select(
        "id", F.lit(1).alias("part"), "ts", "seq", F.col("score").cast("double").alias("score"), F.lit(-1).cast("bigint").alias("counter"))
    if before is not None:
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ts", "seq")]
        rows = rows.unionByName(before.select("id", F.lit(0).alias("part"), *empty, F.col("trust_index").alias("score"), "counter"))
    return (rows.repartition("id").sortWithinPartitions("id", "part", "ts", "seq").select("id", "score", "counter")
            .mapInPandas(fold_strict, f"id {kind}, trust_index double, counter bigint"))


def dimension_trust(wide: DataFrame, dimensions: Sequence[str] = DIMENSIONS,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each dimension, zero means dropped, mean of the rest over 100."""
    means = wide.groupBy(*keys).agg(*[F.avg(d).alias(d) for d in dimensions])
    used = F.filter(F.array(*[F.col(d) for d in dimensions]), lambda m: m != 0)
    total = F.aggregate(used, F.lit(0.0), lambda acc, m: acc + m)
    return means.select(*keys, half_even(total / F.nullif(F.size(used), F.lit(0)) / 100, 4)
                        .alias("trust_index"), F.size(used).alias("dimensions"))


def requested_scores(requests: DataFrame, machines: DataFrame, scores: DataFrame) -> DataFrame:
    """Trust rows of the registered devices that valid requests ask for, once per request."""
    asked = (requests.filter(F.col("ids").isNotNull())
             .select("request_id", F.explode(F.array_distinct("ids")).alias("id")))
    return (asked.join(machines.select("id").distinct(), "id", "left_semi")
            .join(scores, "id").select("request_id", "id", "trust_index"))


def score_for(scores: DataFrame, device: str, address: str | None = None) -> DataFrame:
    """Trust row of one device, optionally also checked against its address."""
    rows = scores.filter(F.col("id") == device)
    if address is not None:
        rows = rows.filter(F.col("address") == address)
    return rows.select("id", "trust_index")


def score_messages(scores: DataFrame) -> DataFrame:
    """Service response rows as JSON payloads."""
    return scores.select(F.to_json(F.struct("id", "trust_index")).alias("value"))


def machine_id(column: Column) -> Column:
    """Device id of a hardware address given as an integer."""
    return uuid5_dns(column.cast("string"))


def latency_stats(timings: DataFrame, op: str = "op", elapsed: str = "elapsed_ms") -> DataFrame:
    """Count, mean, exact median, min and max per stage."""
    basic = timings.groupBy(op).agg(
        F.count(elapsed).alias("n"), F.avg(elapsed).alias("mean_ms"),
        F.min(elapsed).alias("min_ms"), F.max(elapsed).alias("max_ms"))
    median = exact_quantile(timings, [op], elapsed, 0.5, "median_ms")
    return basic.join(median, op)
