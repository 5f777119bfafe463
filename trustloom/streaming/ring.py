"""Keyed ring buffers over a stream: every sample with the features of the newest samples of its series.

The state keeps the newest samples of each series (``streaming/state.py``). A micro-batch puts them before its fresh samples and
evaluates the same window functions as a batch, so stream and batch agree, and hot series are cut the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trustloom.functions.skew import CHUNK_ROWS, drop_halo, edge_rows, split_series
from trustloom.streaming.state import START, read_state, touched_buckets, write_state

SAMPLE = ("ts", "seq", "v_num")


def ring_rows(samples: DataFrame, keys: Sequence[str], ring: int = 60, sustain: int = 20, below: float = float("inf"),
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ring features of samples (keys, ``ts, seq, v_num``).

    ``held`` is true while the newest ``sustain`` values stay below a threshold, ``changed`` marks the samples that change-only
    emission keeps. Other columns stay.
    """
    depth = max(ring, sustain)
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts", "seq")
    newest, recent = w.rowsBetween(-(ring - 1), 0), w.rowsBetween(-(sustain - 1), 0)
    return drop_halo(split_series(samples, keys, ("ts", "seq"), depth, chunk_rows).withColumns({
        "ring_size": F.count(F.lit(1)).over(newest), "ring_mean": F.avg("v_num").over(newest),
        "ring_delta": F.col("v_num") - F.first("v_num").over(newest),
        "changed": (F.row_number().over(w) == 1) | ~F.col("v_num").eqNullSafe(F.lag("v_num").over(w)),
        "held": (F.count(F.lit(1)).over(recent) == sustain) & F.coalesce(F.max("v_num").over(recent) < below, F.lit(False))}))


def newest_samples(samples: DataFrame, keys: Sequence[str], depth: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What the state keeps: the newest ``depth`` samples per series."""
    return edge_rows(samples, keys, ("ts", "seq"), depth, chunk_rows=chunk_rows).select(*keys, *SAMPLE)


def start_state(samples: DataFrame, keys: Sequence[str], path: str, depth: int) -> None:
    """Begin a state with the samples of a batch table, for a stream that goes on from there."""
    write_state(newest_samples(samples, keys, depth), path, START, keys)


def ring_stream(samples: DataFrame, keys: Sequence[str], path: str, state: str, checkpoint: str, ring: int = 60, sustain: int = 20,
                below: float = float("inf"), chunk_rows: int = CHUNK_ROWS, **trigger: object) -> StreamingQuery:
    """Write the ring features of a sample stream to ``path``, a folder per micro-batch, with the series' state at ``state``.

    Order holds within a micro-batch and between them: files must arrive in order of time.
    """
    schema = StructType([samples.schema[c] for c in (*keys, *SAMPLE)])

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.select(*keys, *SAMPLE).persist()
        kept = read_state(batch.sparkSession, state, schema, number, touched_buckets(batch, keys))
        both = kept.withColumn("_old", F.lit(True)).unionByName(batch.withColumn("_old", F.lit(False)))
        rows = ring_rows(both, keys, ring, sustain, below, chunk_rows).filter(~F.col("_old")).drop("_old")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        write_state(newest_samples(both, keys, max(ring, sustain), chunk_rows), state, number, keys)
        batch.unpersist()
    return (samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
            .trigger(**(trigger or {"availableNow": True})).start())


def ring_table(spark: SparkSession, path: str, *columns: str | Column) -> DataFrame:
    """The features written so far."""
    return spark.read.parquet(path).select(*columns)
