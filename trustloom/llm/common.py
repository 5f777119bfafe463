"""Numbering and reading shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NUMBER_PIECE = 100_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def numbered(df: DataFrame, key: str, counts: DataFrame, order: Sequence[str], name: str,
             piece_rows: int = NUMBER_PIECE) -> DataFrame:
    """Add ``name``: gapless numbers from 0 per key, without sorting a key in one task.

    ``counts`` (key, n) holds the rows per key; the caller bounds its size, it is broadcast. A key is cut by a hash of the
    order columns into pieces of about ``piece_rows`` rows; each piece is sorted alone and starts after the ones before.
    ``df`` is read twice, so it should be a stored table. Keys must not be null; rows equal in ``order`` are interchangeable.
    """
    pieces = F.ceil(F.col("n") / F.lit(piece_rows)).cast("int").alias("_pieces")
    cut = (df.join(F.broadcast(counts.select(key, pieces)), key)
           .withColumn("_piece", F.pmod(F.xxhash64(*order), F.col("_pieces"))).drop("_pieces"))
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy(key, "_piece").count()
              .withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*order)))
    return (ranked.join(starts, [key, "_piece"])
            .withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_piece", "_rank", "_start"))


def order_key(doc_id: Column) -> Column:
    """Ids in order, null last."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))


def sample_filter(labelled: DataFrame, key: str, rows: int, seed: int) -> Column:
    """A test on the key that about ``rows`` of the labelled rows pass (a tenth more), by a hash of the key.

    A later ``orderBy(hash).limit(rows)`` then handles a bounded number of rows, however many tasks they come from.
    """
    n = labelled.count()
    share = 1.0 if n <= rows else min(1.0, 1.1 * rows / n)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))
