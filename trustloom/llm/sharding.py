"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are weighed with Spark; groups of one weight are interchangeable, so the packing itself needs only a
histogram: weights up to 65,536 bytes exactly, larger ones rounded up to 12 binary digits, at most about 260,000 classes
whatever the input. The packer takes the classes from heavy to light; a class goes as a run into the bin that fits tightest,
found in a balanced tree ordered by what the bins have left. Runs are mapped back to groups by their number in the class.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import documents, numbered
from trustloom.session import staged

EXACT_WEIGHT = 65_536
DIGITS = 12
LEAF = 512


class Remaining:
    """A balanced tree of two levels over (left, first bin, bins): ordered leaves of at most ``LEAF`` entries, split in halves
    when they overflow. Entries stand for runs of bins with equal room."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int, int]]] = [[]]
        self.low: list[tuple[int, int, int]] = [(-1, -1, -1)]

    def add(self, entry: tuple[int, int, int]) -> None:
        at = bisect.bisect_right(self.low, entry) - 1
        leaf = self.leaves[at]
        bisect.insort(leaf, entry)
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves.insert(at + 1, leaf[half:])
            self.low.insert(at + 1, leaf[half])
            del leaf[half:]

    def take_tightest(self, size: int) -> tuple[int, int, int] | None:
        """Remove and return the entry with the least room of at least ``size``."""
        at = max(0, bisect.bisect_right(self.low, (size, -1, -1)) - 1)
        while at < len(self.leaves):
            leaf = self.leaves[at]
            k = bisect.bisect_left(leaf, (size, -1, -1))
            if k < len(leaf):
                entry = leaf.pop(k)
                if not leaf and at:
                    del self.leaves[at], self.low[at]
                return entry
            at += 1
        return None


def best_fit_decreasing(weights: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Runs ``(position, first bin, per bin)`` of the groups in falling order of weight, and the number of bins.

    A run starts at a position of that order and fills bins ``first bin, first bin + 1, ...`` with ``per bin`` groups each.
    """
    tree, runs, bins, position = Remaining(), [], 0, 0
    for weight, count in zip(weights.tolist(), counts.tolist()):
        while count:
            entry = tree.take_tightest(weight)
            if entry is None:
                per = max(1, capacity // weight)
                opened = -(-count // per)
                full, rest = (opened, 0) if count % per == 0 else (opened - 1, count % per)
                runs.append((position, bins, per))
                if full and capacity > per * weight:
                    tree.add((capacity - per * weight, bins, full))
                if rest:
                    tree.add((capacity - rest * weight, bins + full, 1))
                bins, position, count = bins + opened, position + count, 0
                continue
            left, first, same = entry
            per = left // weight
            used = min(same, -(-count // per))
            full = used if count >= used * per else used - 1
            rest = min(count, used * per) - full * per
            runs.append((position, first, per))
            placed = full * per + rest
            if full and left > per * weight:
                tree.add((left - per * weight, first, full))
            if rest:
                tree.add((left - rest * weight, first + full, 1))
            if same > used:
                tree.add((left, first + used, same - used))
            position, count = position + placed, count - placed
    return np.array(runs, dtype=np.int64).reshape(-1, 3), bins


def weight_class(weight: Column) -> Column:
    """The weight, rounded up to ``DIGITS`` binary digits beyond ``EXACT_WEIGHT``."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(weight.cast("double"))) - DIGITS).cast("bigint")
    return F.when(weight <= EXACT_WEIGHT, weight).otherwise(F.ceil(weight / step).cast("bigint") * step).cast("bigint")


def _bin_of(weights: np.ndarray, counts: np.ndarray, runs: np.ndarray):
    """A vectorised function (class weight, number in class) -> bin."""
    rising = weights[::-1].copy()
    offsets = (np.cumsum(counts) - counts)[::-1].copy()
    starts, first, per = (np.ascontiguousarray(runs[:, i]) for i in range(3))

    @F.pandas_udf("bigint")
    def bin_of(weight: pd.Series, number: pd.Series) -> pd.Series:
        position = offsets[np.searchsorted(rising, weight.to_numpy())] + number.to_numpy()
        run = np.searchsorted(starts, position, side="right") - 1
        return pd.Series(first[run] + (position - starts[run]) // per[run])
    return bin_of


def best_fit_shards(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text",
                    doc_id: str = "doc_id", step: float = 1 / 16384) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``; equal texts share a shard.

    With ``capacity`` (bytes) the number of shards is what the packing needs. With ``shards`` the capacity is an equal
    share and the smallest of 1, 2, 4, ... times ``step`` of it for which the packing needs no more shards. Size is the bytes of the text plus 1;
    a null text is an empty one. A group heavier than an equal share (or the capacity) cannot be indivisible and is dealt out in
    parts that fit; there are fewer than two parts per shard. A single row heavier than the capacity has a shard of its own
    size. Rows that repeat an id are rows like others, null ids too; empty tables give no rows. Slots are gapless from 0.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(content) + 1).cast("bigint").alias("size"),
                              F.crc32(content.cast("binary")).alias("text_crc32"), F.sha2(content, 256).alias("digest")), "weights")
    total = rows.agg(F.sum("size"), F.max("size")).first()
    if total[0] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    share = capacity or -(-int(total[0]) // shards)
    groups = rows.groupBy("digest").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    per = F.greatest(F.lit(1), F.floor(F.lit(share) / F.col("size"))).cast("bigint")
    parts = groups.withColumn("per", F.when(F.col("n") * F.col("size") > share, per).otherwise(F.col("n")))
    parts = (parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("per")) - 1)))
             .withColumn("held", F.least(F.col("per"), F.col("n") - F.col("part") * F.col("per")))
             .select("digest", "part", "n", "per", weight_class(F.col("held") * F.col("size")).alias("weight")))
    parts = staged(parts, "parts")
    counts = parts.groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.toPandas().sort_values("weight", ascending=False)
    weights, numbers = classes["weight"].to_numpy(np.int64), classes["n"].to_numpy(np.int64)
    room, more = max(share, int(weights[0])), max(1, int(share * step))
    while True:
        runs, bins = best_fit_decreasing(weights, numbers, room)
        if capacity or bins <= shards:
            break
        room, more = max(share + more, int(weights[0])), more * 2
    placed = numbered(parts.select("digest", "part", "weight"), "weight", counts, ["digest", "part"], "number")
    placed = placed.select("digest", "part", _bin_of(weights, numbers, runs)("weight", "number").cast("int").alias("shard"))
    # Fewer than two parts per shard are parts of groups heavier than a share: that many rows at most are broadcast.
    heavy = F.broadcast(parts.filter("per < n").select("digest", "per").distinct())
    light = rows.join(heavy, "digest", "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    dealt = rows.join(heavy, "digest")
    held = dealt.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    dealt = (numbered(dealt, "digest", held, ["doc_id"], "number")
             .withColumn("part", F.floor(F.col("number") / F.col("per")).cast("bigint")).drop("per", "number"))
    found = staged(light.unionByName(dealt).join(placed, ["digest", "part"])
                   .select("doc_id", "size", "text_crc32", "shard"), "shards")
    sizes = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    return numbered(found, "shard", sizes, ["doc_id"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op9_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    return best_fit_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_best_fit_shards": op9_best_fit_shards}
ORACLE: dict[str, str] = {}
