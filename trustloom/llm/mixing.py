"""Mixing sources to target weights by highest quotients (Sainte-Lague) over equal-token blocks.

Targets are found by filling: a source gets its weight times a common level, but at most ``most`` times its size. Every source is
cut by a seeded hash into shards of about ``shard_tokens`` words, a shard's documents stand in seeded order, and their words are
cut into equal blocks; sources with small targets have smaller blocks. Sources of one block size share a house of as many blocks as
their targets ask for. A (source, shard) party votes with its part of the target, and the house goes to the highest quotients
votes / (k + 1/2) of all parties: the divisor that fills the house exactly is found by counting quotients for many divisors at once,
a few passes over one row per party. A quota of q over b blocks takes every block q div b times and q mod b seeded blocks once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.llm.common import WORD, documents
from trustloom.llm.words import text_bytes, word_bounds
from trustloom.session import staged

WEIGHTS = (5, 2, 1)
BLOCK_TOKENS = 64
SHARD_TOKENS = 1 << 18
LEAST_BLOCKS = 16
DIVISORS = 256
TIE_SHARE = 1e-6
SEED = 17


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources (``source``, ``size``) with their ``place`` by code point, null last, and the weight of the place.

    Places come from counts per two leading bytes; a task sorts the sources that share them.
    """
    marked = sources.withColumn("_head", F.coalesce(F.hex(F.substring(F.col("source").cast("binary"), 1, 2)), F.lit("~")))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = marked.groupBy("_head").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (marked.join(heads, "_head").withColumn("place", place)
            .withColumn("weight", F.get(table, F.pmod("place", F.lit(len(weights))).cast("int"))).drop("_head", "_before"))


def filled_targets(sources: DataFrame, factor: float, most: float) -> DataFrame:
    """``source, size, target``: shares of ``factor`` times all sizes by weight, at most ``most`` times a source's size."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = capped = None
    full = F.lit(False)
    while True:
        kept = sources.agg(F.sum(F.when(full, F.col("size") * most)).alias("fixed"), F.count_if(full).alias("capped"),
                           F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if kept["capped"] == capped or not kept["free"]:
            break
        capped = kept["capped"]
        level = (factor * total - (kept["fixed"] or 0.0)) / kept["free"]
        full = full | (F.col("weight") * F.lit(level) > F.col("size") * most)
    share = F.col("weight") * F.lit(level or 0.0)
    return sources.select("source", F.col("size").cast("bigint").alias("source_size"),
                          F.when(full, F.col("size") * most).otherwise(share).cast("double").alias("target"))


def block_size(target: Column, block_tokens: int) -> Column:
    """A power of two, at most ``block_tokens``, so that a target has ``LEAST_BLOCKS`` blocks at least where it can."""
    return F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(target, F.lit(1.0)) / LEAST_BLOCKS))))).cast("int")


def seats(votes: np.ndarray, most: np.ndarray, divisors: np.ndarray) -> np.ndarray:
    """Quotients ``votes / (k + 1/2)`` of at least each divisor, at most ``most`` per party: a row per party."""
    return np.minimum(np.floor(votes[:, None] / divisors[None, :] + 0.5), most[:, None])


def house_divisors(parties: DataFrame) -> dict[int, float]:
    """For every block size the divisor at which its parties (``block, votes, most``) get the seats of their house together.

    The house is the sum of the votes, rounded, as far as the parties can fill it. A pass counts the seats for ``DIVISORS``
    divisors between two known ones and keeps the step that passes the house.
    """
    sums = parties.groupBy("block").agg(F.sum("votes").alias("votes"), F.sum("most").alias("most"), F.max("votes").alias("top")).collect()
    house = {r["block"]: min(int(r["votes"] / (1 + TIE_SHARE / 2) + 0.5), r["most"]) for r in sums}
    done = {r["block"]: 3 * r["top"] + 1.0 for r in sums if house[r["block"]] == 0}
    between = {r["block"]: (1e-12, 3 * r["top"] + 1.0) for r in sums if house[r["block"]] > 0}
    while between:
        grids = {block: np.geomspace(low, high, DIVISORS) for block, (low, high) in between.items()}

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {block: np.zeros(DIVISORS, np.int64) for block in grids}
            for batch in batches:
                block, votes, most = (batch.column(c).to_numpy() for c in ("block", "votes", "most"))
                for size, grid in grids.items():
                    own = np.flatnonzero(block == size)
                    for at in range(0, len(own), 4_096):
                        rows = own[at:at + 4_096]
                        total[size] += seats(votes[rows], most[rows], grid).sum(axis=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(total), DIVISORS)), pa.array(np.tile(np.arange(DIVISORS), len(total))), pa.array(np.concatenate(list(total.values())))],
                ["block", "step", "n"])
        counts = parties.mapInArrow(counted, "block bigint, step bigint, n bigint").groupBy("block", "step").agg(F.sum("n").alias("n"))
        found = {(r["block"], r["step"]): r["n"] for r in counts.collect()}  # DIVISORS rows per block size
        for block, grid in grids.items():
            n = np.array([found[block, i] for i in range(DIVISORS)])
            exact = np.flatnonzero(n == house[block])
            short = int(np.argmax(n < house[block])) if (n < house[block]).any() else DIVISORS - 1
            low, high = grid[max(0, short - 1)], grid[short]
            if len(exact) or high / low < 1 + 1e-15 or (low, high) == between[block]:
                done[block] = float(grid[exact[0]] if len(exact) else high)
                del between[block]
            else:
                between[block] = (float(low), float(high))
    return done


def quotas(parties: DataFrame) -> DataFrame:
    """``parties`` with ``quota``: their seats at the divisor of their house."""
    divisor = F.lit(None).cast("double")
    for block, value in house_divisors(parties).items():
        divisor = F.when(F.col("block") == block, F.lit(value)).otherwise(divisor)
    return parties.withColumn("quota", F.least(F.floor(F.col("votes") / divisor + 0.5), F.col("most")))


def _take(sizes: np.ndarray, blocks: int, quota: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block borders, how often each block is taken, and the first word of every document in the shard's order."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    borders = np.arange(blocks + 1, dtype=np.int64) * int(starts[-1]) // blocks
    times = np.full(blocks, quota // blocks, dtype=np.int64)
    times[np.random.Generator(np.random.PCG64(seed)).permutation(blocks)[:quota % blocks]] += 1
    return borders, times, starts


def _taken(borders: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(times * np.diff(borders))])
    block = np.minimum(np.searchsorted(borders, starts, side="right") - 1, len(times) - 1)
    at = upto[block] + times[block] * (starts - borders[block])
    return np.diff(at)


def _passes(text: str | None, borders: np.ndarray, times: np.ndarray, a: int, b: int) -> list[str]:
    """What each pass takes of a document (words a to b of its shard): the text itself, or its runs of words joined by line feeds."""
    first, last = np.searchsorted(borders, a, side="right") - 1, np.searchsorted(borders, b, side="left")
    own, out = times[first:last], []
    raw = begin = end = None
    for k in range(1, int(own.max(initial=0)) + 1):
        taken = np.flatnonzero(own >= k) + first
        if len(taken) == last - first:
            out.append(text)
            continue
        if raw is None:
            data, offsets = text_bytes(pa.array([text]))
            begin, end, _ = word_bounds(data, offsets)
            raw = data.tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[-2], taken, [last + 2]])) > 1)
        runs = []
        for s, e in zip(edges[:-1], edges[1:]):
            start, stop = max(int(borders[taken[s]]), a) - a, min(int(borders[taken[e - 1] + 1]), b) - a
            if stop > start:
                runs.append(raw[begin[start]:end[stop - 1]])
        out.append(b"\n".join(runs).decode())
    return out


def mixed_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = 1.5, most: float = 2.0, text: str = "text",
                  doc_id: str = "doc_id", source: str = "source", payload: Column | None = None, emit: bool = False,
                  block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc`` (payload), ``size, source, source_size, target, taken`` and, with ``emit``, ``passes``.

    Size counts words, null text has none and takes none. ``passes`` holds the text that each pass over the row takes.
    A null source is a source. No row exceeds ``most`` (rounded up) times its size. The choice depends on ids, seed and sizes only;
    rows that repeat id and size are interchangeable. Extra columns travel in ``payload``. Empty tables give no rows. A task
    holds one shard: about ``shard_tokens`` words, or one longer document.
    """
    doc = (payload if payload is not None else F.struct(doc_id)).alias("doc")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    drawn = [F.col(source).alias("source"), F.xxhash64(F.col(doc_id), F.lit(seed)).alias("draw"), size]
    tie = F.col(doc_id).cast("string").alias("tie")
    slim = staged(docs.select(*drawn) if emit else docs.select(doc, *drawn, tie), "sizes")
    sized = docs.select(doc, *drawn, tie, F.col(text).alias("text")) if emit else slim
    sources = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    sources = staged(cyclic_weights(sources, weights), "sources")
    targets = filled_targets(sources, factor, most).join(
        sources.select(F.col("source").alias("_s"), "rows", "place"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    targets = targets.withColumn("block", block_size(F.col("target"), block_tokens))

    def placed(rows: DataFrame) -> DataFrame:
        return (rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                .withColumn("shard", F.pmod(F.col("draw"), F.ceil((F.col("source_size") + F.col("rows") + 1) / F.lit(shard_tokens)))))
    shards = (placed(slim.select("source", "draw", "size")).groupBy("place", "shard", "block", "source_size", "target").agg(F.sum("size").alias("words"))
              .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / F.col("block")).cast("bigint"))))
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    tied = 1 + F.lit(TIE_SHARE / 2**31) * F.pmod(F.xxhash64("place", "shard", F.lit(seed)), F.lit(1 << 31))  # ties fall by seed
    shards = staged(shards.select("place", "shard", "block", "blocks", (ratio * F.col("blocks") * tied).alias("votes"),
                                  F.floor(F.col("blocks") * F.lit(most)).alias("most")), "parties")
    parties = quotas(shards).select("place", "shard", "blocks", "quota")
    rows = placed(sized).drop("rows", "block").join(parties, ["place", "shard"])
    schema = T.StructType([*rows.select("doc", "size", "source", "source_size", "target").schema, T.StructField("taken", T.LongType())])
    if emit:
        schema = schema.add("passes", T.ArrayType(T.StringType()))

    def choose(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["draw", "tie", "size"], kind="stable", na_position="last").reset_index(drop=True)
        key = np.random.SeedSequence([seed, int(shard["draw"].iloc[0]) & (2**64 - 1), len(shard)]).generate_state(1)[0]
        borders, times, starts = _take(shard["size"].to_numpy(), int(shard["blocks"].iloc[0]), int(shard["quota"].iloc[0]), int(key))
        out = shard[["doc", "size", "source", "source_size", "target"]].copy()
        out["taken"] = _taken(borders, times, starts)
        if emit:
            out["passes"] = [_passes(t, borders, times, int(a), int(b)) if b > a else []
                             for t, a, b in zip(shard["text"], starts[:-1], starts[1:])]
        return out
    return rows.groupBy("place", "shard").applyInPandas(choose, schema)


def mixed_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **rule) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per pass over a document with the words that the pass takes.

    A pass that takes all words keeps the text as it is; runs of words of a partial pass are joined by line feeds. Documents of
    which nothing is taken are gone, those taken twice are there twice. ``rule`` are arguments of ``mixed_sources``.
    """
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text])
    chosen = mixed_sources(docs, text=text, doc_id=doc_id, payload=rest, emit=True, **rule)
    rows = chosen.select("doc", F.explode("passes").alias("taken"))
    return rows.select(*[(F.col("taken") if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])


def op5_mixed_sources(spark, sf_dir: str) -> DataFrame:
    return mixed_sources(documents(spark, sf_dir)).select("doc.doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixed_sources": op5_mixed_sources}
ORACLE: dict[str, str] = {}
