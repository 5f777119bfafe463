"""Keeping hot keys in pieces.

One key may hold a third of all rows, so a window partitioned by that key would
put a third of the data into one task. The helpers here cut such a key along its
order, carry over the rows the next piece needs, and give exactly the rows the
plain window gives. Keys below ``chunk_rows`` are left alone: one counting pass
over the key columns (partial aggregation, no row is shuffled) decides. Hot keys are
numbered by ranges of (key, order): every range is counted alone and starts where the
ranges before it end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.session import staged

CHUNK_ROWS = 2_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def split_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_halo`` so that windows run per (keys, _chunk) in the order of the columns ``order``.

    With a key of more than ``chunk_rows`` rows, rows are numbered along each key and a chunk is a run of that many; a copy of the
    last ``depth`` rows of a chunk goes to the next one with ``_halo`` true. Evaluate frames that look back at most ``depth`` rows,
    then drop the halo rows. A chunk is cut anywhere, also among rows of one moment.
    """
    if largest_group(df, keys) <= chunk_rows:
        return df.withColumn("_chunk", F.lit(0).cast("bigint")).withColumn("_halo", F.lit(False))
    chunk_rows = max(chunk_rows, 2 * depth)
    numbered = prefix_sums(df, keys, order, F.lit(1).cast("bigint"), "_at")
    home = F.floor(F.col("_at") / F.lit(chunk_rows)).alias("_home")
    copied = F.pmod(F.col("_at"), F.lit(chunk_rows)) >= chunk_rows - depth
    targets = F.when(copied, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    return (numbered.select("*", home).withColumn("_chunk", F.explode(targets))
            .withColumn("_halo", F.col("_chunk") != F.col("_home")).drop("_at", "_home"))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_chunk")


def edge_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, newest: bool = True,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The last (or first) ``n`` rows per key in the order of the columns ``order``, with their rank as ``_rank``.

    For hot keys the rows are numbered along each key, so no task sorts one.
    """
    if largest_group(df, keys) > chunk_rows:
        numbered = prefix_sums(df, keys, order, F.lit(1).cast("bigint"), "_at")
        if not newest:
            return numbered.withColumn("_rank", (F.col("_at") + 1).cast("int")).filter(F.col("_rank") <= n).drop("_at")
        totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
        ranked = numbered.alias("l").join(totals.alias("r"), _same("l", "r", keys)).select(
            "l.*", (F.col("r._total") - F.col("l._at")).alias("_rank"))
        return ranked.filter(F.col("_rank") <= n).withColumn("_rank", F.col("_rank").cast("int")).drop("_at")
    along = [F.desc(c) if newest else F.asc(c) for c in order]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*along)))
    return ranked.filter(F.col("_rank") <= n)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cumulative sum of a column along each key, by ranges for hot keys."""
    if largest_group(df, keys) <= chunk_rows:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(window))
    before = prefix_sums(df, keys, order, F.col(value), "_before")
    return before.withColumn(name, F.col("_before") + F.coalesce(value, F.lit(0))).drop("_before")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
                parts: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before each row in the order of its key.

    The rows are ranged by key and order and stored, so that every range is summed by one task and starts with the sums of the
    ranges before it; a key may be in many ranges. Rows equal in key and order come in any order of theirs.
    """
    spark = df.sparkSession
    ranges = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.withColumn("_weight", value).repartitionByRange(count, *ranges).withColumn("_part", F.spark_partition_id())
                    .withColumn("_row", F.monotonically_increasing_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_sum"))
              .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*ranges[len(keys):], "_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inner", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return (summed.alias("l").join(starts.alias("r"), _same("l", "r", [*keys, "_part"]))
            .select("l.*", (F.col("l._inner") + F.col("r._start")).alias(name)).drop("_weight", "_part", "_row", "_inner"))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, most: int = 1_000_000) -> DataFrame:
    """Exact interpolated quantile per key without sorting a key in one task.

    The bracket of values around the wanted rank is narrowed by mergeable sketches and counts until it holds at most ``most``
    rows (or a single value); only its value counts are ranked.
    """
    keys = list(keys)
    frame = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    state = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = staged(state.withColumns({"_below": F.lit(0).cast("bigint"), "_inside": F.col("_n")}), "brackets")
    at = (F.col("_n") - 1) * F.lit(q)
    first, share = F.floor(at), at - F.floor(at)
    second = F.least(first + 1, F.col("_n") - 1)

    def worst(rows: DataFrame) -> int:
        return rows.filter(F.col("_lo") < F.col("_hi")).agg(F.max("_inside")).first()[0] or 0

    def within(rows: DataFrame) -> DataFrame:
        return (frame.alias("l").join(rows.alias("r"), _same("l", "r", keys))
                .select("l.*", *[f"r.{c}" for c in ("_n", "_lo", "_hi", "_below", "_inside")]))
    steps = 1_000
    widest = worst(state)
    while widest > most:
        inside = within(state).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        points = inside.groupBy(*keys, "_n", "_lo", "_hi", "_below", "_inside").agg(
            F.percentile_approx("_v", [i / steps for i in range(steps + 1)], 10_000).alias("_p"))
        place = F.floor((first - F.col("_below")) * steps / F.col("_inside")).cast("int")
        tried = points.select(*keys, "_n", "_lo", "_hi", "_below", "_inside",
                              F.get("_p", F.greatest(place - 2, F.lit(0))).alias("_a"), F.get("_p", F.least(place + 3, F.lit(steps))).alias("_b"))
        counts = (within(state).alias("l").join(tried.alias("r"), _same("l", "r", keys))
                  .select("l.*", "r._a", "r._b").groupBy(*keys).agg(
                      F.count_if(F.col("_v") < F.col("_a")).alias("_under"), F.count_if(F.col("_v").between(F.col("_a"), F.col("_b"))).alias("_held")))
        both = tried.alias("l").join(counts.alias("r"), _same("l", "r", keys)).select("l.*", "r._under", "r._held")
        # A sketch may miss a rank; then the bracket stays.
        good = (F.col("_under") <= first) & (F.col("_under") + F.col("_held") > second)
        state = staged(both.select(*keys, "_n", *[F.when(good, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in (
            ("_lo", "_a"), ("_hi", "_b"), ("_below", "_under"), ("_inside", "_held"))]), "brackets")
        before, widest = widest, worst(state)
        if widest >= before:
            break
    counts = within(state).filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_n", "_below", "_v").count()
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.col("_below") + F.sum("count").over(upto))

    def value_at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    picked = ranked.groupBy(*keys, "_n").agg(value_at(first).alias("_a"), value_at(second).alias("_c"))
    return picked.select(*keys, (F.col("_a") + (F.col("_c") - F.col("_a")) * share).alias(name))
