"""Window features over the newest samples of each metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trustloom.functions.skew import CHUNK_ROWS, drop_halo, edge_rows, split_series
from trustloom.functions.scalar import half_even

SERIES = ("host", "path", "entity", "metric")
RING = 60


def typed(samples: DataFrame, catalog: DataFrame | None = None,
          legacy_counter: bool = False) -> DataFrame:
    """Add ``vtype``, ``counter`` and ``unit`` from the catalogue, keyed by subservice and metric.

    ``legacy_counter`` counts every non-text metric as a counter.
    """
    if catalog is None:
        out = samples
        if "vtype" not in samples.columns:
            kind = F.when(F.col("v_num").isNull(), "str").otherwise("float")
            out = out.withColumn("vtype", kind)
        if "counter" not in samples.columns:
            out = out.withColumn("counter", F.lit(0))
        if "unit" not in samples.columns:
            out = out.withColumn("unit", F.lit(""))
    else:
        dimension = catalog.select(
            F.col("subservice"), F.col("name").alias("metric"), F.col("type").alias("vtype"),
            "counter", F.coalesce("unit", F.lit("")).alias("unit"))
        out = (samples.withColumn("subservice", F.element_at(F.split("path", "/"), -1))
               .join(dimension, ["subservice", "metric"]).drop("subservice"))
    if legacy_counter:
        out = out.withColumn("counter", F.when(F.col("vtype") == "str", 0).otherwise(1))
    return out


def prepared(samples: DataFrame, depth: int, keys: Sequence[str] = SERIES,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Samples cut so that frames of ``depth`` rows stay inside (keys, _chunk)."""
    return split_series(samples, keys, ("ts", "seq"), depth, chunk_rows)


def series_window(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy("ts", "seq")


def last_rows(n: int, keys: Sequence[str] = SERIES) -> WindowSpec:
    return series_window(keys).rowsBetween(-(n - 1), 0)


def mean_of(window: WindowSpec) -> Column:
    """Mean by type: float 2 digits half even, int truncated, text 0."""
    mean = F.avg("v_num").over(window)
    return (F.when(F.col("vtype") == "float", half_even(mean, 2))
            .when(F.col("vtype") == "int", mean.cast("bigint").cast("double"))
            .otherwise(F.lit(0.0)))


def delta_of(back: Column) -> Column:
    """Newest minus an older value by type; text has 0."""
    change = F.col("v_num") - back
    return (F.when(F.col("vtype") == "float", half_even(change, 2))
            .when(F.col("vtype") == "int", change).otherwise(F.lit(0.0)))


def changed_over(window: WindowSpec) -> Column:
    """Whether the frame holds a value other than the newest."""
    text = F.min("v_str").over(window) != F.max("v_str").over(window)
    number = F.min("v_num").over(window) != F.max("v_num").over(window)
    return F.coalesce(F.when(F.col("vtype") == "str", text).otherwise(number), F.lit(False))


def spike_severity(mean: Column) -> Column:
    """0 green, 1 orange, 2 red for a non-counter number against its mean."""
    plain = (F.col("vtype") != "str") & (F.col("counter") == 0)
    return (F.when(plain & (F.col("v_num") > mean * 10), 2)
            .when(plain & (F.col("v_num") > mean * 3), 1).otherwise(0))


def ring_features(samples: DataFrame, ring: int = RING, keys: Sequence[str] = SERIES,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All ring features of every sample: the newest ``ring`` rows of its series.

    One shuffle on the series; every feature shares the same window.
    """
    frame = last_rows(ring, keys)
    out = prepared(typed(samples), ring, keys, chunk_rows).withColumns({
        "ring_size": F.count(F.lit(1)).over(frame),
        "ring_mean": mean_of(frame),
        "ring_min": F.min("v_num").over(frame),
        "ring_max": F.max("v_num").over(frame),
        "ring_delta": delta_of(F.first("v_num").over(frame)),
        "ring_changed": changed_over(frame),
    })
    out = drop_halo(out)
    dynamicity = (F.when(F.col("vtype") == "str", F.col("ring_changed").cast("double"))
                  .when(F.col("counter") != 0, F.col("ring_delta"))
                  .otherwise(F.col("ring_mean")))
    return out.withColumns({
        "dynamicity": dynamicity,
        "severity": spike_severity(F.col("ring_mean")),
        "change_severity": F.when((F.col("vtype") == "str") & F.col("ring_changed"), 1).otherwise(0),
    })


def tops(samples: DataFrame, count: int, keys: Sequence[str] = SERIES,
         chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The newest ``count`` values of every sample as an array, empty when fewer exist."""
    frame = last_rows(count, keys)
    values = F.collect_list("v_num").over(frame)
    out = prepared(samples, count, keys, chunk_rows).withColumn("tops", values)
    return drop_halo(out.withColumn("tops", F.when(F.size("tops") == count, F.col("tops"))
                                    .otherwise(F.array().cast("array<double>"))))


def delta(samples: DataFrame, count: int, keys: Sequence[str] = SERIES,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Change against the sample ``count`` back, clamped to the oldest; 0 means the whole ring."""
    back = count if count else RING - 1
    frame = series_window(keys).rowsBetween(-back, 0)
    out = prepared(typed(samples), back + 1, keys, chunk_rows)
    return drop_halo(out.withColumn("delta", delta_of(F.first("v_num").over(frame))))


def newest(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Newest sample per series: an aggregate, so the map side reduces it first."""
    rest = [c for c in samples.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_top")
    return samples.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_top.{c}") for c in rest])


def newest_n(samples: DataFrame, n: int, keys: Sequence[str] = SERIES,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The newest ``n`` samples of each series."""
    return edge_rows(samples, keys, ("ts", "seq"), n, chunk_rows=chunk_rows)


def change_only(samples: DataFrame, keys: Sequence[str] = SERIES,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Samples that differ from the one before; the first of a series counts as a change."""
    w = series_window(keys)
    out = prepared(samples, 2, keys, chunk_rows).withColumns({
        "_num": F.lag("v_num").over(w), "_str": F.lag("v_str").over(w),
        "_first": F.lag(F.lit(1)).over(w).isNull()})
    differs = (F.col("_first") | ~F.col("v_num").eqNullSafe(F.col("_num"))
               | ~F.col("v_str").eqNullSafe(F.col("_str")))
    return drop_halo(out.filter(differs)).drop("_num", "_str", "_first")


def display_rows(features: DataFrame) -> DataFrame:
    """Value with unit, its severity, dynamicity and its severity, as text."""
    value = F.when(F.col("vtype") == "str", F.col("v_str")).otherwise(
        F.when(F.col("vtype") == "int", F.col("v_num").cast("bigint").cast("string"))
        .otherwise(F.col("v_num").cast("string")))
    unit = F.when(F.col("unit") != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(F.lit(""))
    return features.withColumns({
        "display_value": F.concat(value, unit),
        "display_severity": F.col("severity").cast("string"),
        "display_dynamicity": F.col("dynamicity").cast("string"),
        "display_change": F.col("change_severity").cast("string")})


def metric_by_entity(samples: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Newest value of each metric as one column per named entity."""
    return (samples.filter(F.col("entity").isin(*entities)).groupBy("host", "metric")
            .pivot("entity", list(entities)).agg(F.max_by("v_num", F.struct("ts", "seq"))))
