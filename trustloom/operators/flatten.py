"""Telemetry envelopes and snapshot messages -> rows and path/value maps.

Everything here stays inside the row that carries the message: arrays are
reshaped with higher-order functions, so no message is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions.hof import let
from trustloom.functions.paths import keyed_path, unkeyed_path
from trustloom.functions.scalar import json_number, numeric_text
from trustloom.sources.schemas import SNAPSHOT, WIDE_SCORE

HEALTH_PREFIX = "/health/node/"
TRUST_PATH = "/health/node/trust_index"


def _json_text(val: Column) -> Column:
    return F.decode(F.unbase64(val["jsonVal"]), "UTF-8")


def decode_union(val: Column) -> Column:
    """Text and number of a union value: ``value, number``.

    The text is decoded JSON (strings without quotes), then int, string, float, else UNKNOWN. JSON numbers, booleans and floats are
    numbers as they are, signed or with an exponent; integers travel as text and count like strings, only if they are plain
    digits. JSON that cannot be read is text. JSON is parsed once.
    """
    def pair(value: Column, number: Column) -> Column:
        return F.struct(value.alias("value"), number.alias("number"))

    def json(text: Column) -> Column:
        return let(F.try_parse_json(text), lambda v: F.when(v.isNull(), pair(text, numeric_text(text))).otherwise(
            let(F.schema_of_variant(v), lambda kind: pair(
                F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(text), json_number(v, kind)))))
    plain = pair(F.coalesce(val["intVal"], val["stringVal"], val["floatVal"].cast("string"), F.lit("UNKNOWN")),
                 F.when(val["intVal"].isNotNull(), numeric_text(val["intVal"]))
                 .when(val["stringVal"].isNotNull(), numeric_text(val["stringVal"])).otherwise(val["floatVal"]))
    return F.when(val["jsonVal"].isNotNull(), let(_json_text(val), json)).otherwise(plain)


def explode_envelope(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per update with its position; messages without updates give none."""
    return (messages.filter(F.col("update.update").isNotNull())
            .select(*keep, F.col("update.timestamp").alias("timestamp"),
                    F.posexplode("update.update").alias("pos", "item"))
            .select(*keep, "timestamp", "pos",
                    unkeyed_path(F.col("item.path.elem")).alias("path"),
                    keyed_path(F.col("item.path.elem")).alias("keyed_path"),
                    decode_union(F.col("item.val"))["value"].alias("value")))


def last_per_path(pairs: Column) -> Column:
    """Array of (path, pos, ...) -> the same with only the last pos of each path."""
    return let(F.array_sort(pairs), lambda ordered: F.filter(ordered, lambda p, i: F.coalesce(
        F.get(ordered, i + 1)["path"] != p["path"], F.lit(True))))


def envelope_snapshots(messages: DataFrame, device: Column, *keep: str,
                       collapse: bool = True) -> DataFrame:
    """Envelope -> ``id, timestamp, data, numbers`` with one entry per path, the last one wins.

    ``data`` has the values as text, ``numbers`` those that count as numbers by their type.

    ``collapse`` drops the keys from the paths, so siblings share one entry;
    without it every keyed entity keeps its own.
    """
    name = unkeyed_path if collapse else keyed_path
    pairs = F.transform(F.col("update.update"), lambda u, i: F.struct(
        name(u["path"]["elem"]).alias("path"), i.alias("pos"), u["val"].alias("val")))
    decoded = F.transform(last_per_path(pairs), lambda e: F.struct(e["path"].alias("path"), decode_union(e["val"]).alias("v")))

    def entries(field: str) -> Column:
        return F.map_from_entries(F.transform(F.col("_last"), lambda e: F.struct(e["path"].alias("key"), e["v"][field].alias("value"))))
    return (messages.filter(F.col("update.update").isNotNull())
            .select(*keep, device.alias("id"), F.col("update.timestamp").alias("timestamp"), decoded.alias("_last"))
            .select(*keep, "id", "timestamp", entries("value").alias("data"), entries("number").alias("numbers")))


def health_values(data: Column, numbers: bool = False) -> Column:
    """Numbers below the health prefix, the index itself left out; ``data`` maps to text or, with ``numbers``, to numbers."""
    entries = F.filter(F.map_entries(data), lambda e: F.startswith(
        e["key"], F.lit(HEALTH_PREFIX)) & (e["key"] != TRUST_PATH))
    return F.filter(F.transform(entries, lambda e: e["value"] if numbers else numeric_text(e["value"])),
                    lambda v: v.isNotNull())


def parse_snapshots(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """JSON text -> snapshot columns, ``numbers`` and ``malformed``, which holds unreadable text.

    ``data`` has the values as text; ``numbers`` has them by their JSON type.
    """
    typed = F.from_json(column, "data MAP<STRING, VARIANT>")
    parsed = F.from_json(column, SNAPSHOT + ", _corrupt STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return (lines.withColumn("_m", parsed)
            .select(*keep, "_m.id", "_m.timestamp", "_m.data",
                    F.transform_values(typed["data"], lambda _, v: json_number(v)).alias("numbers"),
                    F.col("_m._corrupt").alias("malformed")))


def repair_timestamp(text: Column) -> Column:
    """Put quotes around a bare ISO ``Timestamp`` value."""
    return F.regexp_replace(
        text, r'("Timestamp":\s*)(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+)', '$1"$2"')


def parse_wide_scores(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Repaired wide score messages as columns."""
    parsed = F.from_json(repair_timestamp(F.col(column)), WIDE_SCORE)
    return lines.withColumn("_m", parsed).select(*keep, "_m.*")


def time_range(df: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    """Inclusive bounds on a ns column; a missing bound does not filter."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def route_feed(rows: DataFrame, path: str = "keyed_path") -> DataFrame:
    """Discriminate feed rows by their path: score, symptom, activity or metric."""
    p = F.col(path)
    kind = (F.when(F.contains(p, F.lit("health")), "score")
            .when(F.contains(p, F.lit("symptoms")), "symptom")
            .when(F.contains(p, F.lit("active")) & ~F.contains(p, F.lit("/bm/mem")), "activity")
            .otherwise("metric"))
    target = (F.when(kind == "score", F.replace(p, F.lit("/health"), F.lit("")))
              .when(kind == "symptom", F.substring_index(p, "/symptoms[name=", 1))
              .when(kind == "activity", F.replace(p, F.lit("/active"), F.lit("")))
              .otherwise(p))
    label = F.when(kind == "symptom", F.regexp_extract(
        p, r"/symptoms\[name=(.*?)\](?:/severity)?$", 1))
    return rows.withColumns({"kind": kind, "node": target, "label": label})


# Subscription path -> feeds it selects.
SUBSCRIPTIONS = {
    "/": ("metrics", "symptoms", "health", "subservice", "subservices"),
    "/metrics": ("metrics",),
    "/symptoms": ("symptoms",),
    "/health": ("health",),
    "/subservices/subservice": ("subservice",),
    "/subservices": ("subservices",),
}


def subscribed_feeds(feeds: dict[str, DataFrame], subscribed: list[str]) -> DataFrame:
    """Union of the feeds (``path, value``) that the subscription paths select."""
    wanted = {name for path in subscribed for name in SUBSCRIPTIONS.get(path, ())}
    chosen = [df.select("path", F.col("value").cast("string").alias("value"),
                        F.lit(name).alias("feed"))
              for name, df in feeds.items() if name in wanted]
    if not chosen:
        raise ValueError(f"no feed is selected by {subscribed}")
    result = chosen[0]
    for df in chosen[1:]:
        result = result.unionByName(df)
    return result


def metric_only(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples with a value whose metric is in the catalogue."""
    known = catalog.select(F.col("name").alias("metric")).distinct()
    return samples.filter(F.col("v_num").isNotNull() | F.col("v_str").isNotNull()).join(
        known, "metric", "left_semi")
