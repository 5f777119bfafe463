"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_SECOND = 1_000_000_000

# Severity name -> health points lost.
SEVERITY_WEIGHT = {"GREEN": 0, "ORANGE": 10, "RED": 50}

# Fixed value: the DNS name space of RFC 4122.
UUID_NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def half_even(value: Column, digits: int = 0) -> Column:
    """Round a double half to even at a decimal digit (on the scaled value, inside codegen)."""
    if digits == 0:
        return F.rint(value)
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def epoch_us(column: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"unix_date(CAST({column} AS DATE)) * 86400000000L + hour({column}) * 3600000000L"
                  f" + minute({column}) * 60000000L"
                  f" + CAST(extract(SECOND FROM {column}) * 1000000 AS BIGINT)")


def epoch_ns(column: str) -> Column:
    """Nanoseconds since 1970 of a TIMESTAMP_NTZ column as BIGINT."""
    return (epoch_us(column) * F.lit(1000)).cast("bigint")


def time_bound_ns(bound: str | int | None) -> int | None:
    """A time bound given as ns digits or ISO text; empty and 0 mean no bound."""
    if bound is None or bound == "":
        return None
    text = str(bound)
    if text.isdigit():
        return int(text) or None
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as error:
        raise ValueError(f"not a time bound: {text!r}") from error
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    whole = int(moment.replace(microsecond=0).timestamp())
    return whole * NS_PER_SECOND + moment.microsecond * 1000


def severity_weight(severity: Column, weight: Column | None = None) -> Column:
    """Points lost per severity; a non-zero explicit weight wins."""
    by_name = reduce(lambda acc, item: acc.when(F.upper(severity) == item[0], F.lit(item[1])),
                     SEVERITY_WEIGHT.items(), F.when(F.lit(False), F.lit(0)))
    if weight is None:
        return by_name
    return F.coalesce(F.when(weight != 0, weight), by_name)


def numeric_text(value: Column) -> Column:
    """DOUBLE of unsigned digits with at most one dot, else NULL."""
    return F.when(value.rlike(r"^(\d+\.?\d*|\.\d+)$"), value.try_cast("double"))


def json_number(value: Column, kind: Column | None = None) -> Column:
    """DOUBLE of a VARIANT: numbers as they are, booleans as 1 and 0, text by ``numeric_text``; else NULL. ``kind`` is its schema."""
    kind = F.schema_of_variant(value) if kind is None else kind
    return (F.when(kind == "STRING", numeric_text(F.try_variant_get(value, "$", "string")))
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
            .otherwise(F.try_variant_get(value, "$", "double")))


def ratio_percent(part: Column, total: Column) -> Column:
    """Whole percent of part in total, 0 when total is 0 or missing."""
    share = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    return F.coalesce(F.rint(share * 100.0), F.lit(0.0)).cast("bigint")


def cast_by_type(value: Column, kind: Column) -> Column:
    """Numeric value of text under a catalogue type: int truncates, str has none."""
    number = value.try_cast("double")
    return (F.when(kind == "int", number.cast("bigint").cast("double"))
            .when(kind == "float", number))


def default_value(v_num: Column, v_str: Column, kind: Column) -> Column:
    """Text of the newest value, with 0 or the empty text where none exists."""
    return F.when(kind == "str", F.coalesce(v_str, F.lit(""))).otherwise(
        F.coalesce(v_num, F.lit(0.0)).cast("string"))


def uuid5_dns(name: Column) -> Column:
    """Version-5 UUID of a name in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_DNS)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int")
                            .bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
                    F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2),
                    F.lit("-"), F.substring(digest, 21, 12))


def hex_to_int(value: Column) -> Column:
    return F.conv(value, 16, 10).cast("bigint")


def little_endian_ip(value: Column) -> Column:
    """Dotted address of 8 hex digits stored lowest byte first."""
    return F.concat_ws(".", *[F.conv(F.substring(value, at, 2), 16, 10) for at in (7, 5, 3, 1)])
