"""Tagged requirement messages -> services, requirements, edits and outcomes.

A message carries its entities and services as arrays, so all work on one
message happens in its row with higher-order functions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.hof import let, positions
from trustloom.functions.skew import (CHUNK_ROWS, drop_halo, running_total,
                                      split_series)
from trustloom.functions.text import match_spans
from trustloom.sources.schemas import ENTITIES, SERVICES

# Requirement vocabulary.
BUILD_CLASSES = ("middlebox",)
ASSET_CLASSES = ("storage_resource", "compute_resource", "operating_system", "service")
AGREEMENT_CLASSES = ("qos_value",)

# Requirement kind of each entity class, in the order of the requirement lists.
REQUIREMENT_KINDS = {
    "storage_resource": "storage", "compute_resource": "compute", "operating_system": "os",
    "service": "service", "middlebox": "service", "qos_value": "qos",
}

# Confidence gate and session length.
MIN_CONFIDENCE, MIN_MARGIN = 0.5, 0.1
SESSION_MINUTES = 120

SERVICE = "struct<middlebox:string,assets:array<struct<type:string,value:string>>>"


def tag_entities(text: Column, gazetteer: Mapping[str, str]) -> Column:
    """Entities of a text from surface forms: the longest form at each place, whole words, any case.

    The forms make one pattern that is scanned in the row; a few letters whose lower case has other letters
    are not folded.
    """
    forms = sorted({form.lower() for form in gazetteer}, key=lambda f: (-len(f), f))
    kinds = F.create_map(*[F.lit(x) for form, kind in gazetteer.items() for x in (form.lower(), kind)])
    pattern = r"(?iU)\b(?:" + "|".join(re.escape(form) for form in forms) + r")\b"
    return F.transform(match_spans(F.coalesce(text, F.lit("")), pattern), lambda m: F.struct(
        F.try_element_at(kinds, F.lower(m["value"])).alias("entity"), m["value"].alias("value"),
        m["start"].alias("start"), m["end"].alias("end"))).cast(ENTITIES)


def canonical(values: DataFrame, synonyms: DataFrame, column: str = "value") -> DataFrame:
    """Add ``canonical``: the canonical form of a surface form, the value itself without one."""
    table = synonyms.select(F.lower("surface").alias("_s"), F.col("canonical").alias("_c")).groupBy(
        "_s").agg(F.min("_c").alias("_c"))
    return (values.join(table, F.lower(F.col(column)) == F.col("_s"), "left")
            .withColumn("canonical", F.coalesce("_c", F.col(column))).drop("_s", "_c"))


def group_services(text: Column, entities: Column) -> Column:
    """Services of a message: each middlebox opens one, later assets attach to it.

    Assets before any middlebox form a service without one. Values are the
    original text of the span.
    """
    known = (*BUILD_CLASSES, *ASSET_CLASSES, *AGREEMENT_CLASSES)

    def value(e: Column) -> Column:
        return F.substring(text, e["start"] + 1, e["end"] - e["start"])

    def grouped(ordered: Column, opens: Column) -> Column:
        def service(start: Column, k: Column) -> Column:
            head = F.get(ordered, start)
            named = head["type"].isin(*BUILD_CLASSES)
            first = F.when(named, start + 1).otherwise(start)
            stop = F.coalesce(F.get(opens, k + 1), F.size(ordered))
            return F.struct(F.when(named, head["value"]).alias("middlebox"), F.transform(
                F.slice(ordered, first + 1, stop - first), lambda e: F.struct(
                    e["type"].alias("type"), e["value"].alias("value"))).alias("assets"))
        return F.transform(opens, service)
    spans = F.array_sort(F.transform(
        F.filter(entities, lambda e: e["entity"].isin(*known)),
        lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"),
                           e["entity"].alias("type"), value(e).alias("value"))))
    return let(spans, lambda ordered: let(F.filter(positions(ordered), lambda i: (i == 0) | F.get(
        ordered, i)["type"].isin(*BUILD_CLASSES)), lambda opens: grouped(ordered, opens))).cast(SERVICES)


def route_requirements(messages: DataFrame, *keys: str) -> DataFrame:
    """One row per requirement of the ``services`` column with its kind."""
    kinds = F.create_map(*[F.lit(x) for pair in REQUIREMENT_KINDS.items() for x in pair])
    rows = F.flatten(F.transform("services", lambda s: F.concat(
        F.when(s["middlebox"].isNotNull(), F.array(F.struct(
            F.lit("middlebox").alias("type"), s["middlebox"].alias("value"))))
        .otherwise(F.array().cast("array<struct<type:string,value:string>>")), s["assets"])))
    return (messages.select(*keys, F.posexplode(rows).alias("req_no", "r"))
            .select(*keys, "req_no", F.try_element_at(kinds, F.col("r.type")).alias("kind"),
                    F.col("r.value").alias("requirement"))
            .filter("kind IS NOT NULL"))


def requirement_list(entities: Column) -> Column:
    """Values of the entities of type ``requirements``, in order."""
    return F.transform(F.filter(entities, lambda e: e["entity"] == "requirements"),
                       lambda e: e["value"])


def summary_text(services: Column) -> Column:
    """Listing of services and their assets."""
    def lines(s: Column, i: Column) -> Column:
        head = F.concat(F.lit("Middlebox "), (i + 1).cast("string"), F.lit(": "),
                        F.coalesce(F.nullif(s["middlebox"], F.lit("")), F.lit("Unknown middlebox")))
        assets = F.array_join(F.transform(s["assets"], lambda a: F.concat(
            F.lit("\n    - "), F.coalesce(a["type"], F.lit("None")), F.lit(": "),
            F.coalesce(a["value"], F.lit("None")))), "")
        return F.when(F.size(s["assets"]) > 0, F.concat(head, F.lit("\n  Using assets:"), assets)
                      ).otherwise(head)
    return F.array_join(F.transform(services, lines), "\n\n")


def annotate(text: Column, services: Column) -> Column:
    """Wrap each service phrase as ``[text](label)``: longest phrase first, no overlaps."""
    return let(services, lambda s: _annotate(text, s))


def _annotate(text: Column, services: Column) -> Column:
    lowered = F.lower(text)
    phrases = F.flatten(F.transform(services, lambda s: F.concat(
        F.when(s["middlebox"] != "", F.array(F.struct(
            s["middlebox"].alias("phrase"), F.lit("middlebox").alias("label"))))
        .otherwise(F.array().cast("array<struct<phrase:string,label:string>>")),
        F.transform(s["assets"], lambda a: F.struct(a["value"].alias("phrase"),
                                                    a["type"].alias("label"))))))
    ordered = F.transform(F.array_sort(F.transform(phrases, lambda p, i: F.struct(
        (-F.length(p["phrase"])).alias("n"), i.alias("i"), p.alias("p")))), lambda x: x["p"])

    def places(p: Column) -> Column:
        gaps = F.split(lowered, F.concat(F.lit("\\Q"), F.lower(p["phrase"]), F.lit("\\E")), -1)
        size = F.length(p["phrase"])
        marks = F.when((F.size(gaps) > 1) & (size > 0), F.sequence(F.lit(1), F.size(gaps) - 1)
                       ).otherwise(F.array().cast("array<int>"))
        return F.transform(marks, lambda k: F.struct(
            (F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda a, g: a + F.length(g))
             + (k - 1) * size).alias("start"), size.alias("size"), p["label"].alias("label")))
    empty = F.array().cast("array<struct<start:int,size:int,label:string>>")
    spans = F.aggregate(ordered, empty, lambda acc, p: F.concat(acc, F.filter(
        places(p), lambda o: ~F.exists(acc, lambda a: (
            (a["start"] < o["start"] + o["size"]) & (o["start"] < a["start"] + a["size"]))))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        inside = F.substring(text, s["start"] + 1, s["size"])
        return F.struct((s["start"] + s["size"]).alias("at"), F.concat(
            acc["out"], before, F.lit("["), inside, F.lit("]("), s["label"], F.lit(")"))
            .alias("out"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def feedback_line(text: Column, services: Column) -> Column:
    return F.concat(F.lit("- "), annotate(text, services))


def _replace_at(items: Column, index: Column, make) -> Column:
    return F.transform(items, lambda s, i: F.when(i == index, make(s)).otherwise(s))


def add_asset(text: Column, services: Column, kind: Column, value: Column) -> Column:
    """Attach an asset to the service named last in the text, else to the last service.

    An asset whose value the service already has (any case) is not added twice.
    """
    return let(services, lambda s: _add_asset(text, s, kind, value)).cast(SERVICES)


def _add_asset(text: Column, services: Column, kind: Column, value: Column) -> Column:
    named = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.exists(
        services, lambda s: F.lower(s["middlebox"]) == w))
    latest = F.try_element_at(named, F.lit(-1))

    def lacks(s: Column) -> Column:
        return ~F.exists(s["assets"], lambda a: F.lower(a["value"]) == F.lower(value))
    at = positions(services)
    by_name = F.get(F.filter(at, lambda i: (F.lower(F.get(services, i)["middlebox"]) == latest)
                             & lacks(F.get(services, i))), F.lit(0))
    last = F.get(F.filter(at, lambda i: (i == F.size(services) - 1)
                          & lacks(F.get(services, i))), F.lit(0))
    target = F.coalesce(by_name, last, F.lit(-1))
    return _replace_at(services, target, lambda s: F.struct(
        s["middlebox"].alias("middlebox"), F.array_append(s["assets"], F.struct(
            kind.alias("type"), value.alias("value"))).alias("assets")))


def add_middlebox(text: Column, services: Column, value: Column) -> Column:
    """Name a service: fill the first unnamed one that has the assets that follow, else append.

    The assets are the known ones named after the middlebox in the text, up to
    the next known middlebox. A value that starts no word of the text changes nothing.
    """
    return let(services, lambda s: _add_middlebox(text, s, value)).cast(SERVICES)


def _add_middlebox(text: Column, services: Column, value: Column) -> Column:
    position = F.position(F.lower(value), F.lower(text))
    starts_word = (position == 1) | F.substring(text, position - 1, F.lit(1)).rlike(r"\s")
    usable = (position > 0) & starts_word
    tail = F.split(F.substring(F.lower(text), position, F.length(text)), r"\s+")
    following = F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0)))
    at = positions(following)
    stop = F.coalesce(F.get(F.filter(at, lambda i: F.exists(
        services, lambda s: F.lower(s["middlebox"]) == F.get(following, i))), F.lit(0)),
        F.size(following))
    assets = F.flatten(F.transform(services, lambda s: s["assets"]))
    wanted = F.flatten(F.transform(F.slice(following, F.lit(1), stop), lambda w: F.filter(
        assets, lambda a: F.lower(a["value"]) == w)))
    slots = positions(services)
    free = F.get(F.filter(slots, lambda i: F.get(services, i)["middlebox"].isNull() & F.forall(
        wanted, lambda a: F.array_contains(F.get(services, i)["assets"], a))), F.lit(0))
    filled = _replace_at(services, free, lambda s: F.struct(
        value.alias("middlebox"), s["assets"].alias("assets")))
    grown = F.array_append(services, F.struct(value.alias("middlebox"), wanted.alias("assets")))
    return (F.when(~usable, services).when(free.isNotNull(), filled).otherwise(grown))


def remove_value(services: Column, value: Column) -> Column:
    """Remove the first service of that name or the first asset of that value."""
    return let(services, lambda s: _remove_value(s, value)).cast(SERVICES)


def _remove_value(services: Column, value: Column) -> Column:
    wanted = F.lower(value)
    at = positions(services)

    def is_named(s: Column) -> Column:
        return F.coalesce(F.lower(s["middlebox"]) == wanted, F.lit(False))

    def first_asset(s: Column) -> Column:
        return F.array_position(F.transform(s["assets"], lambda a: F.lower(a["value"])), wanted)
    target = F.coalesce(F.get(F.filter(at, lambda i: is_named(F.get(services, i)) | (
        first_asset(F.get(services, i)) > 0)), F.lit(0)), F.lit(-1))
    hit = F.get(services, F.greatest(target, F.lit(0)))
    dropped = F.filter(services, lambda s, i: i != target)
    trimmed = _replace_at(services, target, lambda s: F.struct(
        s["middlebox"].alias("middlebox"), F.filter(s["assets"], lambda a, j: (
            j != first_asset(s) - 1)).alias("assets")))
    return (F.when(target < 0, services).when(is_named(hit), dropped).otherwise(trimmed))


def parse_feedback(messages: DataFrame, text: str = "text", entity: str = "entity") -> DataFrame:
    """Add ``feedback_entity`` and ``feedback_value`` of messages that carry both."""
    allowed = (*BUILD_CLASSES, *ASSET_CLASSES, *AGREEMENT_CLASSES)
    value = F.nullif(F.trim(F.regexp_extract(text, r":([^:]*)$", 1)), F.lit(""))
    return (messages.withColumn("feedback_entity", F.when(F.col(entity).isin(*allowed), F.col(entity)))
            .withColumn("feedback_value", value)
            .filter("feedback_entity IS NOT NULL AND feedback_value IS NOT NULL"))


def confidence_gate(scores: DataFrame, key: str = "msg_id", min_score: float = MIN_CONFIDENCE,
                    min_margin: float = MIN_MARGIN) -> DataFrame:
    """Winning intent per message, ``fallback`` when it is weak or close to the second.

    A message has one row per intent class, so its group is bounded by the classes.
    """
    both = F.sort_array(F.collect_list(F.struct("score", "intent")), asc=False)
    top = scores.groupBy(key).agg(F.slice(both, 1, 2).alias("_t"))
    first, second = F.col("_t")[0], F.get(F.col("_t"), F.lit(1))
    weak = (first["score"] < min_score) | (
        F.coalesce(first["score"] - second["score"], F.lit(1.0)) < min_margin)
    return top.select(key, F.when(weak, "fallback").otherwise(first["intent"]).alias("intent"),
                      first["score"].alias("score"))


def sessions(rows: DataFrame, key: str, seconds: str, order: Sequence[str],
             minutes: int = SESSION_MINUTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sessions per key that end after ``minutes`` without activity (``seconds`` is epoch seconds).

    Gaps are marked with a lag, numbered by a running total and then aggregated,
    so a hot key is cut along time.
    """
    cut = split_series(rows, [key], order, 2, chunk_rows)
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    marked = drop_halo(cut.withColumn("_new", F.coalesce(
        (F.col(seconds) - F.lag(seconds).over(w) >= minutes * 60).cast("bigint"), F.lit(1))))
    numbered = running_total(marked, [key], order, "_new", "session_no",
                             chunk_rows)
    return numbered.groupBy(key, "session_no").agg(
        F.min(seconds).alias("start_s"), F.max(seconds).alias("end_s"),
        F.count(F.lit(1)).alias("n"))


def sign_agreements(users: DataFrame, signed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """New agreement rows: ids continue the user's last one in signing order.

    ``signed`` has ``user_id, seq, related_ns``; unknown users get none.
    """
    last = users.select(F.col("id").alias("user_id"), F.coalesce(
        F.try_element_at("tlas", F.lit(-1))["id"].cast("bigint"), F.lit(0)).alias("_last"))
    counted = running_total(signed.withColumn("_one", F.lit(1)), ["user_id"], ["seq"], "_one", "_nth", chunk_rows)
    return counted.join(last, "user_id").select(
        "user_id", (F.col("_last") + F.col("_nth")).cast("string").alias("tla_id"), "related_ns")


def with_agreement(users: DataFrame, signed: DataFrame) -> DataFrame:
    """User documents with one newly signed agreement each (``user_id, related_ns``) appended."""
    last = F.coalesce(F.try_element_at("tlas", F.lit(-1))["id"].cast("bigint"), F.lit(0))
    entry = F.struct((last + 1).cast("string").alias("id"), F.col("related_ns").alias("related-ns"))
    grown = F.array_append(F.coalesce("tlas", F.array().cast(
        "array<struct<id:string,`related-ns`:array<string>>>")), entry)
    return (users.join(signed, users["id"] == signed["user_id"], "left")
            .withColumn("tlas", F.when(F.col("user_id").isNotNull(), grown).otherwise(F.col("tlas")))
            .drop("user_id", "related_ns"))


def availability(requests: DataFrame, matches: DataFrame, key: str = "request_id") -> DataFrame:
    """Whether any catalogue document matches each request; ``matches`` has a row per match or a count per request."""
    count = F.sum("matches") if "matches" in matches.columns else F.count(F.lit(1))
    found = matches.groupBy(key).agg(count.alias("matches"))
    return requests.select(key).distinct().join(found, key, "left").select(
        key, F.coalesce("matches", F.lit(0)).alias("matches"),
        (F.coalesce("matches", F.lit(0)) > 0).alias("available"))
