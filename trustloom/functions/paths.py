"""Expressions over slash paths, plain and keyed (``/node[name=h]/vm[name=v]``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustloom.functions.hof import let

# Path elements whose next name is an index, and their leaf types.
INDEXED_BEFORE = ("vm", "kb", "cpus", "if", "sensors", "disks")
OUTER_INDEXED = ("vm", "kb", "ioam")
LEAF_INDEXED = ("cpu", "sensor", "disk", "if", "namespace")

# An element: no slash except inside [...].
ELEMENT = r"(?:[^/\[\]]|\[[^\[\]]*\])+"


def unkeyed_path(elements: Column) -> Column:
    """Names of an element array joined by slashes, keys left out."""
    return F.concat(F.lit("/"), F.array_join(F.transform(elements, lambda e: e["name"]), "/"))


def keyed_path(elements: Column) -> Column:
    """Names with their ``name`` key; slashes inside a key become backslashes."""
    def one(e: Column) -> Column:
        key = F.replace(e["key"]["name"], F.lit("/"), F.lit("\\"))
        return F.when(key.isNotNull(), F.concat(e["name"], F.lit("[name="), key, F.lit("]"))
                      ).otherwise(e["name"])
    return F.concat(F.lit("/"), F.array_join(F.transform(elements, one), "/"))


def split_path(path: Column) -> Column:
    """Elements of a keyed path in one scan; leading and trailing slashes give none."""
    return F.regexp_extract_all(path, F.lit(ELEMENT), F.lit(0))


def element_type(element: Column) -> Column:
    return F.regexp_extract(element, r"^(\w+)", 1)


def element_name(element: Column) -> Column:
    """The ``name`` key of an element, NULL when it has none."""
    return F.nullif(F.regexp_extract(element, r"\[name=([^\]]+)\]", 1), F.lit(""))


def element_keys(element: Column) -> Column:
    """All ``[k=v]`` pairs of an element as a map."""
    pairs = F.regexp_extract_all(element, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    return F.map_from_entries(F.transform(
        pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"),
                                  F.regexp_replace(p, r"^[^=]*=", "").alias("value"))))


def path_prefixes(elements: Column) -> Column:
    """All non-empty prefixes of an element array as paths, shortest first."""
    return let(elements, lambda all_: F.transform(
        F.sequence(F.lit(1), F.size(all_)),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(all_, 1, i), "/"))))


def full_name(host: Column, path: Column, entity: Column) -> Column:
    """Keyed path of a sample: host on the first element, entity parts on the indexed ones.

    ``entity`` is ``leaf``, ``outer`` or ``outer:leaf``; elements without a part stay bare.
    """
    parts = F.split(entity, ":")
    elements = F.filter(F.split(path, "/"), lambda e: e != "")

    def named(e: Column, part: Column) -> Column:
        return F.when(part.isNotNull() & (part != ""),
                      F.concat(e, F.lit("[name="), part, F.lit("]"))).otherwise(e)

    def one(e: Column, i: Column) -> Column:
        return (F.when(i == 0, named(e, host))
                .when(e.isin(*OUTER_INDEXED), named(e, F.get(parts, F.lit(0))))
                .when(e.isin(*LEAF_INDEXED), named(e, F.element_at(parts, -1)))
                .otherwise(e))
    return F.concat(F.lit("/"), F.array_join(F.transform(elements, one), "/"))


def strip_leaf(fullname: Column) -> Column:
    """Parent container of a leaf entity path, other paths unchanged."""
    leaves = "|".join(LEAF_INDEXED)
    return F.regexp_replace(fullname, rf"/(?:{leaves})(?:\[[^\[\]]*\])?$", "")


def parent_path(fullname: Column) -> Column:
    """Keyed path without its last element, NULL for a root."""
    return let(split_path(fullname), parent_of)


def parent_of(elements: Column) -> Column:
    """Path of all elements but the last, NULL for a root."""
    return F.when(F.size(elements) > 1, F.concat(F.lit("/"), F.array_join(
        F.slice(elements, F.lit(1), F.size(elements) - 1), "/")))
