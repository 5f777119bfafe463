"""The objects of large JSON arrays, read by many tasks.

Spark's text source cuts a file into byte ranges at any one-byte separator; here that is the closing brace. Whether a brace is part of a
string, and how deep it is, depends on all text before it, so the ranges are read twice: first each range tells how it changes the state
(inside a string or not, depth) for either state it may start in; then, with the true state of every range known, the objects are
cut out. An object that crosses ranges comes in pieces, which are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r'\\.|["{]', re.S)
CHANGES = "file string, start bigint, turns boolean, out_depth bigint, out_least bigint, in_depth bigint, in_least bigint"


def scanned(text: str) -> tuple[bool, int, int]:
    """Of a text up to a closing brace: whether it ends in another state than it starts in (inside a string or not), and the opening
    braces outside strings if it starts outside, or inside."""
    turned, opens = False, [0, 0]
    for token in TOKEN.finditer(text):
        if token[0] == '"':
            turned = not turned
        elif token[0] == "{":
            opens[turned] += 1
    return turned, opens[0], opens[1]


def first_brace(text: str, inside: bool) -> int:
    """Where the first opening brace outside strings stands."""
    for token in TOKEN.finditer(text):
        if token[0] == '"':
            inside = not inside
        elif token[0] == "{" and not inside:
            return token.start()
    raise ValueError("no opening brace")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()), batch.column("value").to_pylist())


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: its effect if it starts outside a string, and if it starts inside one."""
    place, rows, state = None, [], None
    for key, text in _ranges(batches):
        if key != place:
            if place is not None:
                rows.append((*place, *state))
            place, state = key, [False, 0, 0, 0, 0]
        turned, even, odd = scanned(text)
        for at, (inside, opens) in enumerate(((state[0], odd if state[0] else even), (not state[0], even if state[0] else odd))):
            closed = inside == turned  # the brace at the end is outside a string
            depth = state[1 + 2 * at] + opens - closed
            state[1 + 2 * at], state[2 + 2 * at] = depth, min(state[2 + 2 * at], depth)
        state[0] ^= turned
    if place is not None:
        rows.append((*place, *state))
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in CHANGES.split(", ")])


def _starts(rows: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """The state in which every range starts: inside a string, depth, and the range in which the open object began."""
    out, place = {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != place:
            place, inside, depth, origin = r["file"], False, 0, -1
        out[r["file"], r["start"]] = inside, depth, origin
        change, least = (r["in_depth"], r["in_least"]) if inside else (r["out_depth"], r["out_least"])
        if depth == 0 or depth + least <= 0:
            origin = r["start"]
        inside, depth = inside ^ r["turns"], depth + change
    return out


PIECES = "file string, origin bigint, start bigint, whole boolean, value string"


def _cutter(starts: dict[tuple[str, int], tuple[bool, int, int]]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, rows = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], [f.split()[0] for f in PIECES.split(", ")])
        inside, depth, origin, crossed = False, 0, -1, False
        for key, text in _ranges(batches):
            if key != place:
                if held:
                    rows.append((place[0], origin, place[1], False, "".join(held)))
                place, held = key, []
                inside, depth, origin = starts[key]
                crossed = depth > 0
            turned, even, odd = scanned(text)
            opens = odd if inside else even
            if depth == 0 and opens:
                text, origin, crossed = text[first_brace(text, inside):], key[1], False
            inside ^= turned
            if depth or opens:
                held.append(text + "}")
            depth += opens - (not inside)
            if depth <= 0:
                if held:
                    rows.append((key[0], origin, key[1], not crossed, "".join(held)))
                held, depth = [], 0
            if len(rows) >= 1_000:
                yield flush()
        if held:
            rows.append((place[0], origin, place[1], False, "".join(held)))
        yield flush()
    return cut


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of every outermost object of JSON files, of arrays as of lines; other text is passed over.

    One row per byte range (``spark.sql.files.maxPartitionBytes``) reaches the driver. A task holds one object at a time.
    """
    ranges = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    starts = _starts(ranges.mapInArrow(_changes, CHANGES).collect())
    pieces = ranges.mapInArrow(_cutter(starts), PIECES)
    crossing = pieces.filter(~F.col("whole")).groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    joined = crossing.select(F.array_join(F.transform("p", lambda p: p["value"]), "").alias("value"))
    return pieces.filter("whole").select("value").unionByName(joined)
