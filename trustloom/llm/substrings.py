"""Substring deduplication with fixed-block anchors.

A repeat of ``window`` words holds a whole block of ``(window + 1) // 2`` words that starts at a multiple of that length in its
document. These blocks are the anchors; every rolling window of that length in any document probes them. Hits on an anchor
that occurs again are extended: the windows of ``window`` words around a hit are compared by content, and runs of windows that
occur again are the maximal exact repeats.

Documents are dealt into cells of a few megabytes, stored once in buckets by cell, so that later steps meet them without another
shuffle. A cell sends its distinct hashes to shards by hash range as sorted, difference-coded arrays; a shard answers each cell
with one bit per hash. So a passage that is in every document is one entry per cell, no pairs are made, and no key is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.llm.common import documents
from trustloom.llm.words import text_bytes, window_hashes, word_bounds, word_hashes
from trustloom.session import shared_dir, staged

WINDOW = 35
CELL_BYTES = 1 << 22
SHARD_HASHES = 1 << 19
LEAST_SHARDS = 64
MOST_BUCKETS = 50_000
BITS = 44
ENTRIES = "shard int, cell bigint, kind int, n int, body binary"
ANSWERS = "cell bigint, kind int, shard int, n int, bits binary"


def packed_hashes(values: np.ndarray) -> bytes:
    """Rising 44-bit values as compressed planes of the bytes of their differences."""
    steps = np.diff(values, prepend=values[:1] * 0).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(steps[:, :6].T).tobytes(), 1)


def unpacked_hashes(body: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(zstandard.decompress(body), np.uint8).reshape(6, n).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


class Cell:
    """The words of a cell's texts and the positions where windows may start."""

    def __init__(self, column: pa.ChunkedArray, window: int) -> None:
        self.window, self.block = window, (window + 1) // 2
        self.data, offsets = text_bytes(column)
        self.first, self.last, self.borders = word_bounds(self.data, offsets)
        self.hashes = word_hashes(self.data, self.first, self.last)
        self.counts = np.diff(self.borders)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.hashes)) - self.borders[text]
        self.left = self.counts[text] - self.place

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 44-bit hashes of the rolling blocks, which occur twice, which are anchors, and each position's entry (-1: none).

        Texts shorter than a window take no part.
        """
        rolling = window_hashes(self.hashes, self.block) >> np.uint64(64 - BITS)
        counts = self.place[:len(rolling)] + self.left[:len(rolling)]
        valid = np.flatnonzero((self.left[:len(rolling)] >= self.block) & (counts >= self.window))
        values, inverse, often = np.unique(rolling[valid], return_inverse=True, return_counts=True)
        anchor = np.zeros(len(values), dtype=bool)
        anchor[inverse[self.place[valid] % self.block == 0]] = True
        entry = np.full(len(self.hashes), -1)
        entry[valid] = inverse
        return values, often > 1, anchor, entry

    def candidates(self, repeated: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct hashes (64 and 32 bits) of the windows around hits, which occur twice, and their positions and entries."""
        hits = np.flatnonzero((entry >= 0) & repeated[np.maximum(entry, 0)]) if len(repeated) else np.zeros(0, np.int64)
        near = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(hits - np.minimum(self.place[hits], self.window - self.block), 0), 1)
        np.add.at(near, hits + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (self.left >= self.window))
        long = window_hashes(self.hashes, self.window)[at]
        also = (window_hashes(self.hashes, self.window, salt=3)[at] >> np.uint64(32)).astype(np.uint32)
        values, index, inverse, often = np.unique(long, return_index=True, return_inverse=True, return_counts=True)
        return values, also[index], often > 1, at, inverse


def _segments(values: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's hashes begin in rising values of so many bits."""
    edges = [-(-(k << bits) // shards) for k in range(shards)]
    return np.concatenate([np.searchsorted(values, np.array(edges, dtype=np.uint64)), [len(values)]])


def _read_answers(answers: pa.Table, kind: int, borders: np.ndarray) -> np.ndarray:
    out = np.zeros(borders[-1], dtype=bool)
    for k, shard, n, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "n", "bits"))):
        if k == kind:
            out[borders[shard]:borders[shard] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def _rows(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _first_entries(window: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    def send(cell: pa.Table) -> pa.Table:
        values, twice, anchor, _ = Cell(cell.column("text"), window).probes()
        borders, number, rows = _segments(values, BITS, shards), cell.column("cell")[0].as_py(), []
        for shard in np.flatnonzero(np.diff(borders)).tolist():
            part = slice(borders[shard], borders[shard + 1])
            flags = np.packbits(np.concatenate([twice[part], anchor[part]])).tobytes()
            n = int(borders[shard + 1] - borders[shard])
            rows.append((shard, number, 0, n, flags + packed_hashes(values[part])))
        return _rows(rows, ENTRIES)
    return send


def _second_entries(window: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(cell: pa.Table, answers: pa.Table) -> pa.Table:
        if not cell.num_rows or not answers.num_rows:
            return _rows([], ENTRIES)
        work = Cell(cell.column("text"), window)
        values, _, _, entry = work.probes()
        repeated = _read_answers(answers, 0, _segments(values, BITS, shards))
        long, also, twice, _, _ = work.candidates(repeated, entry)
        borders, number, rows = _segments(long, 64, shards), cell.column("cell")[0].as_py(), []
        for shard in np.flatnonzero(np.diff(borders)).tolist():
            part = slice(borders[shard], borders[shard + 1])
            n = int(borders[shard + 1] - borders[shard])
            rows.append((shard, number, 1, n, np.packbits(twice[part]).tobytes() + long[part].tobytes() + also[part].tobytes()))
        return _rows(rows, ENTRIES)
    return send


def answer(shard: pa.Table) -> pa.Table:
    """A bit per hash of every cell: it occurs at least twice and, in the first round, is an anchor somewhere."""
    cells, kinds, sizes, bodies = (shard.column(c).to_pylist() for c in ("cell", "kind", "n", "body"))
    values, flags, anchors = [], [], []
    for kind, n, body in zip(kinds, sizes, bodies):
        if kind == 0:
            skip = -(-2 * n // 8)
            bits = np.unpackbits(np.frombuffer(body[:skip], np.uint8), count=2 * n).astype(bool)
            values.append(unpacked_hashes(body[skip:], n))
            flags.append(bits[:n])
            anchors.append(bits[n:])
        else:
            skip = -(-n // 8)
            pair = np.empty(n, dtype=[("h", np.uint64), ("g", np.uint32)])
            pair["h"], pair["g"] = np.frombuffer(body, np.uint64, n, skip), np.frombuffer(body, np.uint32, n, skip + 8 * n)
            values.append(pair)
            flags.append(np.unpackbits(np.frombuffer(body[:skip], np.uint8), count=n).astype(bool))
    joined = np.concatenate(values)
    if joined.dtype.names:
        order = np.lexsort((joined["g"], joined["h"]))
        ranked = joined[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
    else:
        _, inverse = np.unique(joined, return_inverse=True)
    again = np.bincount(inverse, weights=1.0 + np.concatenate(flags)) >= 2
    if anchors:
        again &= np.bincount(inverse, weights=np.concatenate(anchors)) > 0
    marked, rows, at = again[inverse], [], 0
    number = shard.column("shard")[0].as_py()
    for cell, kind, n in zip(cells, kinds, sizes):
        bits = marked[at:at + n]
        at += n
        if bits.any():
            rows.append((cell, kind, number, n, np.packbits(bits).tobytes()))
    return _rows(rows, ANSWERS)


def _cut(window: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(cell: pa.Table, answers: pa.Table) -> pa.Table:
        work = Cell(cell.column("text"), window)
        removed = np.zeros(len(work.hashes), dtype=bool)
        if answers.num_rows:
            values, _, _, entry = work.probes()
            repeated = _read_answers(answers, 0, _segments(values, BITS, shards))
            long, _, _, at, inverse = work.candidates(repeated, entry)
            again = _read_answers(answers, 1, _segments(long, 64, shards))
            starts = at[again[inverse]]
            cover = np.zeros(len(removed) + 1, dtype=np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + window, -1)
            removed = np.cumsum(cover)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(removed)])
        n_removed = lost[work.borders[1:]] - lost[work.borders[:-1]]
        raw, texts = work.data.tobytes(), []
        for a, b, gone in zip(work.borders[:-1].tolist(), work.borders[1:].tolist(), n_removed.tolist()):
            if gone:
                keep = np.concatenate([[False], ~removed[a:b], [False]])
                edges = np.flatnonzero(keep[1:] != keep[:-1]) + a
                runs = [raw[work.first[s]:work.last[e - 1]].split() for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
                texts.append(b" ".join(b" ".join(r) for r in runs).decode())
            else:
                texts.append(b" ".join(raw[work.first[a]:work.last[b - 1]].split()).decode() if b > a else "")
        return pa.table([cell.column("doc"), pa.array(texts, pa.string()), pa.array(work.counts.astype(np.int64)), pa.array(n_removed)],
                        names=["doc", "kept_text", "n_words", "n_removed"])
    return cut


def bucket_count(cells: int, partitions: int) -> int:
    """Buckets of four cells, or of more where there would be more than ``MOST_BUCKETS`` (Spark takes 100,000 at most)."""
    return min(MOST_BUCKETS, max(partitions, cells // 4))


def stored_cells(rows: DataFrame, cells: int) -> DataFrame:
    """The rows in buckets by cell, sorted by it, below the shared folder.

    Spark knows buckets of tables only; the name is dropped at once, the files and the plan that reads them stay.
    """
    spark = rows.sparkSession
    buckets = bucket_count(cells, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"cells_{uuid.uuid4().hex}"
    (rows.repartition(buckets, "cell").write.format("parquet").bucketBy(buckets, "cell").sortBy("cell")
     .option("compression", "zstd").option("path", shared_dir(spark, "cells")).saveAsTable(name))
    stored = spark.table(name)
    stored.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return stored


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", payload: Column | None = None) -> DataFrame:
    """One row per input row: ``doc`` (payload, else all columns), ``kept_text``, ``n_words``, ``n_removed``.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A word goes if it lies in a window of ``window`` words whose sequence starts anywhere
    else, in another row or the same one, overlapping or not; windows are judged on the input. What stays is joined by one
    space. Null, empty and short texts lose nothing; rows that repeat a text remove each other; long texts are whole (a text
    longer than a cell is a cell); an empty table gives no rows. Hashes of 96 bits decide equality of windows.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cells = max(1, -(-size // CELL_BYTES))
    shards = max(LEAST_SHARDS, -(-size // (6 * SHARD_HASHES)))
    cell = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("bigint").alias("cell")
    stored = stored_cells(docs.select((payload if payload is not None else F.struct("*")).alias("doc"), F.col(text).alias("text"), cell), cells)
    entries = stored.select("cell", "text").groupBy("cell").applyInArrow(_first_entries(window, shards), ENTRIES)
    first = staged(entries.groupBy("shard").applyInArrow(answer, ANSWERS), "answers")
    entries = (stored.select("cell", "text").groupBy("cell").cogroup(first.groupBy("cell"))
               .applyInArrow(_second_entries(window, shards), ENTRIES))
    second = staged(entries.groupBy("shard").applyInArrow(answer, ANSWERS), "answers")
    schema = T.StructType([stored.schema["doc"], *T.StructType.fromDDL("kept_text string, n_words bigint, n_removed bigint")])
    return stored.groupBy("cell").cogroup(first.unionByName(second).groupBy("cell")).applyInArrow(_cut(window, shards), schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(documents(spark, sf_dir), payload=F.struct("doc_id"))
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w[i:i + 34]) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
marked AS (SELECT k.doc_id, k.x, k.i, g.i IS NOT NULL AS lost FROM words k LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i)
SELECT d.doc_id, count(m.i) AS n_words, count(m.i) FILTER (WHERE m.lost) AS n_removed,
       sha256(coalesce(string_agg(m.x, ' ' ORDER BY m.i) FILTER (WHERE NOT m.lost), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE = {"op4_substring_dedup": OP4_SQL}
