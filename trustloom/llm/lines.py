"""Line deduplication with a sharded minimal perfect hash.

Lines become pairs of 64-bit hashes. Those in at least ``min_docs`` documents are dealt into shards by their first hash; each shard
is a minimal perfect hash (hash and displace: a seed per bucket sends its keys to free slots, no slot stays empty) over compact
arrays: a fingerprint, the count and the largest id per slot. Documents send their lines to the shards and probe the arrays;
a fingerprint of 64 bits beyond the 64 of the slot tells strangers apart. Hot shards are copied to several tasks, probes are dealt
among the copies, and a task streams its probes past one shard at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.llm.common import documents
from trustloom.llm.words import IS_SPACE, LOWER, slices, text_bytes, window_hashes, word_hashes
from trustloom.session import staged

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 8_192
COPY_PROBES = 16_384
BUCKET_KEYS = 4
NO_ID = -(1 << 63)


def line_table(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every line of a batch: its bytes (``first``, ``last``), text (``doc``), hashes of its key (``h1``, ``h2``) and whether the
    key has at least ``MIN_CHARS`` code points (``long``)."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    doc_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    first = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(n), doc_of_break]), kind="stable")
    last = np.empty(len(first), dtype=np.int64)
    last[:-1] = first[1:] - (doc[1:] == doc[:-1])
    if n:
        last[-1] = offsets[-1]
    solid = np.flatnonzero(~IS_SPACE[data]) if len(data) else np.zeros(0, np.int64)
    head = np.searchsorted(solid, first)
    tail = np.searchsorted(solid, last) - 1
    some = head <= tail
    start, stop = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    start[some], stop[some] = solid[head[some]], solid[tail[some]] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = chars[stop] - chars[start]
    long = points >= MIN_CHARS
    h1 = np.zeros(len(first), dtype=np.uint64)
    h1[long] = word_hashes(data, start[long], stop[long], LOWER)
    return {"first": first, "last": last, "doc": doc, "long": long, "start": start, "stop": stop, "h1": h1}


def second_hashes(data: np.ndarray, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of the keys, from other values per byte."""
    shuffled = ((LOWER.astype(np.uint16) * 167 + 13) % 256).astype(np.uint8)
    h = word_hashes(data, table["start"][rows], table["stop"][rows], shuffled)
    return window_hashes(h, 1, salt=2)


def doc_lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The distinct keys per document: ``h1, h2, id, mark``; ``mark`` tells documents of one id apart."""
    schema = "h1 bigint, h2 bigint, id bigint, mark bigint"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                table = line_table(data, offsets)
                rows = np.flatnonzero(table["long"])
                h1, h2, doc = table["h1"][rows], second_hashes(data, table, rows), table["doc"][rows]
                order = np.lexsort((h2, h1, doc))
                h1, h2, doc = h1[order], h2[order], doc[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])
                take = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)), part.column("id").take(take), part.column("mark").take(take)],
                    ["h1", "h2", "id", "mark"])
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"),
                       F.col(text).alias("text")).mapInArrow(hashed, schema)


def _slots(h1: np.ndarray, h2: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    mix = (h1 ^ (seeds * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) + h2
    mix ^= mix >> np.uint64(29)
    return ((mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def _bucket(h1: np.ndarray, n: int) -> np.ndarray:
    return ((h1 * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)) % np.uint64(max(1, n // BUCKET_KEYS))


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A seed per bucket of keys so that all keys get different slots in 0..n-1; large buckets choose first.

    A seed above 2**31 is a slot itself: the place of a bucket of one key, given out last.
    """
    n = len(h1)
    bucket = _bucket(h1, n).astype(np.int64)
    seeds = np.zeros(max(1, n // BUCKET_KEYS), dtype=np.uint32)
    free = np.ones(n, dtype=bool)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(seeds))
    begins = np.cumsum(sizes) - sizes
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size <= 1:
            break
        keys = order[begins[b]:begins[b] + size]
        at = np.uint64(0)
        while True:
            slots = _slots(h1[keys][None, :], h2[keys][None, :], (tries + at)[:, None], n).astype(np.int64)
            good = free[slots].all(axis=1)
            if size > 1:
                ranked = np.sort(slots, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                seeds[b] = at + tries[hit[0]]
                free[slots[hit[0]]] = False
                break
            at += np.uint64(64)
            if at >= 1 << 30:
                raise ValueError("no seed found: keys must be distinct")
    alone = np.flatnonzero(sizes == 1)
    seeds[alone] = np.flatnonzero(free)[:len(alone)] + (1 << 31)
    return seeds


def slots_of(h1: np.ndarray, h2: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot each key has, or a stranger would have."""
    seed = seeds[_bucket(h1, n).astype(np.int64)]
    direct = seed >= (1 << 31)
    slots = _slots(h1, h2, seed.astype(np.uint64), n).astype(np.int64)
    return np.where(direct, seed.astype(np.int64) - (1 << 31), slots)


def line_index(lines: DataFrame, min_docs: int, shard_keys: int, copy_probes: int) -> tuple[DataFrame, int]:
    """One row of arrays per shard with the copies it needs, and the number of shards (from the number of frequent keys).

    A shard has a copy per ``copy_probes`` lines: those of its frequent keys, which are counted, and its part of all others.
    """
    counts = (lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("id"), F.lit(NO_ID)).alias("top"))
              .filter(F.col("n") >= min_docs))
    counts = staged(counts, "frequent")
    total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    shards = max(1, -(-total[0] // shard_keys))
    others = (lines.count() - (total[1] or 0)) / shards

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = keys["h1"].to_numpy().view(np.uint64), keys["h2"].to_numpy().view(np.uint64)
        seeds = perfect_hash(h1, h2)
        slot = slots_of(h1, h2, seeds, len(h1))
        prints, top, n = np.empty(len(h1), np.uint64), np.empty(len(h1), np.int64), np.empty(len(h1), np.uint32)
        prints[slot], top[slot], n[slot] = h2, keys["top"].to_numpy(), np.minimum(keys["n"].to_numpy(), 2**32 - 1)
        return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "seeds": [seeds.tobytes()], "prints": [prints.tobytes()],
                             "counts": [n.tobytes()], "tops": [top.tobytes()],
                             "copies": [max(1, -int(-(keys["n"].sum() + others) // copy_probes))]})
    sharded = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)))
    return staged(sharded.groupBy("shard").applyInPandas(
        build, "shard bigint, seeds binary, prints binary, counts binary, tops binary, copies bigint"), "shards"), shards


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, copy_probes: int = COPY_PROBES) -> DataFrame:
    """The probes ``h1, id, mark`` that hit a frequent key whose largest id is another one."""
    lines = staged(lines, "lines")  # hashed once, read for the counts, their total and the probes
    index, shards = line_index(lines, min_docs, shard_keys, copy_probes)
    lines = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)))
    # One short row per SHARD_KEYS frequent keys is broadcast.
    probes = lines.join(F.broadcast(index.select("shard", "copies")), "shard").select(
        "shard", F.pmod(F.xxhash64("id", "mark", "h2"), F.col("copies")).alias("copy"), F.lit(1).alias("part"), "h1", "h2", "id", "mark",
        *[F.lit(None).cast("binary").alias(c) for c in ("seeds", "prints", "tops")])
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("part"),
                          *[F.lit(None).cast("bigint").alias(c) for c in ("h1", "h2", "id", "mark")], "seeds", "prints", "tops")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seeds, prints, tops = None, None, np.zeros(0, np.uint64), None
        for batch in batches:
            place, part = batch.column("shard").to_numpy(), batch.column("part").to_numpy()
            heads = np.flatnonzero(part == 0)
            borders = np.unique(np.concatenate([[0], heads, np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]]))
            found = []
            for a, b in zip(borders[:-1], borders[1:]):
                if part[a] == 0:
                    shard = place[a]
                    seeds, prints, tops = (np.frombuffer(batch.column(c)[int(a)].as_py(), t) for c, t in
                                           (("seeds", np.uint32), ("prints", np.uint64), ("tops", np.int64)))
                    a += 1
                if a >= b or place[a] != shard:
                    continue
                h1 = batch.column("h1").slice(a, b - a).to_numpy().view(np.uint64)
                h2 = batch.column("h2").slice(a, b - a).to_numpy().view(np.uint64)
                own = batch.column("id").slice(a, b - a).fill_null(NO_ID).to_numpy()
                slot = slots_of(h1, h2, seeds, len(prints))
                found.append(np.flatnonzero((prints[slot] == h2) & (tops[slot] != own)) + a)
            hits = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(hits) for c in ("h1", "id", "mark")], ["h1", "id", "mark"])
    return (arrays.unionByName(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "part")
            .mapInArrow(probe, "h1 bigint, id bigint, mark bigint"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: ``doc`` (all columns), ``kept_text``, ``n_lines``, ``n_dropped``.

    A line whose key (stripped, A-Z in lower case, at least 20 code points) is in at least ``min_docs`` rows stays only in rows
    that have the largest id holding it. Null or empty texts are one empty line. A null id is smaller than any other; rows that
    repeat an id are rows of their own when counted and keep or lose a line together. Order and other lines stay. Empty tables
    give no rows; texts of any length are worked through line by line, and columns travel in ``doc``.
    """
    lines = doc_lines(docs, text, doc_id)
    drops = (frequent_lines(lines, min_docs).groupBy("id", "mark").agg(F.collect_set("h1").alias("drops")))
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"))
    joined = (rows.alias("l").join(drops.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.mark") == F.col("r.mark")), "left")
              .select("l.doc", "l.text", "r.drops"))
    schema = T.StructType([joined.schema["doc"], *T.StructType.fromDDL("kept_text string, n_lines bigint, n_dropped bigint")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                table = line_table(data, offsets)
                drops = part.column("drops")
                sizes = drops.value_lengths().fill_null(0).to_numpy()
                wanted = np.repeat(np.arange(part.num_rows), sizes)
                values = drops.flatten().to_numpy().view(np.uint64)
                lost = np.zeros(len(table["doc"]), dtype=bool)
                if len(values):
                    lost[table["long"]] = _pairs_in(table["doc"][table["long"]], table["h1"][table["long"]], wanted, values)
                n_lines = np.bincount(table["doc"], minlength=part.num_rows)
                n_lost = np.bincount(table["doc"][lost], minlength=part.num_rows)
                texts = part.column("text").fill_null("").to_pylist()
                raw = data.tobytes()
                begins = np.searchsorted(table["doc"], np.arange(part.num_rows + 1))
                for i in np.flatnonzero(n_lost):
                    keep = np.flatnonzero(~lost[begins[i]:begins[i + 1]]) + begins[i]
                    texts[i] = b"\n".join(raw[table["first"][k]:table["last"][k]] for k in keep).decode()
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(texts, pa.string()), pa.array(n_lines), pa.array(n_lost)],
                                                 ["doc", "kept_text", "n_lines", "n_dropped"])
    return joined.mapInArrow(cut, schema)


def _pairs_in(doc: np.ndarray, h: np.ndarray, wanted_doc: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each pair (doc, h) whether it is among the wanted pairs."""
    pairs = np.empty(len(doc) + len(wanted), dtype=[("d", np.int64), ("h", np.uint64)])
    pairs["d"], pairs["h"] = np.concatenate([doc, wanted_doc]), np.concatenate([h, wanted])
    _, inverse = np.unique(pairs, return_inverse=True)
    hit = np.zeros(inverse.max() + 1, dtype=bool)
    hit[inverse[len(doc):]] = True
    return hit[inverse[:len(doc)]]


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT d.doc_id, d.pos, d.line, coalesce(f.top <> d.doc_id, false) AS lost FROM keyed d LEFT JOIN frequent f ON d.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {"op2_line_dedup": OP2_SQL}
