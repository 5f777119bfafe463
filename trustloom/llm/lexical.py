"""Ranked lexical search with bit-sliced Bloom signatures.

Documents of similar length stand together in blocks. A block has a Bloom signature per document, stored by bit: a slice holds one bit
of all its documents, so the documents that may hold a term are the conjunction of a few slices. Terms found 2, 4, 8, ... times enter
once more per level, so the slices also bound how often a term occurs. Weighted sums of these bitmaps are upper bounds of the scores,
since a filter has no false negatives. The exact scores of the documents with the highest bounds give each item a threshold; every
document whose bound reaches it is scored exactly from its whole text, so no result depends on a filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import documents
from trustloom.llm.lines import second_hashes
from trustloom.llm.words import LOWER, mixed, slices, text_bytes, word_bounds, word_hashes
from trustloom.session import staged

K = 10
PROBES = 4
BITS_PER_ENTRY = 12
LEVELS = 13
LEAST_CLASS = 4
BLOCK_CELLS = 1 << 24
BLOCK_ROWS = 2_048
SEEDS = 32
GROUP_CHARS = 4 << 20
LOCAL_KEYS = 200_000
BREAKS = np.ones(256, dtype=bool)
BREAKS[0x30:0x3A] = BREAKS[0x41:0x5B] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False
LEVEL_STEP = 0x9E3779B97F4A7C15


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of all terms of a batch of texts, the text each is in, and what second hashes are made from."""
    data, offsets = text_bytes(column)
    first, last, borders = word_bounds(data, offsets, BREAKS)
    return word_hashes(data, first, last, LOWER), np.repeat(np.arange(len(column)), np.diff(borders)), (data, first, last)


class Asked:
    """The items of a search: their distinct terms (two hashes, in order of the first) and which terms each has."""

    def __init__(self, item_ids: Sequence[int | None], texts: Sequence[str | None]) -> None:
        h1, item, (data, first, last) = terms_of(pa.array(texts, pa.string()))
        h2 = second_hashes(data, {"start": first, "stop": last}, np.arange(len(h1)))
        pairs = np.stack([h1, h2], axis=1)
        self.keys, term = np.unique(pairs, axis=0, return_inverse=True) if len(h1) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
        self.h1, self.h2 = np.ascontiguousarray(self.keys[:, 0]), np.ascontiguousarray(self.keys[:, 1])
        self.ids = list(item_ids)
        self.terms = [np.unique(term.ravel()[item == i]) for i in range(len(self.ids))]
        self.weights = self.n_docs = self.n_terms = None

    def weigh(self, df: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)

    def found(self, h1: np.ndarray, source: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``rows`` (in text order; ``h1`` are their hashes) are asked terms, and which terms."""
        place = np.minimum(np.searchsorted(self.h1, h1), max(0, len(self.h1) - 1))
        hits = np.flatnonzero(self.h1[place] == h1) if len(self.h1) else np.zeros(0, np.int64)
        data, first, last = source
        h2 = second_hashes(data, {"start": first, "stop": last}, rows[hits])
        same = self.h2[place[hits]] == h2
        return hits[same], place[hits[same]]

    def dampers(self, lengths: np.ndarray) -> np.ndarray:
        return np.array([10 + 90 * n * self.n_docs // self.n_terms for n in lengths.tolist()], dtype=np.int64)


def impact(tf: np.ndarray, damper: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * damper)


def positions(h: np.ndarray, width: int) -> np.ndarray:
    """The bits of every entry in a signature of ``width`` bits."""
    draws = [mixed(h + np.uint64(j * 0xC2B2AE3D27D4EB4F % (1 << 64))) >> np.uint64(32) for j in range(1, PROBES + 1)]
    return np.stack([(d * np.uint64(width) >> np.uint64(32)).astype(np.int64) for d in draws], axis=1)


def entries_of(h: np.ndarray, tf: np.ndarray, level: int) -> np.ndarray:
    """The entries of terms that occur at least ``2**level`` times."""
    return h[tf >= 1 << level] + np.uint64(level * LEVEL_STEP % (1 << 64))


class Pending:
    """Documents of one length class that wait for their block."""

    def __init__(self, size_class: int) -> None:
        self.width = BITS_PER_ENTRY << size_class
        self.rows = max(8, min(BLOCK_ROWS, BLOCK_CELLS // self.width) // 8 * 8)
        self.docs: list[tuple] = []

    def block(self) -> dict:
        rows = -(-len(self.docs) // 8) * 8
        table = np.zeros((self.width, rows), dtype=np.uint8)
        for i, (_, _, _, entries) in enumerate(self.docs):
            table[positions(entries, self.width).ravel(), i] = 1
        ids, marks, lengths, _ = zip(*self.docs)
        out = {"width": self.width, "ids": list(ids), "marks": list(marks), "lengths": list(lengths), "slices": np.packbits(table, axis=1).tobytes()}
        self.docs = []
        return out


BLOCKS = "width int, ids array<bigint>, marks array<bigint>, lengths array<bigint>, slices binary, term int, n bigint, kind string"
_ARROW = pa.schema([("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                    ("slices", pa.binary()), ("term", pa.int32()), ("n", pa.int64()), ("kind", pa.string())])


def signature_index(docs: DataFrame, asked: Asked) -> DataFrame:
    """Blocks of signatures (``kind`` block) and, counted on the way, the documents per asked term (``kind`` count; term -1: documents
    with a term, term -2: all terms). ``docs`` has ``id, mark, text``; texts without a term are in no block."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, Pending] = {}
        df, n_docs, n_terms = np.zeros(len(asked.h1), np.int64), 0, 0

        def row(**values) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": "block", **values}], schema=_ARROW)
        for batch in batches:
            for part in slices(batch, "text"):
                h, doc, source = terms_of(part.column("text"))
                lengths = np.bincount(doc, minlength=part.num_rows)
                n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + len(h)
                order = np.lexsort((h, doc))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])  # doc is in order already
                heads = np.flatnonzero(new)
                tf = np.diff(np.concatenate([heads, [len(order)]]))
                h_one, doc_one = h[order[heads]], doc[heads]
                seen = np.sort(order[heads])
                _, term = asked.found(h[seen], source, seen)
                df += np.bincount(term, minlength=len(df))
                ends = np.searchsorted(doc_one, np.arange(part.num_rows + 1))
                ids, marks = part.column("id").to_pylist(), part.column("mark").to_pylist()
                for i in np.flatnonzero(lengths).tolist():
                    own, often = h_one[ends[i]:ends[i + 1]], tf[ends[i]:ends[i + 1]]
                    entries = np.concatenate([entries_of(own, often, k) for k in range(min(LEVELS, int(often.max()).bit_length()))])
                    size_class = max(LEAST_CLASS, int(len(entries) - 1).bit_length())
                    place = pending.setdefault(size_class, Pending(size_class))
                    place.docs.append((ids[i], marks[i], int(lengths[i]), entries))
                    if len(place.docs) == place.rows:
                        yield row(**place.block())
        for place in pending.values():
            if place.docs:
                yield row(**place.block())
        counted = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist(
            [{"term": t, "n": n, "kind": "count"} for t, n in [(-1, n_docs), (-2, n_terms), *zip(counted.tolist(), df[counted].tolist())]], schema=_ARROW)
    return staged(docs.mapInArrow(signed, BLOCKS), "signatures", "kind")


def bounds(width: int, lengths: np.ndarray, packed: bytes, asked: Asked) -> np.ndarray:
    """Upper bounds of the scores per item and document of a block."""
    rows = -(-len(lengths) // 8) * 8
    bits = np.frombuffer(packed, dtype=np.uint8).reshape(width, rows // 8)
    lengths = np.concatenate([lengths, np.ones(rows - len(lengths), np.int64)])
    damper = asked.dampers(lengths)
    out = np.zeros((len(asked.terms), rows))
    live, may, below = np.arange(len(asked.h1)), None, np.zeros(rows)
    for level in range(LEVELS):
        held = np.bitwise_and.reduce(bits[positions(asked.h1[live] + np.uint64(level * LEVEL_STEP % (1 << 64)), width)], axis=1)
        may = held if may is None else may & held
        some = may.any(axis=1)
        live, may = live[some], may[some]
        if not len(live):
            break
        most = lengths if level == LEVELS - 1 else np.minimum(lengths, (2 << level) - 1)
        reach = impact(most, damper).astype(np.float64)
        table, weights = np.unpackbits(may, axis=1), asked.weights[live].astype(np.float64)
        place = np.full(len(asked.h1), -1)
        place[live] = np.arange(len(live))
        for i, terms in enumerate(asked.terms):
            own = place[terms]
            own = own[own >= 0]
            if len(own):
                out[i] += (reach - below) * (weights[own] @ table[own])
        below = reach
    return out


FOUND = "item int, id bigint, mark bigint, bound double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    item, ids, marks, bound = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(bound, pa.float64())],
                                      ["item", "id", "mark", "bound"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, marks, lengths = (batch.column(c)[i].as_py() for c in ("ids", "marks", "lengths"))
            yield batch.column("width")[i].as_py(), ids, marks, np.array(lengths, dtype=np.int64), batch.column("slices")[i].as_buffer()


def highest_bounds(blocks: DataFrame, asked: Asked, seeds: int) -> DataFrame:
    """The ``seeds`` documents of highest bound per item."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked.terms]
        for width, ids, marks, lengths, packed in _blocks(batches):
            table = bounds(width, lengths, packed, asked)[:, :len(ids)]
            for i, row in enumerate(table):
                least = best[i][-1][3] if len(best[i]) == seeds else 0.0
                rows = np.flatnonzero(row > least)
                if len(rows):
                    rows = rows[np.argsort(-row[rows], kind="stable")[:seeds]]
                    best[i] = sorted(best[i] + [(i, ids[r], marks[r], float(row[r])) for r in rows.tolist()], key=lambda x: -x[3])[:seeds]
        yield _found([x for own in best for x in own])
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "id", "mark")
    found = blocks.mapInArrow(probe, FOUND)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= seeds).drop("place")


def not_excluded(blocks: DataFrame, asked: Asked, least: np.ndarray) -> DataFrame:
    """All documents whose bound reaches the item's threshold."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, marks, lengths, packed in _blocks(batches):
            table = bounds(width, lengths, packed, asked)[:, :len(ids)]
            items, rows = np.nonzero((table >= least[:, None]) & (table > 0))
            yield _found([(i, ids[r], marks[r], float(table[i, r])) for i, r in zip(items.tolist(), rows.tolist())])
    return blocks.mapInArrow(probe, FOUND)


def exact_scores(docs: DataFrame, found: DataFrame, asked: Asked) -> DataFrame:
    """``item, doc_id, score`` of the found pairs, from whole texts; scores of 0 are left out."""
    keys = staged(found.groupBy("id", "mark").agg(F.collect_set("item").alias("items")), "found")  # a set has at most the items of a group
    side = F.broadcast(keys) if keys.count() <= LOCAL_KEYS else keys
    rows = docs.alias("d").join(side.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.mark") == F.col("k.mark"))).select("d.id", "d.text", "k.items")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, doc, source = terms_of(part.column("text"))
                hits, term = asked.found(h, source, np.arange(len(h)))
                n_asked = len(asked.h1)
                cells, tf = np.unique(doc[hits] * n_asked + term, return_counts=True)
                damper = asked.dampers(np.bincount(doc, minlength=part.num_rows))
                wanted, sizes = part.column("items").flatten().to_numpy(), part.column("items").value_lengths().to_numpy()
                of = np.repeat(np.arange(part.num_rows), sizes)
                scores = np.zeros(len(wanted), np.int64)
                for j, (d, i) in enumerate(zip(of.tolist(), wanted.tolist())):
                    terms = asked.terms[i]
                    at = np.minimum(np.searchsorted(cells, d * n_asked + terms), len(cells) - 1)
                    held = cells[at] == d * n_asked + terms if len(cells) else np.zeros(len(terms), bool)
                    if held.any():
                        scores[j] = int((asked.weights[terms[held]] * impact(tf[at[held]], damper[d])).sum())
                some = np.flatnonzero(scores > 0)
                yield pa.RecordBatch.from_arrays([pa.array(wanted[some], pa.int32()), part.column("id").take(pa.array(of[some])), pa.array(scores[some])],
                                                 ["item", "doc_id", "score"])
    return rows.mapInArrow(scored, "item int, doc_id bigint, score bigint")


def best_scores(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id", seeds: int = SEEDS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The ``k`` documents of highest score above 0 per item: ``item_id, rank, doc_id, score``.

    Terms are runs of letters A-Z, a-z, digits and non-ASCII characters, A-Z lower-cased; a null or empty text has none, and items
    without terms have no rows. Equal scores go to the smaller id, a null id last. Rows of ``docs`` that repeat an id or another row
    are documents of their own; items equal in id and text are one item, other items of one id have a ranking each. Texts of any
    length are read whole; other columns are not read. An empty table gives no rows. Items are searched in groups of about
    ``group_chars`` characters, so what reaches the driver and the tasks of them is bounded.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // group_chars))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for group in range(groups):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).orderBy(F.asc_nulls_first("item_id"), "text").collect()
        out = out.unionByName(_group_ranking(docs, Asked([r["item_id"] for r in own], [r["text"] for r in own]), k, seeds))
    return out


def _group_ranking(docs: DataFrame, asked: Asked, k: int, seeds: int) -> DataFrame:
    spark = docs.sparkSession
    index = signature_index(docs, asked)
    blocks = index.filter(F.col("kind") == "block").select("width", "ids", "marks", "lengths", "slices")
    counts = index.filter(F.col("kind") == "count").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per asked term
    df, total = np.zeros(len(asked.h1), np.int64), {-1: 0, -2: 0}
    for r in counts:
        if r["term"] < 0:
            total[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    asked.weigh(df, total[-1], total[-2])
    first = best_scores(exact_scores(docs, highest_bounds(blocks, asked, max(k, seeds)), asked), k)
    least = np.zeros(len(asked.terms))
    for r in first.filter(F.col("rank") == k).collect():  # a row per item at most
        least[r["item"]] = r["score"]
    scores = exact_scores(docs, not_excluded(blocks, asked, least), asked)
    ids = pa.table({"item": pa.array(range(len(asked.ids)), pa.int32()), "item_id": pa.array(asked.ids, pa.int64())})
    names = F.broadcast(spark.createDataFrame(ids, "item int, item_id bigint"))  # the items of a group
    return best_scores(scores, k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM t WHERE len(terms) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM t) GROUP BY rid, term),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM item) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, total),
d AS (SELECT rid, doc_id, 100 - 90 + (90 * len(terms) * big_n) // big_l AS m FROM t, total WHERE len(terms) > 0),
scored AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item JOIN w USING (term) JOIN tf USING (term) JOIN d USING (rid) GROUP BY item_id, rid),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLE = {"op12_ranked_search": OP12_SQL}
