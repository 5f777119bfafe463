"""Similarity join of weighted vectors: all pairs above a threshold, or the k best per query.

A vector has a sparse part (terms of a vocabulary, rarest first) and may have a dense part. Rules are dealt into blocks, queries into
groups; a task turns one block into postings per term and streams one group past it. Of a rule only the rare terms are posted: the
common rest is left out as long as its length stays below the threshold, because a pair that meets in none of the posted terms cannot
reach it. Rules that are met are kept while the sum so far plus the length of the rest can reach the threshold, and only these are
completed. With a dense part the sums start from the matrix product of the block. Every block keeps at most k rules per query, which
one window merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trustloom.functions.hof import let
from trustloom.functions.text import term_counts
from trustloom.session import staged

BLOCK_RULES = 4_096
GROUP_QUERIES = 1 << 15
QUERY_ROWS = 256
POSTINGS = 1 << 20
SLACK = 1e-9


def vocabulary(rules: DataFrame, tokens: Column, max_terms: int | None = None) -> DataFrame:
    """``term, no, df, idf`` of all terms of at least two characters, or of the ``max_terms`` most frequent ones.

    A text is counted inside its own row; only (term, counts) are shuffled, combined on the map side first. The numbers are
    unique and fixed, since the table is stored.
    """
    counted = rules.select(F.explode(term_counts(tokens)).alias("t"))
    terms = counted.groupBy("t.term").agg(F.count(F.lit(1)).alias("df"), F.sum("t.tf").alias("cf")).filter(F.length("term") >= 2)
    if max_terms is not None:
        terms = terms.orderBy(F.desc("cf"), "term").limit(max_terms)
    idf = F.ln(F.lit(1.0 + rules.count()) / (F.lit(1.0) + F.col("df"))) + 1
    return staged(terms.select("term", F.monotonically_increasing_id().alias("no"), "df", idf.alias("idf")), "vocabulary")


def text_vectors(rows: DataFrame, key: str, tokens: Column, terms: DataFrame) -> DataFrame:
    """``key, nos, weights``: TF-IDF of unit length per row, rarest terms first. Rows without a known term are left out."""
    # Words meet the vocabulary one by one and are counted by number, so only known terms are shuffled, as numbers.
    counted = (rows.select(key, F.explode(tokens).alias("term")).join(terms, "term")
               .groupBy(key, "no", "df", "idf").agg(F.count(F.lit(1)).alias("tf")))
    weighted = counted.select(key, F.struct("df", "no", (F.col("tf") * F.col("idf")).alias("w")).alias("e"))

    def unit(entries: Column) -> Column:
        norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
        return let(norm, lambda n: F.struct(F.transform(entries, lambda e: e["no"]).alias("nos"), F.transform(entries, lambda e: e["w"] / n).alias("weights")))
    # At most one entry per term of the text. The length is bound: named in a lambda it would be computed again for every entry.
    ordered = weighted.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return ordered.select(key, let(F.col("e"), unit).alias("v")).select(key, "v.nos", "v.weights")


def dense_vectors(rows: DataFrame, key: str) -> DataFrame:
    """``key, nos, weights, vector``: no sparse part, the dense part of unit length (``vector`` column of ``rows``)."""
    return hybrid_vectors(rows.select(F.col(key), F.array().cast("array<bigint>").alias("nos"), F.array().cast("array<double>").alias("weights")),
                          rows.select(key, "vector"), key)


def hybrid_vectors(texts: DataFrame, dense: DataFrame, key: str) -> DataFrame:
    """``key, nos, weights, vector``: the text part and the dense part side by side, scaled to length 1 together."""
    both = dense.join(texts, key, "left")
    weights = F.coalesce("weights", F.array().cast("array<double>"))
    vector = F.transform("vector", lambda x: x.cast("double"))

    def unit(w: Column, v: Column) -> Column:
        squares = F.aggregate(F.concat(w, v), F.lit(0.0), lambda acc, x: acc + x * x)
        norm = let(squares, lambda q: F.when(q > 0, F.sqrt(q)).otherwise(1.0))
        return let(norm, lambda n: F.struct(F.transform(w, lambda x: x / n).alias("weights"), F.transform(v, lambda x: x / n).alias("vector")))
    rows = both.select(key, F.coalesce("nos", F.array().cast("array<bigint>")).alias("nos"), let(weights, lambda w: let(vector, lambda v: unit(w, v))).alias("u"))
    return rows.select(key, "nos", "u.weights", "u.vector")


class RuleBlock:
    """Rules of one block: postings of their rare terms, their common rest, and their dense parts."""

    def __init__(self, ids: pa.Array, nos: pa.Array, weights: pa.Array, vectors: pa.Array | None, min_score: float | None) -> None:
        self.ids, n = ids, len(ids)
        sizes = nos.value_lengths().to_numpy().astype(np.int64)
        row, no, weight = np.repeat(np.arange(n), sizes), nos.flatten().to_numpy(), weights.flatten().to_numpy()
        self.dense = None if vectors is None else stacked(vectors)
        self.bound = min_score if self.dense is None else None
        # Length of a rule's terms from each one on; the terms from which on it is below the threshold are the rest.
        squares = weight * weight
        total = np.concatenate([[0.0], np.cumsum(squares)])
        ends = np.cumsum(sizes)
        beyond = np.sqrt(np.maximum(0.0, total[ends][row] - total[:-1]))
        rest = beyond < self.bound - SLACK if self.bound else np.zeros(len(no), bool)
        self.rest = np.sqrt(np.bincount(row[rest], squares[rest], minlength=n))
        self.known, column = np.unique(no, return_inverse=True)
        order = np.argsort(column[~rest], kind="stable")
        self.rows, self.values = row[~rest][order], weight[~rest][order]
        self.starts = np.searchsorted(column[~rest][order], np.arange(len(self.known) + 1))
        self.rest_column, self.rest_value = column[rest], weight[rest]
        self.rest_starts = np.searchsorted(row[rest], np.arange(n + 1))

    def pairs(self, nos: pa.Array, weights: pa.Array, vectors: pa.Array | None, min_score: float | None, k: int | None) -> tuple[np.ndarray, ...]:
        """``query row, rule row, score`` of what a batch of queries finds in the block."""
        n, sizes = len(self.ids), nos.value_lengths().to_numpy().astype(np.int64)
        no, weight = nos.flatten().to_numpy(), weights.flatten().to_numpy()
        column = np.minimum(np.searchsorted(self.known, no), max(0, len(self.known) - 1))
        held = self.known[column] == no if len(self.known) else np.zeros(len(no), bool)
        owner, column, weight = np.repeat(np.arange(len(sizes)), sizes)[held], column[held], weight[held]
        sums = np.zeros((len(sizes), n)) if self.dense is None else np.ascontiguousarray(stacked(vectors) @ self.dense.T)
        self._add_postings(sums, owner, column, weight)
        ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
        met = (sums > 0) & (sums + self.rest >= self.bound - SLACK) if self.bound else np.ones(sums.shape, bool)
        full, out = np.zeros(len(self.known)), []
        for q in np.flatnonzero(met.any(axis=1)).tolist():
            own, w, scores, rows = column[ends[q]:ends[q + 1]], weight[ends[q]:ends[q + 1]], sums[q], np.flatnonzero(met[q])
            if self.bound:
                full[own] = w
                first, count = self.rest_starts[rows], self.rest_starts[rows + 1] - self.rest_starts[rows]
                at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
                scores[rows] += np.bincount(np.repeat(np.arange(len(rows)), count), full[self.rest_column[at]] * self.rest_value[at], minlength=len(rows))
                full[own] = 0.0
            if min_score is not None:
                rows = rows[scores[rows] >= min_score]
            if k is not None and len(rows) > k:
                # Scores that are equal but for rounding may be ordered by the caller after rounding: keep those at the border.
                least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
                rows = rows[scores[rows] >= least - 1e-6]
            out.append((np.full(len(rows), q), rows, scores[rows]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    def _add_postings(self, sums: np.ndarray, owner: np.ndarray, column: np.ndarray, weight: np.ndarray) -> None:
        """Add what the queries' terms meet in the postings, in pieces of bounded size."""
        n, cells = sums.shape[1], sums.reshape(-1)
        counts = self.starts[column + 1] - self.starts[column]
        upto = np.cumsum(counts)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + POSTINGS, "right")))
            c, q, m = column[first:last], owner[first:last], counts[first:last]
            at = np.arange(m.sum()) + np.repeat(self.starts[c] - np.cumsum(m) + m, m)
            low, high = q[0] * n, (q[-1] + 1) * n
            cells[low:high] += np.bincount(np.repeat(q * n - low, m) + self.rows[at], np.repeat(weight[first:last], m) * self.values[at], minlength=high - low)
            first = last


def stacked(vectors: pa.Array) -> np.ndarray:
    """Dense parts as a matrix; all have one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))


def similar_pairs(queries: DataFrame, rules: DataFrame, min_score: float | None, k: int | None = None,
                  block_rules: int = BLOCK_RULES, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """``query_id, rule_id, score`` of all pairs of at least ``min_score``.

    Both sides have an id, ``nos, weights`` and, both or neither, a dense ``vector``; ids are not null. With ``k`` a block keeps only rules that
    may be among the ``k`` best of a query (those within 1e-6 of the last as well), for :func:`ranked` to merge.
    """
    if min_score is None and k is None:
        raise ValueError("give min_score or k")
    if "vector" not in rules.columns and (min_score is None or min_score <= 0):
        raise ValueError("min_score must be above 0 without a dense part")
    parts = ["nos", "weights", *[c for c in ("vector",) if c in rules.columns]]
    queries, rules = staged(queries.select("query_id", *parts), "queries"), staged(rules.select("rule_id", *parts), "rules")
    cores = rules.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rules.count() // block_rules))
    n_queries = queries.count()
    groups = max(1, -(-n_queries // group_queries), min(-(-cores // blocks), -(-n_queries // QUERY_ROWS)))
    none = {"query_id": queries.schema["query_id"].dataType, "rule_id": rules.schema["rule_id"].dataType}

    def dealt(rows: DataFrame, side: int, key: str, own: Column, other: Column) -> DataFrame:
        place = (own, other) if side == 0 else (other, own)
        return rows.select(place[0].alias("block"), place[1].alias("group"), F.lit(side).alias("side"),
                           *[(F.col(c) if c == key else F.lit(None).cast(kind)).alias(c) for c, kind in none.items()], *parts)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(rules, 0, "rule_id", F.pmod(F.xxhash64("rule_id"), F.lit(blocks)).cast("int"), every(groups))
    right = dealt(queries, 1, "query_id", F.pmod(F.xxhash64("query_id", "weights"), F.lit(groups)).cast("int"), every(blocks))
    schema = StructType([queries.schema["query_id"], rules.schema["rule_id"], StructField("score", DoubleType())])
    dense = "vector" in parts

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, waiting = None, None, []
        for batch in batches:
            key = batch.column("block").to_numpy() * groups + batch.column("group").to_numpy()
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a == b:
                    continue
                if key[a] != place:
                    place, block, waiting = key[a], None, []
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    waiting.append(part)
                    continue
                if block is None:
                    if not waiting:
                        continue
                    whole = pa.Table.from_batches(waiting).combine_chunks()
                    columns = [whole.column(c).combine_chunks() for c in ("rule_id", *parts)]
                    block = RuleBlock(*columns, *[None] * (not dense), min_score)
                for at in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(at, QUERY_ROWS)
                    q, r, score = block.pairs(some.column("nos"), some.column("weights"), some.column("vector") if dense else None, min_score, k)
                    yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(q)), block.ids.take(pa.array(r)), pa.array(score)],
                                                     ["query_id", "rule_id", "score"])
    return (left.unionByName(right).repartitionById(blocks * groups, F.col("block") * groups + F.col("group"))
            .sortWithinPartitions("block", "group", "side").mapInArrow(joined, schema))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Rules per query by falling score, then id; optionally the first k only.

    A query has at most one row per rule, and with ``k`` Spark keeps the first k per task before it shuffles.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rule_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)
