"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Components become integers; a vector is a sparse row of (dimension, weight) terms. Candidates are dealt into parts by a hash, queries
into groups, and a task streams the blocks of one part past one group. A block is inverted into postings per dimension; every
term of a query scatters its weighted postings into a dense array of scores (postings of most rows of a block are kept as whole
arrays and added at once). The best k of a block are selected by partition and merged with those found so far; the last merge
ranks what the parts found of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
BLOCK_VALUES = 1 << 19
BLOCK_ROWS = 8_192
PART_ROWS = 1 << 16
GROUP_QUERIES = 4_096
LARGEST = (1 << 31) - 1
NO_ID = np.iinfo(np.int64).max


def whole_components(vector: str, scale: int, largest: int) -> Column:
    """``floor(scale * x)`` of every component, held within plus and minus ``largest``."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-largest), F.least(F.lit(largest), F.floor(
        F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.lit(float(scale)) * x.cast("double")))))).cast("int"))


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))


class Block:
    """Candidates of one block in the order of their ids (null last) and their postings per dimension."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((ids, none))
        self.ids, self.none, n = ids[order], none[order], len(ids)
        self.known = n - int(none.sum())
        rows = np.empty(n, np.int64)
        rows[order] = np.arange(n)
        rows = np.repeat(rows, sizes)
        begins = np.cumsum(sizes) - sizes
        dims = np.arange(len(values)) - np.repeat(begins, sizes)
        table = np.zeros((int(sizes.max(initial=0)), n), dtype=np.int64)
        table[dims, rows] = values
        self.largest = int(np.abs(values).max(initial=0))
        self.postings: list[tuple[np.ndarray | None, np.ndarray]] = []
        for column in table:
            held = np.flatnonzero(column)
            self.postings.append((None, column) if 2 * len(held) > n else (held, column[held]))

    def scores(self, dims: np.ndarray, weights: np.ndarray, narrow: bool) -> np.ndarray:
        """The score of every row for one query, its terms one after the other."""
        kind = np.int32 if narrow else np.int64
        out, step = np.zeros(len(self.ids), kind), np.empty(len(self.ids), kind)
        for d, w in zip(dims.tolist(), weights.tolist()):
            if d >= len(self.postings):
                break
            rows, values = self.postings[d]
            if rows is None:
                np.multiply(values, kind(w), out=step)
                out += step
            elif len(rows):
                out[rows] += values * kind(w)
        return out

    def narrowed(self, narrow: bool) -> None:
        kind = np.int32 if narrow else np.int64
        self.postings = [(rows, values.astype(kind, copy=False)) for rows, values in self.postings]


def best_rows(scores: np.ndarray, least: int | None, k: int, skip: tuple[int, int]) -> np.ndarray:
    """Positions of the ``k`` highest scores of at least ``least`` outside the range ``skip``; ties go to lower positions."""
    found = np.arange(len(scores)) if least is None else np.flatnonzero(scores >= least)
    if skip[0] < skip[1]:
        found = found[(found < skip[0]) | (found >= skip[1])]
    if len(found) <= k:
        return found
    own = scores[found]
    limit = np.partition(own, len(own) - k)[len(own) - k]
    above, equal = found[own > limit], found[own == limit]
    return np.concatenate([above, equal[:k - len(above)]])


class Ranking:
    """The best ``k`` candidates so far of every query of a group."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, values: np.ndarray, sizes: np.ndarray, k: int) -> None:
        self.ids, self.marks, self.k = ids, marks, k
        ends = np.cumsum(sizes)
        self.terms = []
        for a, b in zip(ends - sizes, ends):
            dims = np.flatnonzero(values[a:b])
            self.terms.append((dims, values[a:b][dims]))
        self.weight = max((int(np.abs(w).sum()) for _, w in self.terms), default=0)
        none = np.zeros(0, np.int64)
        self.best = [(none, none, np.zeros(0, bool))] * len(ids)

    def meet(self, block: Block) -> None:
        narrow = self.weight * block.largest < 1 << 31
        block.narrowed(narrow)
        known = block.ids[:block.known]
        for i, (dims, weights) in enumerate(self.terms):
            scores = block.scores(dims, weights, narrow)
            have, ids, none = self.best[i]
            skip = (int(np.searchsorted(known, self.ids[i])), int(np.searchsorted(known, self.ids[i], side="right")))
            rows = best_rows(scores, int(have[-1]) if len(have) == self.k else None, self.k, skip)
            if len(rows):
                have, ids, none = (np.concatenate(x) for x in (
                    (have, scores[rows].astype(np.int64)), (ids, block.ids[rows]), (none, block.none[rows])))
                order = np.lexsort((ids, none, -have))[:self.k]
                self.best[i] = have[order], ids[order], none[order]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(scores) for scores, _, _ in self.best]
        score, ids, none = (np.concatenate(x) if len(sizes) else np.zeros(0, np.int64) for x in (zip(*self.best) if sizes else [()] * 3))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, sizes)), pa.array(np.repeat(self.marks, sizes)),
             pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(score)], ["query_id", "mark", "vec_id", "score"])


def exact_topk(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, vector: str = "embedding", vec_id: str = "vec_id",
               part_rows: int = PART_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """For every query row the ``k`` rows of highest integer inner product: ``query_id, rank, vec_id, score``.

    ``is_query`` tells which rows are queries; all rows are candidates but those with the query's own id. Equal scores go to the
    smaller id, a null id last; a row without id is no query. Rows whose vector is null or holds null or non-finite components take
    no part. Vectors of different lengths meet over the dimensions both have; an empty one scores 0. Rows that repeat an id are
    candidates of their own; queries equal in id and vector are one query, other queries of one id have a ranking each. Components
    beyond 2**31 / ``scale`` are held there. Fewer candidates give shorter rankings, an empty table none; other columns are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(finite(vector)).select(
        F.col(vec_id).cast("bigint").alias("id"), whole_components(vector, scale, LARGEST).alias("v"), is_query.alias("q"))
    kept = kept.withColumn("mark", F.xxhash64("v"))
    asked = F.col("q") & F.col("id").isNotNull()
    n, n_queries = kept.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    groups = max(1, -(-n_queries // group_queries))
    parts = max(1, -(-n // part_rows), min(-(-spark.sparkContext.defaultParallelism // groups), -(-n // 1_024)))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = (kept.filter(asked).select("id", "mark", "v").distinct()
               .withColumn("group", F.pmod(F.xxhash64("id", "mark"), F.lit(groups)).cast("int"))
               .select(every(parts).alias("part"), "group", F.lit(0).alias("side"), "id", "mark", "v"))
    candidates = (kept.withColumn("part", F.pmod(F.xxhash64("id", "mark"), F.lit(parts)).cast("int"))
                  .select("part", every(groups).alias("group"), F.lit(1).alias("side"), "id", "mark", "v"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ranking, asked_rows, waiting = None, None, [], []

        def settle(last: bool = False) -> None:
            """Score the waiting candidates: whole blocks, at the end all."""
            nonlocal waiting, ranking
            if ranking is None and asked_rows:
                ids, marks, values, sizes = (np.concatenate(x) for x in zip(*asked_rows))
                ranking = Ranking(ids, marks, values, sizes, k)
            if not waiting:
                return
            ids, none, values, sizes = (np.concatenate(x) for x in zip(*waiting))
            rows = min(BLOCK_ROWS, max(64, BLOCK_VALUES // max(1, int(sizes.max()))))
            ends, at = np.concatenate([[0], np.cumsum(sizes)]), 0
            while at < len(ids) and (last or len(ids) - at >= rows):
                to = min(len(ids), at + rows)
                if ranking is not None:
                    ranking.meet(Block(ids[at:to], none[at:to], values[ends[at]:ends[to]], sizes[at:to]))
                at = to
            waiting = [(ids[at:], none[at:], values[ends[at]:], sizes[at:])] if at < len(ids) else []
        for batch in batches:
            key = batch.column("part").to_numpy() * groups + batch.column("group").to_numpy()
            side = batch.column("side").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if a == b:
                    continue
                if key[a] != place:
                    settle(last=True)
                    if ranking is not None:
                        yield ranking.batch()
                    place, ranking, asked_rows, waiting = key[a], None, [], []
                ids, v, mark = (batch.column(c).slice(a, b - a) for c in ("id", "v", "mark"))
                known, values, sizes = ids.fill_null(NO_ID).to_numpy(), v.flatten().to_numpy().astype(np.int64), v.value_lengths().to_numpy().astype(np.int64)
                if side[a] == 0:
                    asked_rows.append((known, mark.to_numpy(), values, sizes))
                else:
                    waiting.append((known, ids.is_null().to_numpy(zero_copy_only=False), values, sizes))
                    settle()
        settle(last=True)
        if ranking is not None:
            yield ranking.batch()
    found = (queries.unionByName(candidates).repartitionById(parts * groups, F.col("part") * groups + F.col("group"))
             .sortWithinPartitions("part", "group", "side").mapInArrow(scored, "query_id bigint, mark bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, F.col("vec_id") % 20 == 0)


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
QUERIES = {"op11_exact_topk": op11_exact_topk}
ORACLE = {"op11_exact_topk": OP11_SQL}
