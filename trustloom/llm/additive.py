"""Quality classifier: a generalised additive model with pairwise interactions.

Statistics of a text are cut into bins. Boosting goes round the features: each turn fits a tree of three leaves on one feature's bins
to the gradient and adds it, slowed down, to that feature's look-up table; then it goes round the strongest pairs in the same way
with a tree of four leaves on two features. A score is the sum of the table entries of a row's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.llm.common import documents, sample_filter
from trustloom.llm.stats import RATIOS, ratios, text_stats
from trustloom.llm.words import slices, text_bytes
from trustloom.session import staged

BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 50
RATE = 0.1
SHRINK = 1.0
TRAIN_ROWS = 20_000
ACCEPT = 0.7
SEED = 41
HELD_OUT = 2


@dataclass
class AdditiveModel:
    """Bin edges and tables; ``pairs`` holds (feature, feature, table over the pair bins)."""
    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        bins = [np.searchsorted(e, rows[:, f], side="right") for f, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], rows[:, f], side="right"), np.searchsorted(self.coarse[g], rows[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between ``bins`` groups of equal rows; equal values share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where two leaves gain most over one (bins before the cut), and the gain."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0, 0.0
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    cut = int(gains.argmax())
    return cut + 1, float(gains[cut])


def _leaves(g: np.ndarray, h: np.ndarray, splits: int) -> np.ndarray:
    """A step per bin: the best tree of up to ``splits`` cuts, greedily."""
    parts = [(0, len(g))]
    for _ in range(splits):
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        at, gain, a, b = max(cuts, key=lambda c: c[1])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _square_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A step per cell of a pair: one cut on the rows, then one on the columns of each side; and its gain."""
    best, best_gain = np.zeros_like(g), 0.0
    whole = float(_gain(g.sum(), h.sum()))
    for at in range(1, len(g)):
        step, gain = np.zeros_like(g), -whole
        for side in (slice(0, at), slice(at, len(g))):
            gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
            cut, more = _best_cut(gs, hs)
            gain += more + float(_gain(gs.sum(), hs.sum()))
            for columns in (slice(0, cut), slice(cut, g.shape[1])):
                step[side, columns] = gs[columns].sum() / (hs[columns].sum() + SHRINK)
        if gain > best_gain:
            best, best_gain = step, gain
    return best, best_gain


def fit_additive(rows: np.ndarray, good: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> AdditiveModel:
    """Cyclic boosting of the logistic loss: main tables first, then the pairs with the largest first gain."""
    share = min(max(float(good.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(rows[:, f], BINS) for f in range(rows.shape[1])]
    coarse = [_edges(rows[:, f], PAIR_BINS) for f in range(rows.shape[1])]
    bins = [np.searchsorted(e, rows[:, f], side="right") for f, e in enumerate(edges)]
    cells = [np.searchsorted(e, rows[:, f], side="right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(rows), base)
    wanted = good.astype(float)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return wanted - p, p * (1 - p)
    for _ in range(rounds):
        for f, table in enumerate(tables):
            g, h = slopes()
            step = rate * _leaves(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), 2)
            table += step
            total += step[bins[f]]

    def square(f: int, g: int) -> tuple[np.ndarray, float]:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        flat = cells[f] * shape[1] + cells[g]
        slope, curve = slopes()
        return _square_leaves(*(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (slope, curve)))
    ranked = sorted(((square(f, g)[1], f, g) for f, g in combinations(range(rows.shape[1]), 2)), reverse=True)
    pairs = [(f, g, np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for gain, f, g in ranked[:PAIRS] if gain > 0]
    for _ in range(pair_rounds):
        for f, g, table in pairs:
            step = rate * square(f, g)[0]
            table += step
            total += step[cells[f], cells[g]]
    return AdditiveModel(base, edges, coarse, tables, pairs)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not held out (and has no label)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def quality_ratios(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id`` and ``ratios`` (array over ``RATIOS``) per row."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = ratios(text_stats(*text_bytes(part.column("text"))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ratios"])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(counted, "doc_id bigint, ratios array<double>")


def learned_quality(docs: DataFrame, labels: DataFrame, stats: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id",
                    train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """The model learned from at most ``train_rows`` labelled rows, those with a low hash of their id.

    Without ``stats`` (rows of ``quality_ratios``) only the texts of drawn ids are worked through.

    Held-out ids, null ids and labels other than 0 and 1 are left out; of several labels of an id the lowest counts. Without
    labelled rows every score is one half.
    """
    marks = (labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    drawn = sample_filter(docs.select(F.col(doc_id).cast("bigint").alias("doc_id")).join(marks, "doc_id"), "doc_id", train_rows, SEED)
    if stats is None:
        some = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(drawn)
        stats = quality_ratios(some, "text", "doc_id")
    rows = (stats.filter(drawn).join(marks, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_rows)
            .select("quality", "ratios").toPandas())
    if not len(rows):
        none = [np.zeros(0)] * len(RATIOS)
        return AdditiveModel(0.0, none, none, [np.zeros(1)] * len(RATIOS), [])
    return fit_additive(np.stack(rows["ratios"].to_numpy()), rows["quality"].to_numpy() == 1)


def scored(stats: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id`` and ``score`` of rows of ``quality_ratios``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("ratios").flatten().to_numpy().reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(rows))], ["doc_id", "score"])
    return stats.mapInArrow(add, "doc_id bigint, score double")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = ACCEPT) -> DataFrame:
    """The rows with a score of at least ``least``, columns unchanged.

    A first pass over the drawn texts gives the statistics to learn from, a second one scores and filters without a shuffle. Null and
    empty texts are scored like others, repeated rows alike; extra columns travel in a struct; empty tables stay empty.
    """
    model = learned_quality(docs, labels, text=text, doc_id=doc_id)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                good = model.scores(ratios(text_stats(*text_bytes(part.column("text"))))) >= least
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(pa.array(good))], ["doc"])
    return rows.mapInArrow(choose, T.StructType([rows.schema["doc"]])).select("doc.*")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; see ``accepted`` and ``learned_quality`` for odd rows."""
    stats = staged(quality_ratios(docs, text, doc_id), "quality")
    rows = scored(stats, learned_quality(docs, labels, stats, text, doc_id))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op10_quality_scores(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_quality_scores": op10_quality_scores}
ORACLE: dict[str, str] = {}
