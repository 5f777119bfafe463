"""Quality rules: an isolation forest on rule statistics beside the fixed rules.

Trees split a small random sample at random values until rows stand alone; rows that stand alone after few splits are anomalous.
Statistics are shares on a logarithmic scale, so that rare values far from the others do not take all splits. The threshold on the
anomaly score is calibrated on the labelled rows: the one that tells good and bad rows apart best among those that reject at
most ``MOST_GOOD_LOST`` of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustloom.llm.common import documents, sample_filter
from trustloom.llm.stats import RATIOS, ratios, text_stats
from trustloom.llm.words import slices, text_bytes
from trustloom.session import staged

TREES = 200
SUBSAMPLE = 256
MODEL_ROWS = 20_000
BINS = 1 << 14
MOST_GOOD_LOST = 0.005
LEAST_WORDS = 20
MOST_REPEATED = 30
SEED = 29
RULES = ("symbols", "word_chars", "distinct", "echo", "upper", "bangs", "bars", "short")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Forest:
    """Complete binary trees as arrays (tree, node): the feature and value of a split and the path length of a leaf."""
    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    typical: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 to the minus mean path length over the typical one."""
        total = np.zeros(len(rows))
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        at_row = np.arange(len(rows))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                f = feature[node]
                inner = f >= 0
                right = rows[at_row, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return np.power(2.0, -total / len(self.feature) / self.typical)


def _unsplit(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length that ``n`` rows would still need."""
    n = np.maximum(n, 1.0)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1.0)) + 0.5772156649) - 2 * (n - 1) / n, 0.0)


def grow_forest(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """A forest over ``rows``; features and split values are drawn uniformly."""
    draw = np.random.Generator(np.random.PCG64(seed))
    size = min(subsample, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    feature, value, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: rows[draw.choice(len(rows), size, replace=False)]}
        for node in range(nodes):
            some = held.pop(node, None)
            if some is None:
                continue
            level = int(np.log2(node + 1))
            low, high = some.min(axis=0), some.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if level == depth or len(some) <= 1 or not len(open_features):
                length[t, node] = level + float(_unsplit(len(some)))
                continue
            f = int(draw.choice(open_features))
            feature[t, node], value[t, node] = f, draw.uniform(low[f], high[f])
            right = some[:, f] >= value[t, node]
            held[2 * node + 1], held[2 * node + 2] = some[~right], some[right]
            for child in (2 * node + 1, 2 * node + 2):
                if not len(held[child]):
                    length[t, child] = level + 1
                    del held[child]
    return Forest(feature, value, length, float(_unsplit(float(size))))


def calibrated(scored: DataFrame, most_lost: float = MOST_GOOD_LOST) -> float:
    """The score from which rows are anomalous: best true minus false rejections with at most ``most_lost`` of the good rejected.

    ``scored`` has ``anomaly`` (0 to 1) and ``good``, all rows count. The driver sees sums of ``BINS`` ranges of scores; within a
    range the sums go on over the distinct scores.
    """
    counts = staged(scored.groupBy("anomaly").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
                    .withColumn("bin", F.floor(F.col("anomaly") * BINS).cast("int")), "scores")
    bins = counts.groupBy("bin").agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")).toPandas().sort_values("bin", ascending=False)
    n_good, n_bad = int(bins["good"].sum()), int(bins["bad"].sum())
    if not n_good or not n_bad:
        return np.inf
    above = bins.assign(good=bins["good"].cumsum() - bins["good"], bad=bins["bad"].cumsum() - bins["bad"])
    higher = scored.sparkSession.createDataFrame(above, "bin int, good bigint, bad bigint")
    upto = Window.partitionBy("bin").orderBy(F.desc("anomaly")).rowsBetween(Window.unboundedPreceding, 0)
    rejected = counts.join(F.broadcast(higher), "bin").select(
        "anomaly", ((F.col("good") + F.sum("n_good").over(upto)) / F.lit(float(n_good))).alias("lost"),
        ((F.col("bad") + F.sum("n_bad").over(upto)) / F.lit(float(n_bad))).alias("caught"))
    best = (rejected.filter(F.col("lost") <= most_lost)
            .agg(F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), "anomaly")).alias("best")).first()["best"])
    if best is None or best["gain"] <= 0:
        return np.inf
    lower = counts.filter(F.col("anomaly") < best["anomaly"]).agg(F.max("anomaly")).first()[0]
    return best["anomaly"] if lower is None else (best["anomaly"] + lower) / 2


def rule_ratios(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The shares that the forest looks at."""
    return np.log1p(20 * ratios(stats)[:, [RATIOS.index(c) for c in RULES]])


def rule_stats(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id``, the counts of ``BASE`` and ``ratios`` (array over ``RULES``) per row; null text has no words."""
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", ratios array<double>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                stats = text_stats(*text_bytes(part.column("text")))
                rows = rule_ratios(stats)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(stats[c].astype(np.int64)) for c in BASE), lists],
                                                 ["doc_id", *BASE, "ratios"])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(counted, schema)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", model_rows: int = MODEL_ROWS) -> DataFrame:
    """``doc_id``, the counts of ``BASE``, ``base_failed``, ``anomaly`` and ``kept`` per row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1); other values and null ids are left out, of several labels of an id the lowest
    counts. The forest grows on at most ``model_rows`` labelled rows that pass the base rules, the ones with the lowest hash of
    their id; the threshold is calibrated on all of them. Without labels of both kinds only the base rules reject. Null and empty texts fail the base rules,
    long texts are counted whole, repeated rows get equal verdicts, empty tables give no rows; other columns are not read.
    """
    stats = staged(rule_stats(docs, text, doc_id).withColumn("base_failed", base_failed()), "rules")
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passing = stats.filter("not base_failed")
    drawn = sample_filter(passing.select("doc_id").join(marks, "doc_id"), "doc_id", model_rows, SEED)
    rows = (passing.filter(drawn).join(marks, "doc_id").select("doc_id", "ratios")
            .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(model_rows).toPandas())
    forest, limit = None, np.inf
    fields = stats.schema.names

    def anomalies(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("ratios").flatten().to_numpy()
        return forest.scores(flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)) if forest else np.zeros(batch.num_rows)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anomalies(batch)), batch.column("good")], ["anomaly", "good"])
    if len(rows):
        forest = grow_forest(np.stack(rows["ratios"].to_numpy()))
        labelled = passing.join(marks, "doc_id").select("ratios", (F.col("quality") == 1).alias("good"))
        limit = calibrated(labelled.mapInArrow(marked, "anomaly double, good boolean"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anomaly = anomalies(batch)
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (anomaly < limit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields if c != "ratios"), pa.array(anomaly), pa.array(kept)],
                                             [*(c for c in fields if c != "ratios"), "anomaly", "kept"])
    return stats.mapInArrow(judged, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name != "ratios")
                            + ", anomaly double, kept boolean")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents(spark, sf_dir), labels).select("doc_id", *BASE, "base_failed", "kept", "anomaly")


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE: dict[str, str] = {}
