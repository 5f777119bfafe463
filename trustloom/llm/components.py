"""Connected components of links by alternating stars, with written tables between the rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.session import staged

LOCAL_LINKS = 1 << 20


def forest_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the links with the smallest node it reaches over them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(before, root):
            return nodes, nodes[root]


def _contracted(links: DataFrame) -> DataFrame:
    """Links of one task replaced by stars over what they connect, at most ``LOCAL_LINKS`` at a time."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
            nodes, roots = forest_roots(a, b)
            inner = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(roots[inner]), pa.array(nodes[inner])], ["a", "b"])
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= LOCAL_LINKS:
                yield flushed()
                held = []
        if held:
            yield flushed()
    return links.mapInArrow(stars, "a bigint, b bigint")


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reached) for every node of ``links`` (``a``, ``b``, not null).

    Each task first contracts its own links. Then a large star links all larger neighbours of a node to the smallest node next to
    it, a small star does so with the smaller ones, until a round changes nothing. Smallest neighbours are partial minima and
    every link meets one row of them, so a node with very many links is never gathered.
    """
    edges = staged(_contracted(links.select("a", "b")), purpose)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        large = staged(large, purpose)
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("m"), "a", "b")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        fresh = staged(_contracted(small.select("e.*").filter("a < b").distinct()), purpose)
        # Done when no node is both a root and below another one.
        inner = fresh.select(F.col("b").alias("n")).groupBy("n").count()
        roots = fresh.select(F.col("a").alias("n")).distinct()
        if inner.filter("count > 1").isEmpty() and roots.join(inner, "n", "left_semi").isEmpty():
            return fresh.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                roots.select(F.col("n").alias("node"), F.col("n").alias("component")))
        edges = fresh
