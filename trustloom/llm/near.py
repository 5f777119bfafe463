"""Near-duplicate detection: banded MinHash, sequential Bayesian verification, exact confirmation.

1. Every text becomes band keys of its MinHash signature; equal word sequences are one class with one representative.
2. Representatives that share a band key with the smallest one of its bucket are joined to candidate components: star links, so
   a bucket of any size gives as many links as members.
3. Candidate components are worked through in units of one or two blocks of texts. Pairs that share a band key are compared a
   batch of signature values at a time; a pair is dropped once the posterior probability that it is similar enough falls
   below ``MISS``. What survives is confirmed on the full shingle sets, unless both texts are connected already, so a
   unit emits a forest of links and never its pairs.
4. Links give components; every document gets the smallest id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import documents, order_key
from trustloom.llm.components import components
from trustloom.llm.words import LOWER, mixed, powers, slices, text_bytes, window_hashes, word_bounds, word_hashes
from trustloom.session import staged

BAND_ROWS = 6
MISS = 1e-6
BATCH = 30
BLOCK = 256
CHUNK = 2_048
PAIR_CHUNK = 20_000
SEED = 53


@dataclass(frozen=True)
class NearRule:
    """``percent`` of the union that the intersection must reach, words per shingle, and what follows for the signature."""
    words: int
    percent: int

    @property
    def bands(self) -> int:
        """Bands for which a pair just similar enough is missed with probability ``MISS`` at most."""
        return ceil(log(MISS) / log(1 - (self.percent / 100) ** BAND_ROWS))

    def draws(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.Generator(np.random.PCG64(SEED))
        n = self.bands * BAND_ROWS
        return draw.integers(0, 1 << 32, (n, 1), dtype=np.uint32), draw.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def least_matches(self) -> list[tuple[int, int]]:
        """``(n, m)``: with fewer than m of the first n values equal, the posterior of being similar is below ``MISS``.

        With a uniform prior the posterior probability of a similarity of at least t is that of at most m hits in n + 1
        draws at t.
        """
        t, out = self.percent / 100, []
        for n in range(BATCH, self.bands * BAND_ROWS + 1, BATCH):
            below, m = 0.0, 0
            while below + (p := comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)) < MISS:
                below, m = below + p, m + 1
            out.append((n, m))
        return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashes of its words (A-Z in lower case) and of its distinct shingles, in order of hash.

    A text with fewer words has its whole sequence as one shingle; without words it has none.
    """
    data, offsets = text_bytes(column)
    first, last, borders = word_bounds(data, offsets)
    hashes = word_hashes(data, first, last, LOWER)
    windows = window_hashes(hashes, words)
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= words:
            yield hashes[a:b], np.unique(windows[a:b - words + 1])
        else:
            yield hashes[a:b], window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(flips), np.iinfo(np.uint32).max, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(low, ((x[None, at:at + CHUNK] ^ flips) * factors).min(axis=1), out=low)
    return low


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per text and band."""
    parts = signatures.reshape(len(signatures), bands, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        keys = mixed(keys + parts[:, :, k])
    return keys


def sketches(docs: DataFrame, rule: NearRule, text: str, doc_id: str) -> DataFrame:
    """``id, mark, n_shingles, s1, s2, keys`` per row: two hashes of the word sequence and the band keys (null without words)."""
    schema = "id bigint, mark bigint, n_shingles bigint, s1 bigint, s2 bigint, keys array<bigint>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = rule.draws()
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                sizes, sequence, lows = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, len(flips)), np.uint32)
                for i, (hashes, shingles) in enumerate(shingle_sets(part.column("text"), rule.words)):
                    sizes[i] = len(shingles)
                    if len(shingles):
                        up = powers(len(hashes))[0]
                        sequence[i] = (hashes * up).sum(), (mixed(hashes) * up).sum() + np.uint64(len(hashes))
                        lows[i] = signature(shingles, flips, factors)
                some = sizes > 0
                keys = band_keys(lows, rule.bands).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * rule.bands)]).astype(np.int32)), pa.array(keys[some].ravel()))
                hidden = pa.array(~some)
                s1, s2 = (pa.array(np.ascontiguousarray(sequence[:, k]).view(np.int64)) for k in (0, 1))
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("mark"), pa.array(sizes), pc.if_else(hidden, none, s1), pc.if_else(hidden, none, s2), lists],
                    ["id", "mark", "n_shingles", "s1", "s2", "keys"])
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(sketch, schema)


class UnitLinks:
    """Confirmed links within one unit of texts."""

    def __init__(self, rule: NearRule) -> None:
        self.rule, self.steps = rule, rule.least_matches()
        self.flips, self.factors = rule.draws()

    def links(self, nodes: np.ndarray, blocks: np.ndarray, texts: pa.Array) -> list[tuple[int, int]]:
        """Links that connect what the similar pairs connect; of two blocks only pairs across them are looked at."""
        _, keep = np.unique(nodes, return_index=True)
        nodes, blocks = nodes[keep], blocks[keep]
        sets = [s for _, s in shingle_sets(texts.take(pa.array(keep)), self.rule.words)]
        lows = np.stack([signature(s, self.flips, self.factors) for s in sets])
        keys = band_keys(lows, self.rule.bands)
        across = blocks.min() != blocks.max()
        left, right = [], []
        for i in range(len(nodes) - 1):
            met = (keys[i + 1:] == keys[i]).any(axis=1)
            if across:
                met &= blocks[i + 1:] != blocks[i]
            found = np.flatnonzero(met) + i + 1
            left.append(np.full(len(found), i))
            right.append(found)
        if not left:
            return []
        left, right = np.concatenate(left), np.concatenate(right)
        matches, alive = self._survivors(lows, left, right)
        left, right, matches = left[alive], right[alive], matches[alive]
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        out = []
        for k in np.argsort(-matches, kind="stable"):
            a, b = root(int(left[k])), root(int(right[k]))
            if a == b:
                continue
            x, y = sets[left[k]], sets[right[k]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= self.rule.percent * (len(x) + len(y) - common):
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[left[k]]), int(nodes[right[k]])))
        return out

    def _survivors(self, lows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal values of each pair and which pairs are still possible after all batches."""
        matches, alive = np.zeros(len(left), np.int64), np.ones(len(left), dtype=bool)
        for at in range(0, len(left), PAIR_CHUNK):
            rows = np.arange(at, min(len(left), at + PAIR_CHUNK))
            done = 0
            for n, least in self.steps:
                matches[rows] += (lows[left[rows], done:n] == lows[right[rows], done:n]).sum(axis=1)
                done = n
                lost = matches[rows] < least
                alive[rows[lost]] = False
                rows = rows[~lost]
        return matches, alive


def confirmed_links(units: DataFrame, rule: NearRule) -> DataFrame:
    """Links ``a, b`` of all units (``component, i, j, block, node, text``), one unit in memory at a time."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = UnitLinks(rule)
        held: list[pa.RecordBatch] = []

        def finished() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            pairs = work.links(table["node"].to_numpy(), table["block"].to_numpy(), table["text"].combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])
        current = None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("component", "i", "j")])
            borders = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *borders], [*borders, batch.num_rows]):
                if a == b:
                    continue
                if held and tuple(place[:, a]) != current:
                    yield finished()
                    held = []
                current = tuple(place[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield finished()
    return (units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(confirm, "a bigint, b bigint"))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, mark, n_shingles, component_id, kept`` per row of ``docs``; ``mark`` is xxhash64 of the text.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case; texts are linked if their sets of shingles of ``words`` words
    overlap by ``percent`` of the union. A text with fewer words has its sequence as one shingle; null, empty and blank texts
    have none and are linked with nothing. ``component_id`` is the smallest id reachable (null ids come last) and exactly one row of a
    component is ``kept``. Rows that repeat a text are one class; other columns are not read; empty tables give no rows.
    A pair just similar enough that no third text connects is missed with a probability of about ``MISS`` per stage.
    """
    rule = NearRule(words, percent)
    rows = staged(sketches(docs, rule, text, doc_id).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    classes = rows.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rep"))
    heads = rows.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    banded = heads.select("rid", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rid").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = banded.join(buckets, "key").filter("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    groups = staged(components(stars, "candidates"), "candidates")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.when(F.col("n") <= 2 * BLOCK, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(BLOCK))).cast("int")
    members = (groups.join(sizes, "component").withColumn("blocks", blocks)
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
               .join(rows.select(F.col("rid").alias("node"), "id", "mark"), "node"))
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    texts = (source.alias("l").join(members.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.mark") == F.col("r.mark")))
             .select("r.component", "r.node", "r.block", "r.blocks", "l.text"))
    units = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    # Written, so that no stage holds the Python workers of two steps.
    linked = components(staged(confirmed_links(units, rule), "links"), "near")
    plain = rows.drop("keys")
    named = plain.filter("n_shingles > 0").join(classes, ["s1", "s2"]).unionByName(plain.filter("n_shingles = 0").withColumn("rep", F.col("rid")))
    named = (named.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")).select("id", "mark", "rid", "n_shingles", "component"))
    named = staged(named, "classes")
    winners = named.groupBy("component").agg(F.min(F.struct(order_key(F.col("id")).alias("at"), F.col("rid"))).alias("win"))
    return named.join(winners, "component").select(
        "id", "mark", "n_shingles", F.col("win.at.id").alias("component_id"), (F.col("win.rid") == F.col("rid")).alias("kept"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate component, columns unchanged; rows equal in id and text stay or go together."""
    kept = near_components(docs, words, percent, text, doc_id).filter("kept").select("id", "mark")
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"))
    return (rows.alias("l").join(kept.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.mark") == F.col("r.mark")), "left_semi")
            .select("doc.*"))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir), words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: w[i:i + 2])) AS sh FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN pairs b ON r.other = b.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLE = {"op1_near_duplicates": OP1_SQL}
