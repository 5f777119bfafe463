"""Vector codes: parts of vectors become the indexes of their nearest codebook entries, found by equal-average search.

The squared gap between the sums of two vectors of d components is at most d times their squared distance. So entries are sorted by
their sum, and the search for a part expands outward from its own sum on both sides; a side ends when the squared gap over d
strictly exceeds the best distance. Rounds of assignment and averaging refine the codebooks: tasks add up the parts of each entry,
Spark adds up the tasks, and only the sums per entry reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustloom.llm.search import finite, whole_components
from trustloom.session import staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = (1 << 27) - 1
ROWS = 1_024


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for every part; equal distances go to the lower index."""
    n, d = parts.shape
    book, sums = book.astype(parts.dtype), book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    best, index = np.full(n, (1 << 62) // max(1, d), dtype=np.int64), np.full(n, len(book))
    own = parts.sum(axis=1).astype(np.int64)
    sorted_rows = np.argsort(own, kind="stable")
    for at in range(0, n, ROWS):
        rows = sorted_rows[at:at + ROWS]
        right = np.searchsorted(sums, own[rows])
        sides = [(rows, right, 1), (rows, right - 1, -1)]
        while sides:
            going = []
            for active, place, step in sides:
                held = (place >= 0) & (place < len(sums))
                active, place = active[held], place[held]
                gap = sums[place] - own[active]
                held = gap * gap <= d * best[active]
                active, place = active[held], place[held]
                if not len(active):
                    continue
                away = parts[active] - entries[place]
                distance = np.einsum("ij,ij->i", away, away).astype(np.int64)
                number = order[place]
                closer = (distance < best[active]) | ((distance == best[active]) & (number < index[active]))
                best[active[closer]], index[active[closer]] = distance[closer], number[closer]
                going.append((active, place + step, step))
            sides = going
    return index, best


def part_table(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """The components of a batch of vectors as (part, row, component); shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy().astype(np.int64)
    values = column.flatten().to_numpy()
    out = np.zeros((len(sizes), parts * width), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    # Sums of squares below 2**53 are whole numbers in doubles too, which are faster.
    small = len(values) == 0 or np.abs(out).max() < 1 << 20 and width <= 1 << 10
    out = out.reshape(len(sizes), parts, width).transpose(1, 0, 2)
    return np.ascontiguousarray(out, dtype=np.float64 if small else np.int64)


def entry_sums(kept: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Per (part, entry) the number of its parts and their sum."""
    parts, entries, width = books.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for p, table in enumerate(part_table(batch.column("v"), parts, width)):
                index, _ = nearest(table, books[p])
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                count[p] += np.bincount(index, minlength=entries)
                if len(used):
                    total[p, used] += np.add.reduceat(table[order], first, axis=0).astype(np.int64)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"])
    sums = kept.select("v").mapInArrow(added, "part bigint, entry bigint, n bigint, total array<bigint>")
    sums = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).cast("array<bigint>").alias("total"))
    return {(r["part"], r["entry"]): (r["n"], r["total"]) for r in sums.collect()}  # parts * entries rows at most


def trained_books(kept: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """The codebooks (part, entry, component) after all rounds; None without vectors."""
    size = kept.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return None
    width = -(-size // parts)
    start = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    books = part_table(start, parts, width).astype(np.int64)
    for _ in range(rounds):
        for (p, e), (n, total) in entry_sums(kept, books).items():
            books[p, e] = [t // n for t in total]
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 vector: str = "embedding", vec_id: str = "vec_id", payload: Column | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """One row per usable vector (``doc``: the payload, all columns by default; ``codes`` array<int>, ``error`` long) and the codebooks.

    Rows whose vector is null or holds null or non-finite components are dropped. Components become ``floor(scale * x)``, held
    within 2**27. Codebooks start with the ``entries`` smallest ids (null last; rows that repeat an id by their components), fewer
    if there are fewer rows. Vectors shorter than the longest end in zeros, and so do parts if the length is not divisible. Rows that
    repeat each other count as often as they are there. An empty table gives no rows and no codebooks.
    """
    kept = vectors.filter(finite(vector)).select(
        (payload if payload is not None else F.struct("*")).alias("doc"), F.col(vec_id).cast("bigint").alias("id"),
        whole_components(vector, scale, LARGEST).alias("v"))
    books = trained_books(kept.select("id", "v"), parts, entries, rounds)
    schema = T.StructType([kept.schema["doc"], *T.StructType.fromDDL("codes array<int>, error bigint")])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = np.zeros((batch.num_rows, parts), np.int32), np.zeros(batch.num_rows, np.int64)
            for p, table in enumerate(part_table(batch.column("v"), parts, books.shape[2])):
                codes[:, p], distance = nearest(table, books[p])
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], ["doc", "codes", "error"])
    return kept.select("doc", "v").mapInArrow(coded, schema), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = vector_codes(vectors, payload=F.struct("vec_id", "label"))
    text = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    rows = staged(coded.select("doc.vec_id", F.col("doc.label").alias("label"), F.array_join(digits, "").alias("code"), "error"), "codes")
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return (rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.sha2(F.lit(text), 256).alias("codebooks_sha256")))


def _round_sql(i: int) -> str:
    """Assignment to the entries of round ``i`` and the entries of the next."""
    return f"""
d{i} AS (
  SELECT x.rid, x.p, x.v, c.e,
         list_sum(list_transform(range(1, len(x.v) + 1), lambda j: (x.v[j] - c.v[j]) * (x.v[j] - c.v[j])))::BIGINT AS dist
  FROM x JOIN c{i} c USING (p)),
a{i} AS (SELECT rid, p, any_value(v) AS v, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM d{i} GROUP BY rid, p),
m{i} AS (
  SELECT p, e, list(fl ORDER BY j) AS v FROM (
    SELECT p, e, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS fl FROM (
      SELECT p, e, j, sum(u)::BIGINT AS s, count(*) AS n
      FROM (SELECT p, e, unnest(v) AS u, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY p, e, j)) GROUP BY p, e),
c{i + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (p, e))"""


OP13_SQL = r"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
         list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (
  SELECT rid, p, v[(p * (len(v) // 4) + 1):((p + 1) * (len(v) // 4))] AS v FROM k, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, rid - 1 AS e, v FROM x WHERE rid <= 256),""" + ",".join(
    part for i in range(ROUNDS + 1) for part in [_round_sql(i).replace("AS (", "AS MATERIALIZED (")]) + rf""",
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN k USING (rid), book
"""
QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE = {"op13_vector_codes": OP13_SQL}
