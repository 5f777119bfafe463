"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive runs of bytes, most significant first. A level groups the rows that agreed so far by their
next bytes; groups of one row and groups whose texts have ended are done, the others go on with the bytes that are left.
Widths grow from level to level, so the number of levels is logarithmic in the longest text that still has a rival. Equality is
decided on the bytes themselves, no digest is compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import SPACES, documents, order_key
from trustloom.session import discard, shared_dir

FIRST_BYTES = 64
GROWTH = 4


def normal_text(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _level(state: DataFrame, start: int, width: int, first: bool, keep_text: bool) -> DataFrame:
    """Rows with their next digit, the size and winner of their group, and whether they go on (``open``)."""
    content = state.select("doc", "id", "rid", "grp", "text", normal_text(F.col("text")).cast("binary").alias("bytes"))
    cut = content.select("doc", "id", "rid", "grp", "text", F.substring("bytes", start + 1, width).alias("digit"),
                         (F.octet_length("bytes") <= start + width).alias("ended"))
    keys = ["grp", "digit", "ended"]
    rivals = (cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order_key(F.col("id")).alias("at"), F.col("rid"))).alias("win"))
              .filter("n > 1"))
    met = cut.join(rivals, keys, "left")
    lone = F.col("n").isNull()
    goes_on = ~lone & (F.lit(True) if first else ~F.col("ended"))
    rid = F.monotonically_increasing_id() if first else F.col("rid")
    return met.select(
        "doc", "id", rid.alias("rid"), (F.col("text") if keep_text else F.when(goes_on, F.col("text"))).alias("text"),
        (F.col("digit") if first else F.col("win.rid").cast("string").cast("binary")).alias("grp"), goes_on.alias("open"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.when(lone, F.col("id")).otherwise(F.col("win.at.id")).alias("keep_id"),
        (lone | (F.col("win.rid") == F.col("rid"))).alias("kept"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", payload: Column | None = None,
                 keep_text: bool = False, first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """One row per input row: ``doc`` (payload), ``keep_id``, ``group_size``, ``kept`` and ``text`` (null unless ``keep_text``).

    ``payload`` is a struct of what the caller wants back (the id if not given), so no input name can clash. Texts equal
    after white space is normalised form a group; null counts as empty. The row with the smallest id stays, a null id comes last
    and among equal ids exactly one row stays. An empty table gives an empty result. Memory per task is that of rows; a group
    of any size is only counted (partial sums) and joined to one row, and skewed partitions of that join are split. A level is
    written to the shared folder; what only its successor read is discarded then.
    """
    spark = docs.sparkSession
    state = docs.select((payload if payload is not None else F.struct(doc_id)).alias("doc"), F.col(doc_id).alias("id"),
                        F.lit(None).cast("bigint").alias("rid"), F.lit("").cast("binary").alias("grp"), F.col(text).alias("text"))
    done, start, width, before = [], 0, first_bytes, None
    while True:
        path = shared_dir(spark, "radix")
        rows = _level(state, start, width, before is None, keep_text)
        rows.write.partitionBy("open").parquet(path)
        if before:
            discard(spark, f"{before}/open=true")
        level = spark.read.schema(rows.schema).parquet(path)
        done.append(level.filter("not open").select("doc", "text", "keep_id", "group_size", "kept"))
        state = level.filter("open").select("doc", "id", "rid", "grp", "text")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
        start, width, before = start + width, width * growth, path


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input rows without later copies of equal texts, columns unchanged."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text])
    found = exact_groups(docs, text, doc_id, payload=rest, keep_text=True).filter("kept")
    return found.select(*[(F.col("text") if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    payload = F.struct("doc_id", F.sha2(normal_text(F.col("text")), 256).alias("text_sha256"))
    return exact_groups(docs, payload=payload).select(
        "doc.doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", "doc.text_sha256")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {"op3_exact_dedup": OP3_SQL}
