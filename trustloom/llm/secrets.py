"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns are reported as found. Weak ones (access identifiers, bare keys, endpoints) mean little alone and are only
reported when complementary parts meet in the same scope (the query), or within ``reach`` code points of it (``REACH`` unless given): an identifier needs a secret, a key needs an
identifier or an endpoint, an endpoint needs both. A scope is a paragraph: the text between blank lines. Parts are joined by
interval in one sweep: in order of place, every part sees the nearest part of each role before and after it, so a dense scope
costs as many rows as it has parts, and no pairs are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.hof import let, running_sums
from trustloom.llm.common import documents
from trustloom.session import staged


def either_case(words: str) -> str:
    """A pattern of words with every ASCII letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"(?:{either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run after AKIA is taken whole, so at least 20 characters in all
HEX = "[0-9a-f]{24,}"
IDENTIFIER = f"(?:{either_case('username|user|login|account|client_?id')})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9._@-]{{3,}}"
KEY = "[A-Za-z0-9+/_=-]{20,}"
KEY_HAS = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = "[A-Za-z][A-Za-z0-9+]{1,9}://[A-Za-z0-9._-]+"
SCOPE_END = "\\n[\\x20\\t\\r]*\\n"
REACH = 400
KINDS = ("assign", "access", "hex", "linked_identifier", "linked_key", "linked_endpoint")
BREAK = 9
SPAN = "struct<start:int,rank:int,stop:int>"
NO_SPANS = f"array<{SPAN}>"


def _none() -> Column:
    return F.array().cast(NO_SPANS)


def _located(text: Column, pattern: str, rank: int, sizes=None, passes=None) -> Column:
    """Spans of the leftmost non-overlapping matches of a pattern; what lies between the matches gives their places.

    ``passes`` gets a match (or, with ``sizes``, the text of group 1) and tells whether its span is kept.
    """
    def spans(matches: Column) -> Column:
        tested = matches if sizes is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

        def walk(gaps: Column) -> Column:
            ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m)))
            found = F.zip_with(matches, ends, lambda m, end: F.struct(
                (end - F.length(m)).cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("stop")))
            if passes is None:
                return found
            held = F.zip_with(found, tested, lambda span, value: F.struct(span.alias("span"), passes(value).alias("good")))
            return F.transform(F.filter(held, lambda x: x["good"]), lambda x: x["span"])
        return let(F.split(text, pattern, -1), walk)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda m: F.when(F.size(m) == 0, _none()).otherwise(spans(m)))


def located_parts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``id, base, weak, breaks`` per row: spans (start, rank, stop) in code points; breaks only where there are weak parts."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), content.alias("text"))
    rows = rows.withColumn("base", F.concat(
        _located(F.col("text"), ASSIGN, 0, sizes=1, passes=lambda value: F.length(value) >= ASSIGN_VALUE),
        _located(F.col("text"), ACCESS, 1), _located(F.col("text"), HEX, 2)))
    rows = rows.withColumn("weak", F.concat(
        _located(F.col("text"), IDENTIFIER, 3),
        _located(F.col("text"), KEY, 4, passes=lambda value: reduce(lambda a, b: a & b, (value.rlike(p) for p in KEY_HAS))),
        _located(F.col("text"), ENDPOINT, 5)))
    return rows.select("id", "base", "weak", F.when(F.size("weak") > 0, _located(F.col("text"), SCOPE_END, BREAK)).otherwise(_none()).alias("breaks"))


def linked_parts(parts: DataFrame, reach: int | None = REACH) -> DataFrame:
    """``rid, linked``: the weak spans of a row that meet their complements and lie in no base span; None reaches over the scope."""
    rows = (parts.filter(F.size("weak") > 0).select("rid", F.explode(F.concat("base", "weak", "breaks")).alias("s"))
            .select("rid", "s.start", "s.rank", "s.stop"))
    order = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum(F.when(F.col("rank") == BREAK, 1).otherwise(0)).over(order)).filter(F.col("rank") != BREAK)
    inside = Window.partitionBy("rid", "scope").orderBy("start", "rank")
    # What follows a part comes first in the reversed order; a frame up to the end would be read again for every part.
    reverse = Window.partitionBy("rid", "scope").orderBy(F.desc("start"), F.desc("rank"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (inside, reverse))
    base = F.col("rank") <= 2
    # Weak parts inside a base span are that span; they are no parts of their own.
    hidden = F.coalesce(F.max(F.when(base, F.col("stop"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.last(F.when(base, F.col("start")), ignorenulls=True).over(after) < F.col("stop"), F.lit(False))
    rows = rows.withColumn("hidden", ~base & hidden).filter("not hidden")
    roles = {"identifier": F.col("rank").isin(1, 3), "secret": F.col("rank").isin(0, 2, 4), "endpoint": F.col("rank") == 5}

    def near(role: str) -> Column:
        left = F.col("start") - F.max(F.when(roles[role], F.col("stop"))).over(before)
        right = F.last(F.when(roles[role], F.col("start")), ignorenulls=True).over(after) - F.col("stop")
        if reach is None:
            return left.isNotNull() | right.isNotNull()
        return F.coalesce(left <= reach, F.lit(False)) | F.coalesce(right <= reach, F.lit(False))
    rows = rows.withColumns({role: near(role) for role in roles})
    met = (F.when(F.col("rank") == 3, F.col("secret")).when(F.col("rank") == 4, F.col("identifier") | F.col("endpoint"))
           .when(F.col("rank") == 5, F.col("identifier") & F.col("secret")).otherwise(False))
    return rows.filter(met).groupBy("rid").agg(F.collect_list(F.struct("start", "rank", "stop")).alias("linked"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", reach: int | None = REACH) -> DataFrame:
    """``id, base, linked``: arrays of spans (start, rank in ``KINDS``, stop) per row of ``docs``.

    Base spans are leftmost and non-overlapping per kind. Null texts are empty and have none. Long texts are scanned whole,
    positions count code points; rows that repeat an id are told apart by their place; other columns are not read; an
    empty table gives no rows.
    """
    parts = staged(located_parts(docs, text, doc_id).withColumn("rid", F.monotonically_increasing_id()), "parts")
    return (parts.join(linked_parts(parts, reach), "rid", "left")
            .select("id", "base", F.coalesce("linked", _none()).alias("linked")))


def op6_linked_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir), reach=None)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda span: span["rank"] == rank)).cast("bigint").alias(f"n_{KINDS[rank]}")
    return found.select(F.col("id").alias("doc_id"), *(count(rank) for rank in range(3)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.concat("base", "linked")).alias("spans"))


QUERIES = {"op6_linked_secrets": op6_linked_secrets}
ORACLE: dict[str, str] = {}
