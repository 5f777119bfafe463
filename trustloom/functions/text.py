"""Row-local text expressions: tokens, phrases, synonyms, term counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustloom.functions.hof import let, positions, running_sums

WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-case word tokens in order; punctuation gives none."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``value, start, end`` in code points; NULL text has none.

    What lies between the matches gives their places.
    """
    span = "array<struct<value:string,start:int,end:int>>"

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = running_sums(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(matches, ends, lambda m, end: F.struct(
            m.alias("value"), (end - F.length(m)).cast("int").alias("start"), end.cast("int").alias("end"))).cast(span)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.size(m) > 0, placed(m)).otherwise(F.array().cast(span)))


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def list_map(entries: Mapping[str, Sequence[str]]) -> Column:
    """Literal map of a small dictionary of lists."""
    flat = [x for key, values in entries.items() for x in (F.lit(key), string_array(values))]
    return F.create_map(*flat) if flat else F.from_json(
        F.lit("{}"), "map<string,array<string>>")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of n tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))
                    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def _members(items: Column, values: Sequence[str]) -> Column:
    """Elements that are one of the values."""
    return F.filter(items, lambda item: item.isin(list(values)))


def phrase_matches(tokens: Column, phrases: Sequence[str]) -> Column:
    """Every occurrence of a phrase in the token sequence, joined with underscores.

    Phrases are matched in lower case, as the text is.
    """
    lowered = [p.lower() for p in phrases]
    found = [_members(ngrams(tokens, n), [p for p in lowered if len(p.split()) == n])
             for n in sorted({len(p.split()) for p in lowered})]
    if not found:
        return F.array().cast("array<string>")
    return F.transform(F.concat(*found), lambda p: F.replace(p, F.lit(" "), F.lit("_")))


def normalize(text: Column, phrases: Sequence[str], synonyms: Mapping[str, Sequence[str]],
              stopwords: Sequence[str]) -> Column:
    """Tokens of a text: phrases first, then the words with synonyms expanded.

    Stop words, tokens of one or two characters and pure digits are dropped.
    """
    return let(words(text), lambda tokens: _normalized(tokens, phrases, synonyms, stopwords))


def _normalized(tokens: Column, phrases: Sequence[str], synonyms: Mapping[str, Sequence[str]],
                stopwords: Sequence[str]) -> Column:
    if synonyms:
        table = list_map(synonyms)
        expanded = F.flatten(F.transform(
            tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
    else:
        expanded = tokens
    everything = F.concat(phrase_matches(tokens, phrases), expanded)
    stop = list(stopwords)
    return F.filter(everything, lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$")
                    & (~t.isin(stop) if stop else F.lit(True)))


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf), by sorting and cutting at term borders."""
    def cut(ordered: Column) -> Column:
        starts = F.filter(positions(ordered), lambda i: (i == 0) | (
            F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda s, k: F.struct(
            F.get(ordered, s).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(ordered)) - s).alias("tf"))))
    return let(F.array_sort(tokens), cut)


def category(tokens: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Category with the most keyword hits; the first one wins ties, ``other`` without a hit."""
    def choose(hits: Column) -> Column:
        out = F.when(F.array_max(hits) == 0, "other")
        for position, name in enumerate(keywords):
            out = out.when(F.get(hits, F.lit(position)) == F.array_max(hits), name)
        return out

    def count(tokens: Column) -> Column:
        return F.array(*[F.size(_members(tokens, ks)) for ks in keywords.values()])
    return let(let(tokens, count), choose)
