"""Top-k search, ranked lexical search and vector codes against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from trustloom.llm import codes, lexical, registry, search

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v string, part string, mark int, group int, q int"
DOCS = "doc_id bigint, text string, id string, mark int, items int, kind string, score int"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vector_rows(seed=3, n=300):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([0.0, 0.0, 0.25, -0.5, draw.gauss(0, 0.2)]) for _ in range(12)], draw.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[i % min(7, n)][1], None) for i in range(20)]  # ties
    odd = [(None, rows[0][1], 1), (20, rows[20][1], 2), (20, rows[20][1], 2), (40, rows[3][1], 1), (400, None, 1), (420, [0.1, None] + [0.2] * 10, 1),
           (440, [float("nan")] * 12, 2), (460, [float("inf")] + [0.0] * 11, None), (480, [1e30, -1e30] + [0.5] * 10, 3), (500, [], 4), (520, [0.7] * 5, 5)]
    return [(*r, "x", "y", "z", 1, 2, 3) for r in rows + odd]


def usable(rows, scale, largest):
    return [(r[0], [max(-largest, min(largest, math.floor(scale * float(np.float32(x))))) for x in r[1]], r[2]) for r in rows
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


@pytest.mark.parametrize("limits", [{}, {"part_rows": 40, "group_queries": 4}])
def test_topk_equals_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    rows = vector_rows()
    found = search.exact_topk(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 20 == 0, k=7, **limits).collect()
    kept = usable(rows, 64, search.LARGEST)
    want = []
    for q_id, q in {(i, tuple(v)) for i, v, _ in kept if i is not None and i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for i, v, _ in kept if i != q_id)
        want += [(q_id, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(scored[:7])]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_topk_of_few_and_no_rows(spark):
    few = spark.createDataFrame(vector_rows(n=30)[:3], VECTORS)
    assert len(search.exact_topk(few, F.col("vec_id") == 1).collect()) == 2
    assert search.exact_topk(few.limit(0), F.col("vec_id") == 1).collect() == []
    assert search.exact_topk(few, F.col("vec_id") == 9).collect() == []


def test_sparse_and_dense_postings_agree():
    draw = np.random.default_rng(1)
    values = draw.integers(-9, 10, 400 * 30) * (draw.random(400 * 30) < 0.3)
    values[::30] = 5
    block = search.Block(np.arange(400), np.zeros(400, bool), values, np.full(400, 30))
    assert {rows is None for rows, _ in block.postings} == {True, False}
    query = draw.integers(-9, 10, 30)
    for narrow in (True, False):
        block.narrowed(narrow)
        assert block.scores(np.flatnonzero(query), query[query != 0], narrow).tolist() == (values.reshape(400, 30) @ query).tolist()


def doc_rows(seed=5, n=250):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + "Zeta ÜNDER Straße 漢字 x-y a_b 42".split()
    rows = [(i, " ".join(draw.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=draw.choice([1, 5, 40, 200, 900])))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(15)] + [(None, rows[4][1]), (None, None), (7, rows[9][1]), (8, rows[8][1]), (300, None), (301, ""), (302, " \n-!"),
                                                       (303, "w1 " * 30_000), (304, "x" * 50_000), (305, " ".join(f"u{i}" for i in range(20_000)))]
    return [(*r, "x", 1, 2, "block", 3) for r in rows]


def item_rows():
    return [(1, "w1 w2 w250 Zeta", 0), (2, "ünder STRASSE Straße 漢字 w5 W5", 0), (3, "nothing matches here", 0), (4, None, 0), (5, "...", 0), (6, "u77 u78 u19999", 0),
            (7, " ".join(f"w{i}" for i in range(0, 300, 3)), 0), (7, "w3 x y", 0), (1, "w1 w2 w250 Zeta", 0), (None, "w280 w281 42", 0), (8, "u5", 0)]


def brute_ranking(docs, items, k):
    terms = [(d[0], TERM.findall((d[1] or "").translate(LOWER))) for d in docs]
    terms = [(i, t, len(t)) for i, t in terms if t]
    n_docs, n_terms, df = len(terms), sum(n for _, _, n in terms), {}
    counted = []
    for i, t, n in terms:
        tf = {}
        for x in t:
            tf[x] = tf.get(x, 0) + 1
        counted.append((i, tf, 10 + 90 * n * n_docs // n_terms))
        for x in tf:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in {(i[0], i[1]) for i in items if i[1] is not None}:
        own = [t for t in set(TERM.findall(text.translate(LOWER))) if t in df]
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scored = [(sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in own if t in tf), i) for i, tf, m in counted]
        scored = sorted((-s, i is None, i or 0) for s, i in scored if s > 0)[:k]
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("limits", [{}, {"group_chars": 100, "seeds": 2}])
def test_ranking_equals_brute_force(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(lexical, "LOCAL_KEYS", 3)
        monkeypatch.setattr(lexical, "BLOCK_ROWS", 16)
    docs, items = doc_rows(), item_rows()
    found = lexical.ranked_search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id bigint, text string, id int"), **limits)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute_ranking(docs, items, 10)))


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame(doc_rows()[:9], DOCS), spark.createDataFrame(item_rows(), "item_id bigint, text string, id int")
    assert lexical.ranked_search(docs.limit(0), items).collect() == []
    assert lexical.ranked_search(docs, items.limit(0)).collect() == []
    assert lexical.ranked_search(docs.filter("text is null"), items).collect() == []


def test_bounds_are_never_below_scores(spark):
    docs, items = doc_rows(), [i for i in item_rows() if i[1]]
    asked = lexical.Asked([i[0] for i in items], [i[1] for i in items])
    frame = spark.createDataFrame(docs, DOCS).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    index = lexical.signature_index(frame, asked)
    total = {r["term"]: r["n"] for r in index.filter("kind = 'count'").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    asked.weigh(np.array([total.get(t, 0) for t in range(len(asked.h1))]), total[-1], total[-2])
    bound = {(r["item"], r["id"], r["mark"]): r["bound"] for r in lexical.not_excluded(index.filter("kind = 'block'"), asked, np.zeros(len(items))).collect()}
    pairs = frame.select("id", "mark").crossJoin(spark.range(len(items)).select(F.col("id").cast("int").alias("item")))
    scores = lexical.exact_scores(frame, pairs.select("item", "id", "mark"), asked).join(frame.select(F.col("id").alias("doc_id"), "mark").distinct(), "doc_id")
    loose = 0
    for r in scores.collect():
        at = bound.get((r["item"], r["doc_id"], r["mark"]))
        loose += at is not None and at >= r["score"]
    assert loose >= scores.select("item", "doc_id", "score").distinct().count()


def brute_codes(rows, parts, entries, rounds, scale):
    kept = usable(rows, scale, codes.LARGEST)
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    split = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    start = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[split[r][p] for r in start] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p])) for p, x in enumerate(row)] for row in split]
    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [row[p] for row, c in zip(split, chosen) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    chosen = assign()
    return [(i, label, [c[1] for c in row], sum(c[0] for c in row)) for (i, _, label), row in zip(kept, chosen)], books


def test_codes_equal_brute_force(spark):
    rows = [r for r in vector_rows(n=150) if r[0] != 480]
    found, books = codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=16, rounds=3)
    want, want_books = brute_codes(rows, 4, 16, 3, 1024)
    assert books.tolist() == want_books
    got = [(r["doc"]["vec_id"], r["doc"]["label"], r["codes"], r["error"]) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_codes_of_huge_few_and_no_rows(spark):
    rows = vector_rows(n=30)
    table = spark.createDataFrame(rows, VECTORS)
    huge, _ = codes.vector_codes(table)
    assert huge.count() == len(usable(rows, 1024, codes.LARGEST))
    few, books = codes.vector_codes(table.limit(2))
    assert [r["error"] for r in few.collect()] == [0, 0] and books.shape == (4, 2, 3)
    empty, books = codes.vector_codes(table.limit(0))
    assert empty.collect() == [] and books is None


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_nearest_equals_plain_search(kind):
    draw = np.random.default_rng(2)
    for d in (1, 3, 16):
        parts, book = draw.integers(-40, 40, (3_000, d)), draw.integers(-40, 40, (200, d))
        index, distance = codes.nearest(parts.astype(kind), book)
        table = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert index.tolist() == table.argmin(axis=1).tolist() and distance.tolist() == table.min(axis=1).tolist()


def test_codebook_digest_is_of_the_final_entries(spark):
    folder = "/root/testdata/sf0.001"
    row = registry.llm_queries()["op13_vector_codes"](spark, folder).first()
    _, books = codes.vector_codes(spark.read.parquet(f"{folder}/embeddings.parquet"))
    assert row["codebooks_sha256"] == hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_ranked_search", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    result = compare(spark, "/root/testdata/sf0.001", registry.llm_queries()[name], registry.llm_sql()[name])
    assert result["ok"] is True, result
