"""The similarity join against all pairs, in one and in many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from trustloom.functions.text import words
from trustloom.operators import recommend, similarity


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(2)
    vocabulary = [f"t{i:02}" for i in range(60)]

    def texts(n):
        return [(i, " ".join(draw.choices(vocabulary, weights=[60 // (j + 1) + 1 for j in range(60)], k=draw.choice([0, 2, 9, 30])))) for i in range(n)]
    queries = spark.createDataFrame(texts(90), "query_id bigint, text string")
    rules = spark.createDataFrame(texts(70), "rule_id bigint, text string")
    terms = similarity.vocabulary(rules, words(F.col("text")))
    return similarity.text_vectors(queries, "query_id", words(F.col("text")), terms), similarity.text_vectors(rules, "rule_id", words(F.col("text")), terms)


def every_pair(queries, rules, least):
    left = {r["query_id"]: dict(zip(r["nos"], r["weights"])) for r in queries.collect()}
    right = {r["rule_id"]: dict(zip(r["nos"], r["weights"])) for r in rules.collect()}
    scores = {(q, r): sum(w * b.get(t, 0.0) for t, w in a.items()) for q, a in left.items() for r, b in right.items()}
    return {pair: round(s, 9) for pair, s in scores.items() if s >= least}


@pytest.mark.parametrize("sizes", [{}, {"block_rules": 9, "group_queries": 20}])
@pytest.mark.parametrize("least", [0.2, 0.5, 0.9])
def test_all_pairs_above_the_threshold(sides, least, sizes):
    found = similarity.similar_pairs(*sides, least, **sizes).collect()
    assert {(r["query_id"], r["rule_id"]): round(r["score"], 9) for r in found} == every_pair(*sides, least)
    assert len(found) == len({(r["query_id"], r["rule_id"]) for r in found})


def test_rest_of_a_rule_is_not_posted(sides):
    rows = sides[1].toArrow().combine_chunks()
    columns = [rows.column(c).combine_chunks() for c in ("rule_id", "nos", "weights")]
    posted = [len(similarity.RuleBlock(*columns, None, least).rows) for least in (0.1, 0.5, 0.8)]
    assert posted[0] > posted[1] > posted[2] > 0


@pytest.mark.parametrize("sizes", [{}, {"block_rules": 1, "group_queries": 2}])
def test_dense_and_hybrid_vectors(spark, sizes):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "query_id int, vector array<float>")
    r = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0])], "rule_id int, vector array<float>")

    def show(df):
        return sorted((x["query_id"], x["rule_id"], round(x["score"], 9)) for x in df.collect())
    dense = similarity.similar_pairs(similarity.dense_vectors(q, "query_id"), similarity.dense_vectors(r, "rule_id"), 0.3, **sizes)
    assert show(dense) == [(1, 7, 1.0), (2, 7, 0.707106781), (2, 8, 0.707106781)]
    text = spark.createDataFrame([(1, [4], [1.0])], "query_id int, nos array<bigint>, weights array<double>")
    rule_text = spark.createDataFrame([(7, [4, 5], [0.6, 0.8])], "rule_id int, nos array<bigint>, weights array<double>")
    both = similarity.similar_pairs(similarity.hybrid_vectors(text, q, "query_id"), similarity.hybrid_vectors(rule_text, r, "rule_id"), 0.3, **sizes)
    assert show(both)[0] == (1, 7, round((0.6 + 2.0) / (2 * 5) ** 0.5, 9))
    best = similarity.ranked(similarity.similar_pairs(similarity.dense_vectors(q, "query_id"), similarity.dense_vectors(r, "rule_id"), None, k=1, **sizes), 1)
    assert {(x["query_id"], x["rule_id"]) for x in best.collect()} == {(1, 7), (2, 7), (3, 7)}


def test_empty_sides(sides):
    assert similarity.similar_pairs(sides[0].limit(0), sides[1], 0.3).collect() == []
    assert similarity.similar_pairs(sides[0], sides[1].limit(0), 0.3).collect() == []
    with pytest.raises(ValueError):
        similarity.similar_pairs(*sides, 0.0)


def test_model_scores_are_read_line_by_line(spark):
    text = "r1:0.5\nr01:0.9\nr2: 0.4\nr3:1.00\r\nr4:1.01\nr5:0.123\nr6:0.12:0\nr40:0.7\nr1:0.6\nx r7:0.5\nr8:.5\nr9:1"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "query_id int, response string")
    got = {(r["query_id"], r["rule_id"]): r["score"] for r in recommend.parse_model_scores(rows).collect()}
    assert got == {(1, "r1"): 0.6, (1, "r3"): 1.0, (1, "r40"): 0.7}
    assert {r["rule_id"] for r in recommend.parse_model_scores(rows, max_rule=33).collect()} == {"r1", "r3"}


def test_postings_are_added_in_pieces_of_any_size(sides, monkeypatch):
    rows, asked = (side.toArrow().combine_chunks() for side in (sides[1], sides[0]))
    block = similarity.RuleBlock(*[rows.column(c).combine_chunks() for c in ("rule_id", "nos", "weights")], None, 0.3)
    found = []
    for most in (1, 7, 1 << 20):
        monkeypatch.setattr(similarity, "POSTINGS", most)
        q, r, score = block.pairs(*[asked.column(c).combine_chunks() for c in ("nos", "weights")], None, 0.3, None)
        found.append(sorted(zip(q.tolist(), r.tolist(), score.round(9).tolist())))
    assert found[0] == found[1] == found[2] and found[0]
