"""Hot keys cut into pieces give exactly what the plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trustloom.functions import skew
from trustloom.operators import intent, rules, series


@pytest.fixture(scope="module")
def samples(spark):
    pick = random.Random(5)
    rows, seq = [], 0
    for host, n in (("hot", 700), ("cold", 3), ("mid", 61), ("sixty", 60)):
        ts = 0
        for _ in range(n):
            ts += pick.choice((0, 1, 40, 900, 4000)) * 1_000_000_000
            seq += 1
            rows.append((host, "/node/bm", "", "m", ts, seq, round(pick.uniform(0, 50), 2)))
    df = spark.createDataFrame(rows, "host string, path string, entity string, metric string, ts bigint, seq bigint, v_num double")
    return df.withColumns({"v_str": F.lit(None).cast("string"), "vtype": F.lit("float"), "counter": F.lit(0), "unit": F.lit("")}).cache()


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ring_features_do_not_depend_on_chunks(samples):
    columns = ("seq", "ring_size", "ring_mean", "ring_min", "ring_max", "ring_delta", "ring_changed", "dynamicity", "severity")
    assert values(series.ring_features(samples), *columns) == values(series.ring_features(samples, chunk_rows=80), *columns)


def test_chunks_are_really_cut(samples):
    cut = skew.split_series(samples, list(series.SERIES), ("ts", "seq"), 60, 150)
    sizes = {r["_chunk"]: r["count"] for r in cut.filter("host = 'hot'").groupBy("_chunk").count().collect()}
    assert len(sizes) > 4
    assert skew.drop_halo(cut).count() == samples.count()


def test_ring_holds_sixty_samples(samples):
    top = series.ring_features(samples).groupBy("host").agg(F.max("ring_size").alias("n")).collect()
    assert {r["host"]: r["n"] for r in top} == {"hot": 60, "cold": 3, "mid": 60, "sixty": 60}


def test_change_only_and_newest(samples):
    whole = samples.withColumn("v_num", F.floor(F.col("v_num") / 25).cast("double"))
    assert values(series.change_only(whole), "seq") == values(series.change_only(whole, chunk_rows=50), "seq")
    assert values(series.newest_n(samples, 7), "seq", "_rank") == values(series.newest_n(samples, 7, chunk_rows=50), "seq", "_rank")


def test_rules_and_intervals(spark, samples):
    clauses = rules.clause_table(rules.rule_table(spark, "Low | /node/bm | Red | 1min(m)<49\nMove | /node/bm | Red | 1min(dynamicity(m))>25"))
    columns = ("name", "host", "seq")
    plain = values(rules.rule_hits(samples, clauses), *columns)
    assert plain == values(rules.rule_hits(samples, clauses, chunk_rows=60), *columns)
    assert {p[0] for p in plain} == {"Low", "Move"}
    states = samples.select("host", "ts", "seq", (F.col("v_num") > 20).alias("hit"))
    assert values(rules.symptom_intervals(states, ["host"]), "host", "start_ts", "stop_ts", "ticks") == values(
        rules.symptom_intervals(states, ["host"], chunk_rows=40), "host", "start_ts", "stop_ts", "ticks")


def test_sustained_rule_by_hand(spark, samples):
    clauses = rules.clause_table(rules.rule_table(spark, "Low | /node/bm | Red | 1min(m)<45"))
    got = set(r["seq"] for r in rules.rule_hits(samples, clauses).collect())
    want = set()
    for host in ("hot", "cold", "mid", "sixty"):
        rows = sorted((r["ts"], r["seq"], r["v_num"]) for r in samples.filter(F.col("host") == host).collect())
        want |= {rows[i][1] for i in range(19, len(rows)) if all(r[2] < 45 for r in rows[i - 19:i + 1])}
    assert got == want


def test_sessions(samples):
    rows = samples.select("host", "seq", F.expr("ts DIV 1000000000").alias("s"))
    columns = ("host", "session_no", "start_s", "end_s", "n")
    assert values(intent.sessions(rows, "host", "s", ["s", "seq"], 60), *columns) == values(
        intent.sessions(rows, "host", "s", ["s", "seq"], 60, chunk_rows=30), *columns)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("n", [1, 2, 5, 11, 3000])
def test_exact_quantile(spark, q, n):
    import numpy as np
    data = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("a", float(x)) for x in data], "k string, v double")
    assert skew.exact_quantile(df, ["k"], "v", q, "x").first()["x"] == pytest.approx(float(np.quantile(data, q)), abs=1e-12)


@pytest.mark.parametrize("most", [1, 40])
def test_quantiles_by_narrowing(spark, most):
    import numpy as np
    draw = np.random.default_rng(3)
    data = {"even": draw.normal(size=4_000), "ties": draw.integers(0, 3, 2_000).astype(float), "one": np.array([7.0]), "far": np.concatenate([np.zeros(3_000), [1e9]])}
    df = spark.createDataFrame([(k, float(x)) for k, own in data.items() for x in own], "k string, v double").repartition(5)
    for q in (0.0, 0.5, 0.937, 1.0):
        got = {r["k"]: r["x"] for r in skew.exact_quantile(df, ["k"], "v", q, "x", most=most).collect()}
        assert got == {k: pytest.approx(float(np.quantile(own, q)), rel=1e-12, abs=1e-12) for k, own in data.items()}


def test_edge_rows_and_totals_of_hot_keys(spark):
    df = spark.createDataFrame([("k", i // 7, i) for i in range(200)] + [("c", 1, 1), (None, 2, 2)], "k string, ts int, seq int").repartition(4)
    for newest in (True, False):
        whole = values(skew.edge_rows(df, ["k"], ("ts", "seq"), 5, newest), "seq", "_rank")
        assert whole == values(skew.edge_rows(df, ["k"], ("ts", "seq"), 5, newest, chunk_rows=9), "seq", "_rank") and len(whole) == 7
    plain = {(r["k"], r["seq"]): r["sum"] for r in skew.running_total(df, ["k"], ("ts", "seq"), "seq", "sum").collect()}
    assert plain == {(r["k"], r["seq"]): r["sum"] for r in skew.running_total(df, ["k"], ("ts", "seq"), "seq", "sum", chunk_rows=9).collect()}


@pytest.mark.parametrize("depth", [2, 30])
def test_crowded_moments_keep_their_neighbours(spark, depth):
    """Rows of one moment are more than a chunk; the last chunk is shorter than the frame."""
    hours = [0] * 100 + [1] + [2] * 7 + [3] * 40 + [4] * 3 + [5] * 200 + [9, 9, 10]
    rows = [("k", h * 3600, i) for i, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "k string, ts bigint, v bigint")
    window = Window.partitionBy("k", "_chunk").orderBy("ts", "v").rowsBetween(-depth, 0)

    def sums(chunk_rows):
        cut = skew.split_series(df, ["k"], ("ts", "v"), depth, chunk_rows)
        return values(skew.drop_halo(cut.withColumn("s", F.sum("v").over(window))), "v", "s")
    assert sums(3) == sums(10_000)
