"""Trust indexes against a plain fold, and the time bounds."""

import random

import pytest
from pyspark.sql import functions as F

from trustloom.functions.scalar import time_bound_ns
from trustloom.operators import trust
from trustloom.streaming import incremental


def fold(scores):
    mean, count = 0.0, 0
    for score in scores:
        mean = round((mean * count + score / 100) / (count + 1), 4)
        count += 1
    return mean, count


@pytest.fixture(scope="module")
def scored(spark):
    pick = random.Random(1)
    rows = [(f"d{d}", i * 1_000_000_000, i, float(pick.randint(0, 100))) for d, n in ((0, 26_000), (1, 7), (2, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, ts bigint, seq bigint, score double").cache()


def test_strict_equals_the_fold_of_all_messages(scored):
    rows, df = scored
    got = {r["id"]: (r["trust_index"], r["counter"]) for r in trust.trust_strict(df).collect()}
    want = {d: fold([r[3] for r in rows if r[0] == d]) for d in ("d0", "d1", "d2")}
    assert got == want


def test_strict_folds_wide_scores(spark):
    rows = [("w", i, i, float((i * 7919) % 1000 - 300)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, ts bigint, seq bigint, score double").repartition(5)
    got = trust.trust_strict(df).first()
    assert (got["trust_index"], got["counter"]) == fold([r[3] for r in rows])


def test_strict_stream_equals_the_fold(spark, scored, tmp_path):
    rows, df = scored
    for part in range(3):
        df.filter((F.col("seq") % 3 == part) & (F.col("id") != "d0") | (F.col("id") == "d0") & (F.floor(F.col("seq") / 9000) == part)).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    incremental.strict_trust_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    table = incremental.strict_trust_table(spark, str(tmp_path / "out"), "string")
    got = {r["id"]: (r["trust_index"], r["counter"]) for r in table.collect()}
    assert got == {d: fold([r[3] for r in rows if r[0] == d]) for d in ("d0", "d1", "d2")}


def test_time_bounds():
    assert time_bound_ns(None) is None and time_bound_ns("") is None and time_bound_ns("0") is None
    assert time_bound_ns("1700000000000000001") == 1700000000000000001
    assert time_bound_ns("2024-01-01T00:00:00.000001Z") == 1704067200000001000
    with pytest.raises(ValueError):
        time_bound_ns("yesterday")
