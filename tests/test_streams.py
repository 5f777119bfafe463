"""Streams over tables of one file and of many, in one micro-batch and in several."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_trust import fold

from trustloom.functions.scalar import epoch_ns
from trustloom.plans import stream_queries
from trustloom.streaming import emission, incremental, ring, state

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The small tables with the events as a folder of five files in the order of time."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("customer", "orders"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("ts", "event_id").toPandas()
    schema = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    step = len(events) // 5 + 1
    for start in range(0, len(events), step):
        spark.createDataFrame(events[start:start + step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", sorted(stream_queries.QUERIES))
def test_a_folder_of_files_is_read_like_one_file(spark, many_files, name):
    got = rows(stream_queries.QUERIES[name](spark, many_files))
    assert got and got == rows(stream_queries.QUERIES[name](spark, FOLDER))


def test_strict_trust_goes_on_over_micro_batches(spark, many_files, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    scores = stream_queries._scores(stream_queries._event_stream(spark, many_files, files=2))
    hot = scores.withColumn("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1).cast("bigint")))
    incremental.strict_trust_stream(hot, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    got = {r["id"]: (r["trust_index"], r["counter"]) for r in incremental.strict_trust_table(spark, str(tmp_path / "state")).collect()}
    want = {}
    for r in events.orderBy("ts", "event_id").collect():
        want.setdefault(r["user_id"] if r["user_id"] % 3 == 0 else 1, []).append(r["value"])
    assert got == {key: fold(values) for key, values in want.items()}


@pytest.mark.parametrize("chunk_rows", [2_000_000, 25])
def test_ring_goes_on_over_micro_batches(spark, many_files, tmp_path, chunk_rows):
    samples = stream_queries._event_stream(spark, many_files, files=2).select(
        F.lit("k").alias("k"), epoch_ns("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("v_num"))
    ring.ring_stream(samples, ["k"], str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), ring=10, sustain=12, below=90.0,
                     chunk_rows=chunk_rows).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts", "seq").select(
        "seq", "ring_size", F.round("ring_mean", 6), F.round("ring_delta", 6), "changed", "held").collect()]
    plain = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("ts", "event_id").collect()
    values = [r["value"] for r in plain]
    assert len(got) == len(values) and len(list((tmp_path / "out").glob("batch=*"))) == 3
    for i, (seq, size, mean, delta, changed, held) in enumerate(got):
        window = values[max(0, i - 9):i + 1]
        assert (seq, size) == (plain[i]["event_id"], len(window))
        assert abs(mean - sum(window) / len(window)) < 2e-6 and abs(delta - (values[i] - window[0])) < 2e-6
        assert changed == (i == 0 or values[i] != values[i - 1])
        assert held == (i >= 11 and max(values[i - 11:i + 1]) < 90.0)


def test_state_versions(spark, tmp_path):
    path, schema = str(tmp_path / "state"), StructType.fromDDL("k bigint, v bigint")

    def put(number, rows):
        state.write_state(spark.createDataFrame(rows, schema), path, number, ["k"])

    def at(before):
        return sorted(map(tuple, state.read_state(spark, path, schema, before).collect()))
    assert at(5) == []
    put(state.START, [(k, 0) for k in range(200)])
    put(0, [(k, 1) for k in range(3)])
    own = {r[0] for r in spark.range(200).select(state.bucket_of(["id"]).alias("b"), "id").filter(F.col("b").isin(
        [r[0] for r in spark.range(3).select(state.bucket_of(["id"])).collect()])).select("id").collect()}
    assert at(0) == [(k, 0) for k in range(200)]
    assert at(1) == sorted([(k, 1) for k in range(3)] + [(k, 0) for k in range(200) if k not in own])
    put(0, [(0, 7)])  # a retry replaces what the batch wrote
    assert (0, 7) in at(1) and (0, 1) not in at(1)
    for number in range(1, 5):
        put(number, [(0, number)])
    assert (0, 4) in at(9) and (0, 3) in at(4)  # a retry of batch 4 still finds the state before it
    assert len(list((tmp_path / "state").glob("batch=*/bucket=*/"))) < 70


def emitted(spark, tmp_path, make, batches):
    """Rows that a stream of several files emits; every file is a micro-batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(k, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t), t, v) for k, t, v in rows], TIMED)
        frame.coalesce(1).write.mode("append").parquet(str(folder / f"part={i}"))
    stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    rows = stream_queries._emitted(spark, make(stream)).collect()
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    return sorted((r["k"], r["us"] // 1_000_000 - start, r["v_num"]) for r in rows)


TIMED = "k string, ts timestamp, seq bigint, v_num double"
# Samples out of order within a minute; the second batch moves the watermark past the first.
BATCHES = [[("a", 10, 1.0), ("a", 30, 1.0), ("a", 20, 2.0), ("b", 5, 7.0)], [("a", 15, 1.0), ("a", 200, 2.0), ("b", 130, 7.0)], [("a", 300, 5.0), ("b", 400, 8.0)]]


def test_changes_come_in_event_time(spark, tmp_path):
    got = emitted(spark, tmp_path, lambda s: emission.on_change_stream(s, ["k"]), BATCHES)
    assert got == [("a", 10, 1.0), ("a", 20, 2.0), ("a", 30, 1.0), ("a", 200, 2.0), ("a", 300, 5.0), ("b", 5, 7.0)]


def test_samples_come_at_every_tick(spark, tmp_path):
    got = emitted(spark, tmp_path, lambda s: emission.sample_stream(s, ["k"], 60 * 10**9), BATCHES)
    a = [("a", 60, 1.0), ("a", 120, 1.0), ("a", 180, 1.0), ("a", 240, 2.0), ("a", 300, 5.0)]
    assert got == a + [("b", t, 7.0) for t in (60, 120, 180, 240, 300)]


def test_triggers_of_subscriptions():
    assert emission.tick_trigger(2_500_000_000) == {"processingTime": "2.5 seconds"} and emission.tick_trigger() == {"processingTime": "3 seconds"}
    assert emission.poll() == {"availableNow": True}
