"""Streaming operators over the events read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions.scalar import epoch_ns, half_even
from trustloom.plans.series_queries import ORACLE as SERIES
from trustloom.plans.tables import table
from trustloom.session import is_folder, shared_dir
from trustloom.streaming import emission, incremental, ring

DAY_NS = 86_400 * 10**9


def _event_stream(spark, folder, files=None):
    """The events as a stream, from one file or from a folder of part files; ``files`` of them per micro-batch, or all."""
    path = f"{folder}/events.parquet"
    reader = spark.readStream.schema(table(spark, folder, "events").schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(folder)  # a stream lists folders only


def _scores(events):
    return events.select(F.col("user_id").alias("id"), epoch_ns("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("score"))


def stream_trust(spark, folder):
    return incremental.stream_trust(spark, _scores(_event_stream(spark, folder)))


def stream_requests(spark, folder):
    """Requests of the event stream answered from the customers' scores."""
    requests = _event_stream(spark, folder).filter("event_type = 'signup'").select(
        F.col("event_id").alias("request_id"), F.array("user_id", "event_id").alias("ids"))
    machines = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    scores = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        half_even(F.avg(F.col("o_totalprice") / 1e6), 4).alias("trust_index"))
    path = shared_dir(spark, "answers")
    incremental.answer_requests(requests, machines, scores, path, shared_dir(spark, "answers-offsets")).awaitTermination()
    return spark.read.schema("request_id BIGINT, id BIGINT, trust_index DOUBLE").json(f"{path}/*")


def stream_strict(spark, folder):
    """The step-rounded trust index kept as a state table."""
    state = shared_dir(spark, "strict")
    incremental.strict_trust_stream(_scores(_event_stream(spark, folder)), state, shared_dir(spark, "strict-offsets")).awaitTermination()
    return incremental.strict_trust_table(spark, state)


def _samples(events):
    return events.select("user_id", "event_type", epoch_ns("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("v_num"))


def _ring_query(spark, samples, start=None):
    keys, depth = ["user_id", "event_type"], 60
    path, state = shared_dir(spark, "ring"), shared_dir(spark, "ring-state")
    if start is not None:
        ring.start_state(start, keys, state, depth)
    ring.ring_stream(samples, keys, path, state, shared_dir(spark, "ring-offsets"), depth, sustain=5, below=50.0).awaitTermination()
    return ring.ring_table(spark, path, F.col("seq").alias("event_id"), "ring_size", F.round("ring_mean", 6).alias("ring_mean"),
                           F.round("ring_delta", 6).alias("ring_delta"), "changed", "held")


def stream_ring(spark, folder):
    """Ring features per user and event type over the event stream."""
    return _ring_query(spark, _samples(_event_stream(spark, folder)))


def stream_after_batch(spark, folder):
    """Ring features of the second half of the month, as a stream that goes on from a batch over the first half."""
    half = F.expr("ts >= TIMESTAMP_NTZ '2024-01-16'")
    past = _samples(table(spark, folder, "events").filter(~half))
    return _ring_query(spark, _samples(_event_stream(spark, folder).filter(half)), start=past)


def _emitted(spark, stream):
    """What an emission stream appends over all available events."""
    provider = spark.conf.get(emission.ROCKSDB[0], None)
    spark.conf.set(*emission.ROCKSDB)
    path = shared_dir(spark, "emitted")
    try:
        (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_dir(spark, "emitted-offsets"))
         .trigger(**emission.poll()).start().awaitTermination())
    finally:
        if provider is None:
            spark.conf.unset(emission.ROCKSDB[0])
        else:
            spark.conf.set(emission.ROCKSDB[0], provider)
    return spark.read.schema(stream.schema).parquet(path)


def _timed(spark, folder):
    return _event_stream(spark, folder).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
                                               F.floor(F.col("value") / 100).alias("v_num"))


def stream_on_change(spark, folder):
    """Changes of the hundreds of each user's values, up to the watermark."""
    rows = emission.on_change_stream(_timed(spark, folder).withColumn("v_num", F.col("v_num").cast("double")), ["user_id", "event_type"])
    return _emitted(spark, rows).select(F.col("seq").alias("event_id"), "v_num")


def stream_sample(spark, folder):
    """The newest event of each user and type at every day's tick, up to the watermark."""
    rows = emission.sample_stream(_timed(spark, folder).withColumn("v_num", F.col("v_num").cast("double")), ["user_id", "event_type"], DAY_NS)
    return _emitted(spark, rows).select("user_id", "event_type", F.expr("us DIV 86400000000").alias("day"), F.col("seq").alias("event_id"))


QUERIES = {f.__name__: f for f in (stream_trust, stream_strict, stream_requests, stream_ring, stream_after_batch, stream_on_change, stream_sample)}

RING = """WITH f AS (
        SELECT ts, event_id, count(*) OVER r AS ring_size, round(avg(value) OVER r, 6) AS ring_mean,
               round(value - first_value(value) OVER r, 6) AS ring_delta, value IS DISTINCT FROM lag(value) OVER w AS changed,
               count(*) OVER h = 5 AND max(value) OVER h < 50 AS held
        FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id),
             r AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
             h AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
# The watermark is the newest whole millisecond less a minute.
UPTO = """WITH mark AS (SELECT (epoch_us(max(ts)) // 1000 - 60000) * 1000 AS upto FROM events),
        e AS (SELECT user_id, event_type, ts, event_id, floor(value / 100) AS v_num FROM events)"""

ORACLE = {
    "stream_trust": "SELECT user_id AS id, round_even(avg(value / 100), 4) AS trust_index, count(*) AS counter FROM events GROUP BY 1",
    "stream_requests": """
        WITH s AS (SELECT o_custkey AS id, round_even(avg(o_totalprice / 1e6), 4) AS trust_index FROM orders GROUP BY 1),
        q AS (SELECT event_id AS request_id, user_id AS id FROM events WHERE event_type = 'signup'
              UNION SELECT event_id, event_id FROM events WHERE event_type = 'signup')
        SELECT request_id, id, trust_index FROM q JOIN s USING (id) WHERE id IN (SELECT c_custkey FROM customer)""",
    "stream_strict": SERIES["trust_strict"],
    "stream_ring": f"{RING} SELECT * EXCLUDE (ts) FROM f",
    "stream_after_batch": f"{RING} SELECT * EXCLUDE (ts) FROM f WHERE ts >= TIMESTAMP '2024-01-16'",
    "stream_on_change": f"""{UPTO}, c AS (SELECT *, v_num IS DISTINCT FROM lag(v_num) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS changed FROM e)
        SELECT event_id, v_num FROM c, mark WHERE changed AND epoch_us(ts) <= upto""",
    "stream_sample": f"""{UPTO}, d AS (SELECT *, ceil(epoch_us(ts) / 86400000000.0)::BIGINT AS day FROM e, mark WHERE epoch_us(ts) <= upto),
        s AS (SELECT user_id, event_type, min(day) AS first FROM d GROUP BY 1, 2),
        g AS (SELECT user_id, event_type, unnest(range(first, upto // 86400000000 + 1)) AS day FROM s, mark)
        SELECT g.user_id, g.event_type, g.day, arg_max(d.event_id, (d.ts, d.event_id)) AS event_id FROM g JOIN d
        ON g.user_id = d.user_id AND g.event_type = d.event_type AND d.day <= g.day GROUP BY 1, 2, 3""",
}
