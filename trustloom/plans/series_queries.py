"""Ring-buffer features and trust indexes over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions.scalar import half_even, time_bound_ns
from trustloom.operators import flatten, series, trust
from trustloom.plans.tables import event_samples, event_scores, event_ticks, table
from trustloom.sources.readers import latency_blocks

W = "PARTITION BY user_id, event_type ORDER BY ts, event_id"
RING = f"{W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW"
START, END = "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z"


def _ring(spark, folder):
    return series.ring_features(event_samples(spark, folder))


def ring_mean(spark, folder):
    return _ring(spark, folder).select(
        F.col("seq").alias("event_id"), "ring_size", "ring_mean", "ring_min", "ring_max")


def ring_mean_cut(spark, folder):
    """The same features with every series cut into short pieces, as a hot one is."""
    return series.ring_features(event_samples(spark, folder), chunk_rows=5).select(
        F.col("seq").alias("event_id"), "ring_size", "ring_mean", "ring_min", "ring_max")


def newest_cut(spark, folder):
    """The newest three samples of series that are cut into short pieces."""
    return series.newest_n(event_samples(spark, folder), 3, chunk_rows=5).select(
        "host", "metric", F.col("_rank").alias("rank"), F.col("v_num").alias("value"))


def ring_delta(spark, folder):
    return _ring(spark, folder).select(F.col("seq").alias("event_id"), "ring_delta")


def delta_back(spark, folder):
    return series.delta(event_samples(spark, folder), 5).select(
        F.col("seq").alias("event_id"), "delta")


def ring_tops(spark, folder):
    rows = series.tops(event_samples(spark, folder), 3)
    return rows.select(F.col("seq").alias("event_id"), F.concat_ws(
        ";", F.transform("tops", lambda v: F.rint(v * 100).cast("bigint").cast("string"))).alias("tops"))


def ring_changed(spark, folder):
    kinds = event_ticks(spark, folder, "kind")
    return series.ring_features(kinds, ring=5).select(
        F.col("seq").alias("event_id"), "ring_changed", "dynamicity", "change_severity")


def spike_severity(spark, folder):
    return _ring(spark, folder).select(F.col("seq").alias("event_id"), "severity", "dynamicity")


def counter_dynamicity(spark, folder):
    counters = event_ticks(spark, folder, "k")
    return series.ring_features(counters).select(
        F.col("seq").alias("event_id"), F.col("dynamicity").cast("bigint").alias("dynamicity"),
        "severity", F.col("ring_mean").cast("bigint").alias("ring_mean"))


def change_only(spark, folder):
    kinds = event_ticks(spark, folder, "kind")
    return series.change_only(kinds).select(
        F.col("seq").alias("event_id"), "host", F.col("v_str").alias("kind"))


def display_rows(spark, folder):
    counters = event_ticks(spark, folder, "k").withColumn("unit", F.lit("%"))
    return series.display_rows(series.ring_features(counters)).select(
        F.col("seq").alias("event_id"), "display_value", "display_severity",
        F.col("dynamicity").cast("bigint").cast("string").alias("display_dynamicity"),
        "display_change")


def newest_value(spark, folder):
    return series.newest(event_samples(spark, folder)).select(
        "host", "metric", F.col("seq").alias("event_id"), F.col("v_num").alias("value"))


def newest_values(spark, folder):
    return series.newest_n(event_samples(spark, folder), 3).select(
        "host", "metric", F.col("_rank").alias("rank"), F.col("v_num").alias("value"))


def metric_by_entity(spark, folder):
    samples = event_samples(spark, folder).withColumns(
        {"entity": F.col("metric"), "metric": F.lit("value")})
    return series.metric_by_entity(samples, ["click", "error", "purchase", "signup", "view"]).drop(
        "metric")


def trust_exact(spark, folder):
    return trust.trust_per_device(event_scores(spark, folder))


def trust_time_range(spark, folder):
    return trust.trust_per_device(event_scores(spark, folder, time_bound_ns(START), time_bound_ns(END)))


def trust_strict(spark, folder):
    return trust.trust_strict(event_scores(spark, folder))


def dimension_trust(spark, folder):
    wide = table(spark, folder, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("CPUs"), F.col("l_linenumber").alias("Mem"),
        F.rint(F.col("l_discount") * 100).alias("Nets"), F.lit(0).alias("Sensors"))
    return trust.dimension_trust(wide, ["CPUs", "Sensors", "Mem", "Nets"], ["l_suppkey"])


def requested_scores(spark, folder):
    orders = table(spark, folder, "orders")
    requests = orders.groupBy(F.col("o_orderdate").alias("d")).agg(
        F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).select(
        F.date_format("d", "yyyy-MM-dd").alias("request_id"), F.array("a", "b").alias("ids"))
    machines = table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("id"))
    scores = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        half_even(F.avg(F.col("o_totalprice") / 1e6), 4).alias("trust_index"))
    return trust.requested_scores(requests, machines, scores)


def machine_ids(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey", trust.machine_id(F.col("s_suppkey") + 281474976710656).alias("id"))


def latency_stats(spark, folder):
    timings = table(spark, folder, "events").select(
        F.col("event_type").alias("op"), F.col("value").alias("elapsed_ms"))
    return trust.latency_stats(timings).withColumns({
        "mean_ms": F.round("mean_ms", 6), "median_ms": F.round("median_ms", 6)})


def latency_log(spark, folder):
    """The same statistics from text blocks rendered from the events."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    blocks = table(spark, folder, "events").select(F.concat(
        F.lit("["), stamp, F.lit("] "), F.col("event_type"), F.lit(" stage:\n  Start time: "),
        F.date_format("ts", "HH:mm:ss.SSS"), F.lit("\n  End time: "),
        F.date_format("ts", "HH:mm:ss.SSS"), F.lit("\n  Elapsed time: "),
        F.col("value").cast("string"), F.lit(" ms\n")).alias("value"))
    parsed = latency_blocks(blocks)
    return parsed.groupBy("op", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("elapsed_ms").alias("max_ms"),
        F.min("start").alias("first_start"))


QUERIES = {f.__name__: f for f in (
    ring_mean, ring_mean_cut, newest_cut, ring_delta, delta_back, ring_tops, ring_changed, spike_severity, counter_dynamicity,
    change_only, display_rows, newest_value, newest_values, metric_by_entity, trust_exact,
    trust_time_range, trust_strict, dimension_trust, requested_scores, machine_ids, latency_stats,
    latency_log)}

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
USER = "PARTITION BY user_id ORDER BY ts, event_id"
USER_RING = f"{USER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW"

ORACLE = {
    "ring_mean": f"""
        SELECT event_id, count(*) OVER r AS ring_size, round_even(avg(value) OVER r, 2) AS ring_mean,
               min(value) OVER r AS ring_min, max(value) OVER r AS ring_max
        FROM events WINDOW r AS ({RING})""",
    "ring_delta": f"""
        SELECT event_id, round_even(value - first_value(value) OVER r, 2) AS ring_delta
        FROM events WINDOW r AS ({RING})""",
    "delta_back": f"""
        SELECT event_id, round_even(value - first_value(value) OVER r, 2) AS delta
        FROM events WINDOW r AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "ring_tops": f"""
        SELECT event_id, CASE WHEN c IS NULL THEN '' ELSE
               CAST(CAST(round_even(c * 100, 0) AS BIGINT) AS VARCHAR) || ';' ||
               CAST(CAST(round_even(b * 100, 0) AS BIGINT) AS VARCHAR) || ';' ||
               CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR) END AS tops
        FROM (SELECT event_id, value, lag(value) OVER w AS b, lag(value, 2) OVER w AS c
              FROM events WINDOW w AS ({W}))""",
    "ring_changed": f"""
        SELECT event_id, count(DISTINCT event_type) OVER r > 1 AS ring_changed,
               CASE WHEN count(DISTINCT event_type) OVER r > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dynamicity,
               CASE WHEN count(DISTINCT event_type) OVER r > 1 THEN 1 ELSE 0 END AS change_severity
        FROM events WINDOW r AS ({USER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "spike_severity": f"""
        SELECT event_id, CASE WHEN value > m * 10 THEN 2 WHEN value > m * 3 THEN 1 ELSE 0 END AS severity,
               m AS dynamicity
        FROM (SELECT event_id, value, round_even(avg(value) OVER r, 2) AS m
              FROM events WINDOW r AS ({RING}))""",
    "counter_dynamicity": f"""
        SELECT event_id, k - first_value(k) OVER r AS dynamicity, 0 AS severity,
               CAST(floor(avg(k) OVER r) AS BIGINT) AS ring_mean
        FROM (SELECT *, {K} AS k FROM events) WINDOW r AS ({USER_RING})""",
    "change_only": f"""
        SELECT event_id, CAST(user_id AS VARCHAR) AS host, event_type AS kind
        FROM (SELECT *, lag(event_type) OVER ({USER}) AS p FROM events)
        WHERE p IS DISTINCT FROM event_type""",
    "display_rows": f"""
        SELECT event_id, k || ' %' AS display_value, '0' AS display_severity,
               CAST(k - first_value(k) OVER r AS VARCHAR) AS display_dynamicity, '0' AS display_change
        FROM (SELECT *, {K} AS k FROM events) WINDOW r AS ({USER_RING})""",
    "newest_value": """
        SELECT CAST(user_id AS VARCHAR) AS host, event_type AS metric, event_id, value
        FROM events QUALIFY row_number() OVER (
            PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "newest_values": """
        SELECT CAST(user_id AS VARCHAR) AS host, event_type AS metric, value,
               CAST(row_number() OVER w AS INTEGER) AS rank
        FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)
        QUALIFY row_number() OVER w <= 3""",
    "metric_by_entity": """
        SELECT CAST(user_id AS VARCHAR) AS host,
               max_by(value, ts) FILTER (event_type = 'click') AS click,
               max_by(value, ts) FILTER (event_type = 'error') AS error,
               max_by(value, ts) FILTER (event_type = 'purchase') AS purchase,
               max_by(value, ts) FILTER (event_type = 'signup') AS signup,
               max_by(value, ts) FILTER (event_type = 'view') AS view
        FROM events GROUP BY 1""",
    "trust_exact": """
        SELECT user_id AS id, round_even(avg(value / 100), 4) AS trust_index, count(*) AS counter
        FROM events GROUP BY 1""",
    "trust_time_range": """
        SELECT user_id AS id, round_even(avg(value / 100), 4) AS trust_index, count(*) AS counter
        FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
        GROUP BY 1""",
    "trust_strict": """
        SELECT user_id AS id, count(*) AS counter,
               list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(value ORDER BY ts, event_id)), lambda a, x, i:
                   CAST(format('{:.4f}', (a * (i - 2) + x / 100) / (i - 1)) AS DOUBLE)) AS trust_index
        FROM events GROUP BY 1""",
    "dimension_trust": """
        WITH m AS (SELECT l_suppkey, unnest([avg(l_quantity), avg(l_linenumber),
                          avg(round_even(l_discount * 100, 0))]) AS v FROM lineitem GROUP BY 1)
        SELECT l_suppkey, round_even(sum(v) / count(*) / 100, 4) AS trust_index,
               CAST(count(*) AS INTEGER) AS dimensions
        FROM m WHERE v <> 0 GROUP BY 1""",
    "requested_scores": """
        WITH s AS (SELECT o_custkey AS id, round_even(avg(o_totalprice / 1e6), 4) AS trust_index
                   FROM orders GROUP BY 1),
             r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS request_id, min(o_custkey) AS a,
                          max(o_custkey) AS b FROM orders GROUP BY 1),
             q AS (SELECT request_id, a AS id FROM r UNION SELECT request_id, b FROM r)
        SELECT request_id, id, trust_index FROM q JOIN s USING (id)
        WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "machine_ids": """
        WITH d AS (SELECT s_suppkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') ||
                          encode(CAST(s_suppkey + 281474976710656 AS VARCHAR))) AS h FROM supplier)
        SELECT s_suppkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
               CASE h[17:17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8'
                    WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
                    WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a'
                    ELSE 'b' END || h[18:20] || '-' || h[21:32] AS id
        FROM d""",
    "latency_stats": """
        SELECT event_type AS op, count(value) AS n, round(avg(value), 6) AS mean_ms,
               min(value) AS min_ms, max(value) AS max_ms, round(median(value), 6) AS median_ms
        FROM events GROUP BY 1""",
    "latency_log": """
        SELECT event_type || ' stage' AS op, CAST(ts AS DATE) AS day, count(*) AS n,
               max(value) AS max_ms, min(strftime(ts, '%H:%M:%S.%g')) AS first_start
        FROM events GROUP BY 1, 2""",
}
ORACLE["ring_mean_cut"], ORACLE["newest_cut"] = ORACLE["ring_mean"], ORACLE["newest_values"]
