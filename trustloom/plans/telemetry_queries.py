"""Envelopes and messages rendered from the events, flattened and decoded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions.paths import full_name
from trustloom.functions.scalar import epoch_ns, half_even, numeric_text
from trustloom.operators import flatten, trust
from trustloom.plans.tables import table
from trustloom.sources.schemas import UPDATE


def envelopes(spark, folder):
    """One telemetry envelope per event with six updates."""
    def update(names, key, json=None, number=None, text=None, real=None):
        none = F.lit(None).cast("string")
        elements = [F.struct(F.lit(n).alias("name"), (
            F.create_map(F.lit("name"), F.lit(key)) if key and i == len(names) - 1
            else F.lit(None).cast("map<string,string>")).alias("key")) for i, n in enumerate(names)]
        return F.struct(
            F.struct(F.array(*elements).alias("elem")).alias("path"),
            F.struct((none if json is None else json).alias("jsonVal"),
                     (none if number is None else number.cast("string")).alias("intVal"),
                     (none if text is None else text).alias("stringVal"),
                     (F.lit(None).cast("double") if real is None else real).alias("floatVal")).alias("val"))
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    updates = F.array(*[u.cast(UPDATE) for u in (
        update(["health", "node"], None, number=F.lit(55)),
        update(["health", "node", "cpus", "cpu"], "a/1", number=k),
        update(["health", "node", "cpus", "cpu"], "b", text=F.col("value").cast("string")),
        update(["health", "node", "mem"], None, real=F.col("value") * 2),
        update(["health", "node", "net"], None, json=F.base64(F.encode(F.col("event_type"), "UTF-8"))),
        update(["symptoms", "x"], "s"))])
    return table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("device"), F.struct(
        epoch_ns("ts").cast("string").alias("timestamp"),
        F.when(F.col("event_type") != "signup", updates).alias("update")).alias("update"))


def envelope_rows(spark, folder):
    return flatten.explode_envelope(envelopes(spark, folder), "event_id").drop("timestamp")


def snapshot_trust(spark, folder):
    rows = flatten.envelope_snapshots(envelopes(spark, folder), F.col("device"), "event_id")
    return trust.snapshot_trust(rows).select("event_id", "id", "trust_index")


def snapshot_trust_keyed(spark, folder):
    rows = flatten.envelope_snapshots(envelopes(spark, folder), F.col("device"), "event_id", collapse=False)
    return trust.snapshot_trust(trust.with_trust_entry(rows)).select("event_id", "trust_index")


def _typed_envelopes(spark, folder):
    """Envelopes whose values are JSON of every kind, a float below zero and text that only looks like a number."""
    def update(name, json=None, number=None, text=None, real=None):
        elements = [F.struct(F.lit(n).alias("name"), F.lit(None).cast("map<string,string>").alias("key")) for n in ("health", "node", name)]
        none = F.lit(None).cast("string")
        return F.struct(F.struct(F.array(*elements).alias("elem")).alias("path"), F.struct(
            (none if json is None else F.base64(F.encode(json, "UTF-8"))).alias("jsonVal"), (none if number is None else number).alias("intVal"),
            (none if text is None else text).alias("stringVal"), (F.lit(None).cast("double") if real is None else real).alias("floatVal")).alias("val"))
    user = F.col("user_id").cast("string")
    updates = F.array(*[u.cast(UPDATE) for u in (
        update("quoted", json=F.concat(F.lit('"'), user, F.lit('"'))), update("minus", json=F.lit("-1")), update("flag", json=F.lit("true")),
        update("small", json=F.lit("1e-5")), update("nested", json=F.lit('{"a": 7}')), update("broken", json=F.lit("{x")), update("bare", json=user),
        update("below", number=F.lit("-5")), update("text", text=F.lit("-3")), update("float", real=-F.col("value")))])
    return table(spark, folder, "events").select("event_id", F.struct(
        F.lit("1").alias("timestamp"), updates.alias("update")).alias("update"))


def typed_envelope_rows(spark, folder):
    """Union values of every type as text."""
    return flatten.explode_envelope(_typed_envelopes(spark, folder), "event_id").select(
        "event_id", "path", F.when(F.col("path") != "/health/node/float", F.col("value")).alias("value"))


def typed_snapshot_trust(spark, folder):
    """Trust index over values that count by their type: 1e-5, -1, true, digits and floats do, signed text does not."""
    rows = flatten.envelope_snapshots(_typed_envelopes(spark, folder), F.col("event_id"))
    return trust.snapshot_trust(rows).select(F.col("id").alias("event_id"), "trust_index", F.size(F.filter(
        F.map_values("numbers"), lambda v: v.isNotNull())).alias("numbers"))


def typed_message_trust(spark, folder):
    """Trust index of JSON messages with a signed number, a boolean, digits as text and signed text."""
    text = F.concat(F.lit('{"id": "a", "timestamp": "1", "data": {"/health/node/a": -1, "/health/node/b": true, "/health/node/c": "'),
                    F.col("user_id").cast("string"), F.lit('", "/health/node/d": "-4", "/health/node/e": '), F.col("value").cast("string"), F.lit("}}"))
    rows = table(spark, folder, "events").select("event_id", text.alias("value"))
    return trust.snapshot_trust(flatten.parse_snapshots(rows, "value", "event_id")).select("event_id", "trust_index")


def feed_routing(spark, folder):
    rows = flatten.explode_envelope(envelopes(spark, folder), "event_id")
    extra = rows.filter("pos = 0").withColumn("keyed_path", F.lit("/node[name=h]/vm[name=v]/active"))
    symptom = rows.filter("pos = 1").withColumn("keyed_path", F.lit("/node[name=h]/bm/symptoms[name=Low Fan]/severity"))
    return flatten.route_feed(rows.unionByName(extra).unionByName(symptom)).groupBy("kind", "node", "label").agg(
        F.count(F.lit(1)).alias("n"))


def _messages(spark, folder):
    """JSON health messages; errors are cut short, signups lack the index."""
    key = F.when(F.col("event_type") == "signup", "/health/node/other").otherwise("/health/node/trust_index")
    text = F.concat(F.lit('{"id": "u'), F.col("user_id").cast("string"), F.lit('", "timestamp": "'),
                    epoch_ns("ts").cast("string"), F.lit('", "data": {"'), key, F.lit('": '),
                    F.col("value").cast("string"), F.lit("}}"))
    return table(spark, folder, "events").select("event_id", F.when(
        F.col("event_type") == "error", F.substring(text, 1, 25)).otherwise(text).alias("value"))


def malformed_messages(spark, folder):
    return flatten.parse_snapshots(_messages(spark, folder), "value", "event_id").select(
        "event_id", "id", F.col("malformed").isNotNull().alias("malformed"))


def trust_from_messages(spark, folder):
    rows = flatten.parse_snapshots(_messages(spark, folder))
    return trust.trust_per_device(trust.scores_from_snapshots(rows))


def wide_score_trust(spark, folder):
    """Messages with a bare timestamp, repaired, and the trust of their dimensions."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.concat(F.lit('{"ID": "u'), F.col("user_id").cast("string"), F.lit('", "Timestamp": '), stamp,
                    F.lit(', "CPUs": '), F.floor("value").cast("string"), F.lit(', "Sensors": 0, "Mem": '),
                    F.regexp_extract("props", r'"k":\s*(\d+)', 1), F.lit("}"))
    rows = flatten.parse_wide_scores(table(spark, folder, "events").select(text.alias("value")))
    return trust.dimension_trust(rows.filter("Timestamp IS NOT NULL").fillna(0), keys=["ID"])


def numeric_texts(spark, folder):
    words = table(spark, folder, "part").select("p_partkey", F.explode(F.array(
        F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.col("p_brand"),
        F.concat(F.lit("-"), F.col("p_size").cast("string")),
        F.concat(F.col("p_size").cast("string"), F.lit("."))))
        .alias("text"))
    return words.select("p_partkey", "text", numeric_text(F.col("text")).alias("number"))


def subscribed_feeds(spark, folder):
    events = table(spark, folder, "events")
    path = F.concat(F.lit("/node[name="), F.col("user_id").cast("string"), F.lit("]"))
    feeds = {
        "metrics": events.filter("event_type = 'view'").select(path.alias("path"), F.col("event_id").alias("value")),
        "symptoms": events.filter("event_type = 'error'").select(path.alias("path"), F.col("event_id").alias("value")),
        "health": events.filter("event_type = 'click'").select(path.alias("path"), F.col("event_id").alias("value"))}
    return flatten.subscribed_feeds(feeds, ["/symptoms", "/health"])


def metric_only(spark, folder):
    samples = table(spark, folder, "events").select("event_id", F.col("event_type").alias("metric"), F.when(
        F.col("value") > 5, F.col("value")).alias("v_num"), F.lit(None).cast("string").alias("v_str"))
    catalog = table(spark, folder, "events").filter("value > 200").select(F.col("event_type").alias("name"))
    return flatten.metric_only(samples, catalog).select("event_id", "metric")


def indexed_names(spark, folder):
    """Keyed names of samples below machines and their interfaces."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("host"), F.lit("/node/vm/net/if").alias("path"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string"), F.lit(":e"), F.col("l_returnflag")).alias("entity")).distinct()
    return rows.select(full_name(F.col("host"), F.col("path"), F.col("entity")).alias("fullname"))


def score_lookup(spark, folder):
    scores = table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("id"),
                                                    F.col("event_type").alias("address")).agg(
        half_even(F.avg(F.col("value") / 100), 4).alias("trust_index"))
    return trust.score_for(scores, "7", "click").unionByName(trust.score_for(scores, "8"))


QUERIES = {f.__name__: f for f in (
    envelope_rows, snapshot_trust, snapshot_trust_keyed, typed_envelope_rows, typed_snapshot_trust, typed_message_trust, feed_routing, malformed_messages,
    trust_from_messages, wide_score_trust, numeric_texts, subscribed_feeds, metric_only, indexed_names,
    score_lookup)}

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
ORACLE = {
    "typed_envelope_rows": """
        SELECT event_id, '/health/node/' || unnest(['quoted', 'minus', 'flag', 'small', 'nested', 'broken', 'bare', 'below', 'text', 'float']) AS path,
               unnest([CAST(user_id AS VARCHAR), '-1', 'true', '1e-5', '{"a": 7}', '{x', CAST(user_id AS VARCHAR), '-5', '-3', NULL]) AS value
        FROM events""",
    "typed_snapshot_trust": """
        SELECT event_id, 6 AS numbers, round_even((user_id + user_id - 1 + 1 + 0.00001 - value) / 6, 2) AS trust_index FROM events""",
    "typed_message_trust": """
        SELECT event_id, round_even((-1 + 1 + user_id + value) / 4, 2) AS trust_index FROM events""",
    "envelope_rows": f"""
        WITH e AS (SELECT *, {K} AS k FROM events WHERE event_type <> 'signup')
        SELECT event_id, 0 AS pos, '/health/node' AS path, '/health/node' AS keyed_path, '55' AS value FROM e
        UNION ALL SELECT event_id, 1, '/health/node/cpus/cpu', '/health/node/cpus/cpu[name=a\\1]', CAST(k AS VARCHAR) FROM e
        UNION ALL SELECT event_id, 2, '/health/node/cpus/cpu', '/health/node/cpus/cpu[name=b]', CAST(value AS VARCHAR) FROM e
        UNION ALL SELECT event_id, 3, '/health/node/mem', '/health/node/mem', CAST(value * 2 AS VARCHAR) FROM e
        UNION ALL SELECT event_id, 4, '/health/node/net', '/health/node/net', event_type FROM e
        UNION ALL SELECT event_id, 5, '/symptoms/x', '/symptoms/x[name=s]', 'UNKNOWN' FROM e""",
    "snapshot_trust": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS id, round_even((value + value * 2) / 2, 2) AS trust_index
        FROM events WHERE event_type <> 'signup'""",
    "snapshot_trust_keyed": f"""
        SELECT event_id, round_even(({K} + value + value * 2) / 3, 2) AS trust_index
        FROM events WHERE event_type <> 'signup'""",
    "feed_routing": """
        WITH c AS (SELECT count(*) AS n FROM events WHERE event_type <> 'signup')
        SELECT 'score' AS kind, unnest(['/node', '/node/cpus/cpu[name=a\\1]', '/node/cpus/cpu[name=b]',
                                        '/node/mem', '/node/net']) AS node, NULL AS label, n FROM c
        UNION ALL SELECT 'symptom', '/symptoms/x[name=s]', '', n FROM c
        UNION ALL SELECT 'activity', '/node[name=h]/vm[name=v]', NULL, n FROM c
        UNION ALL SELECT 'symptom', '/node[name=h]/bm', 'Low Fan', n FROM c""",
    "malformed_messages": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN 'u' || user_id END AS id,
               event_type = 'error' AS malformed FROM events""",
    "trust_from_messages": """
        SELECT 'u' || user_id AS id, round_even(avg(value / 100), 4) AS trust_index, count(*) AS counter
        FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1""",
    "wide_score_trust": f"""
        WITH m AS (SELECT 'u' || user_id AS ID, unnest([avg(floor(value)), avg({K})]) AS v FROM events GROUP BY 1)
        SELECT ID, round_even(sum(v) / count(*) / 100, 4) AS trust_index, CAST(count(*) AS INTEGER) AS dimensions
        FROM m WHERE v <> 0 GROUP BY 1""",
    "numeric_texts": """
        WITH t AS (SELECT p_partkey, unnest([CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR), p_brand,
                          '-' || p_size, p_size || '.']) AS text FROM part)
        SELECT p_partkey, text, CASE WHEN regexp_full_match(text, '\\d+\\.?\\d*|\\.\\d+')
               THEN CAST(text AS DOUBLE) END AS number FROM t""",
    "subscribed_feeds": """
        SELECT '/node[name=' || user_id || ']' AS path, CAST(event_id AS VARCHAR) AS value,
               CASE event_type WHEN 'error' THEN 'symptoms' ELSE 'health' END AS feed
        FROM events WHERE event_type IN ('error', 'click')""",
    "metric_only": """
        SELECT event_id, event_type AS metric FROM events
        WHERE value > 5 AND event_type IN (SELECT event_type FROM events WHERE value > 200)""",
    "indexed_names": """
        SELECT DISTINCT '/node[name=' || l_suppkey || ']/vm[name=v' || l_linenumber || ']/net/if[name=e' || l_returnflag || ']' AS fullname
        FROM lineitem""",
    "score_lookup": """
        SELECT CAST(user_id AS VARCHAR) AS id, round_even(avg(value / 100), 4) AS trust_index
        FROM events WHERE (user_id = 7 AND event_type = 'click') OR user_id = 8 GROUP BY user_id, event_type""",
}
