"""Readers and writers that no query uses: small files of every kind."""

import json

from pyspark.sql import functions as F

from trustloom.operators import flatten, normalize, recommend, rules
from trustloom.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_metric_catalogue_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,subservice,type,is_list,unit,counter\nfree,mem,int,0,MB,\nfree,mem,float,0,GB,1\nfree,disk,str,0,,0\nbad,mem,list,0,,\n,mem,int,0,,\n")
    catalog = readers.metric_catalog_csv(spark, str(tmp_path / "m.csv"))
    assert rows(catalog.select("subservice", "name", "type", "unit", "counter")) == [("disk", "free", "str", None, 0), ("mem", "free", "float", "GB", 1)]
    assert rows(normalize.metric_types(catalog).select("name", "type")) == [("free", "str")]


def test_rule_and_query_files(spark, tmp_path):
    (tmp_path / "corpus.csv").write_text("id,name,rule\nr1,Low,free<50\n")
    (tmp_path / "catalog.csv").write_text('id,name,path,severity,rule\nr1,Link,/node/bm,Red,"(state==""up"") and (a>1)"\n')
    (tmp_path / "queries.csv").write_text('query,rule_ids\n"fast, please",r1;r2\nnothing,None\n')
    (tmp_path / "phrases.json").write_text('["packet loss", "high load"]')
    assert rows(readers.rule_corpus_csv(spark, str(tmp_path / "corpus.csv"))) == [("r1", "Low", "free<50")]
    catalog = readers.rule_catalog_csv(spark, str(tmp_path / "catalog.csv"))
    assert rows(catalog) == [("r1", "Link", "/node/bm", "Red", '(state=="up") and (a>1)')]
    assert rows(rules.clause_table(catalog.drop("id")).select("metric", "valid")) == [("a", True), ("state", True)]
    queries = readers.labelled_queries_csv(spark, str(tmp_path / "queries.csv"))
    assert rows(queries.select("query", recommend.label_set(F.col("rule_ids")))) == [("fast, please", ["r1", "r2"]), ("nothing", [])]
    assert rows(readers.phrases_json(spark, str(tmp_path / "phrases.json"))) == [("high load",), ("packet loss",)]


def test_envelopes_in_batch_and_stream(spark, tmp_path):
    envelope = {"update": {"timestamp": "5", "update": [
        {"path": {"elem": [{"name": "health"}, {"name": "node", "key": {"name": "n1"}}]}, "val": {"intVal": "7"}},
        {"path": {"elem": [{"name": "x"}]}, "val": {"stringVal": "up"}}]}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(envelope) + "\n" + json.dumps({"update": {"timestamp": "6"}}) + "\n")
    batch = flatten.explode_envelope(readers.envelopes(spark, str(tmp_path / "in")))
    assert rows(batch.select("timestamp", "keyed_path", "value")) == [("5", "/health/node[name=n1]", "7"), ("5", "/x", "up")]
    stream = flatten.explode_envelope(readers.envelope_stream(spark, str(tmp_path / "in"))).select("timestamp", "keyed_path", "value")
    (stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
     .trigger(availableNow=True).start().awaitTermination())
    assert rows(spark.read.schema(stream.schema).json(str(tmp_path / "out"))) == rows(batch.select("timestamp", "keyed_path", "value"))


def test_requests_and_wide_scores(spark, tmp_path):
    lines = spark.createDataFrame([('{"ids": ["a", "b"]}',), ("no request",), ('{"ids": null}',)], "value string")
    got = {r["ids"] and tuple(r["ids"]) for r in readers.request_stream(lines).collect()}
    assert got == {("a", "b"), None} and readers.request_stream(lines).select("request_id").distinct().count() == 3
    (tmp_path / "scores.csv").write_text("ID,Timestamp,CPUs,Sensors,Mem,Proc,Disks,Nets\nd1,t,90,0,80,70,0,60\n")
    assert rows(readers.wide_scores_csv(spark, str(tmp_path / "scores.csv"))) == [("d1", "t", 90, 0, 80, 70, 0, 60)]


def test_topic_rows_become_snapshots(spark):
    topic = spark.createDataFrame([(0, 4, bytearray(b'{"id": "d", "timestamp": "9", "data": {"/health/node/x": 5}}')), (1, 2, bytearray(b"{broken"))],
                                  "partition int, offset long, value binary")
    got = readers.topic_snapshots(topic).select("partition", "offset", "id", "data", F.col("malformed").isNotNull())
    assert rows(got) == [(0, 4, "d", {"/health/node/x": "5"}, False), (1, 2, None, None, True)]


def test_snapshots_are_written_by_a_stream_and_read_back(spark, tmp_path):
    first = spark.createDataFrame([("d", "1", {"a": "b}c"})], "id string, timestamp string, data map<string,string>")
    writers.append_snapshots(first, str(tmp_path / "land"))
    stream = spark.readStream.schema(first.schema).json(str(tmp_path / "land"))
    writers.stream_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(readers.snapshot_file(spark, str(tmp_path / "out"))) == [("d", "1", {"a": "b}c"})]


def test_logs_and_feedback_grow(spark, tmp_path):
    log = spark.createDataFrame([("n1", "Low")], "node string, activated_rule string")
    for _ in range(2):
        writers.append_log(log, str(tmp_path / "log"))
        writers.append_feedback(spark.createDataFrame([("- use [x](service)",)], "value string"), str(tmp_path / "feedback"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "log"))) == [("n1", "Low")] * 2
    assert rows(spark.read.text(str(tmp_path / "feedback"))) == [("- use [x](service)",)] * 2


def test_loading_a_graph_twice_repeats_no_uri(spark, tmp_path):
    nodes = spark.createDataFrame([("u1", ["A"]), ("u2", ["B"])], "uri string, labels array<string>")
    edges = spark.createDataFrame([("u1", "r", "u2")], "src string, rel string, dst string")
    more = spark.createDataFrame([("u2", ["C"]), ("u3", ["C"]), ("u3", ["C"])], "uri string, labels array<string>")
    writers.load_graph(nodes, edges, str(tmp_path / "g"))
    writers.load_graph(more, edges, str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g" / "kg_nodes"))) == [("u1", ["A"]), ("u2", ["B"]), ("u3", ["C"])]
    assert rows(spark.read.parquet(str(tmp_path / "g" / "kg_edges"))) == [("u1", "r", "u2")]
    writers.load_graph(more, edges.limit(0), str(tmp_path / "g"), replace=True)
    assert rows(spark.read.parquet(str(tmp_path / "g" / "kg_nodes")).select("uri")) == [("u2",), ("u3",)]
