"""Preorder, document parts and prefix sums against plain walks."""

import json
import random

from pyspark.sql import functions as F

from trustloom.functions.skew import prefix_sums
from trustloom.operators import graph
from trustloom.sources import writers


def forest(seed=1):
    draw = random.Random(seed)
    names = {}
    for host in ("h1", "h2"):
        own = [f"/node[name={host}]"]
        for i in range(200):
            parent = own[0] if draw.random() < 0.5 else draw.choice(own)
            own.append(f"{parent}/x[name={draw.randrange(10**6)}]")
        names[host] = sorted(set(own))
    return names


def nodes_of(spark, names):
    return graph.describe_nodes(spark.createDataFrame([(h, n) for h, own in names.items() for n in own], "host string, fullname string"))


def test_prefix_sums_over_ranges(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.randrange(200), draw.randrange(9)) for _ in range(600)]
    got = prefix_sums(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"], F.col("v"), "before", parts=7).collect()
    for key in ("hot", "a", None):
        own = sorted((r["before"], r["before"] + r["v"], r["o"]) for r in got if r["k"] == key)
        assert own[0][0] == 0 and sorted(r["o"] for r in got if r["k"] == key) == [o for _, _, o in sorted(own, key=lambda x: (x[2], x[0], x[1]))]
        ordered = sorted((r for r in got if r["k"] == key), key=lambda r: (r["o"], r["before"], r["before"] + r["v"]))
        total = 0
        for r in ordered:
            assert r["before"] == total
            total += r["v"]


def test_preorder_is_a_walk(spark):
    names = forest()
    got = {(r["host"], r["fullname"]): (r["position"], r["size"], r["depth"]) for r in graph.preorder(nodes_of(spark, names)).collect()}
    want = {}
    for host, own in names.items():
        children = {}
        for n in own:
            children.setdefault(n.rsplit("/", 1)[0], []).append(n)

        def walk(n, at, depth):
            size = 1
            for child in sorted(children.get(n, [])):
                size += walk(child, at + size, depth + 1)
            want[host, n] = (at, size, depth)
            return size
        walk(own[0], 0, 0)
    assert got == want
    assert graph.preorder(nodes_of(spark, names).limit(0)).collect() == []


def test_parts_make_one_document(spark, tmp_path):
    names = forest(3)
    nodes = nodes_of(spark, names)
    scores = nodes.select("host", "fullname", (F.col("depth") * 10).alias("health_score"))
    symptoms = nodes.filter("depth = 2").select("host", F.col("fullname").alias("node"), F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("symptom_id"),
                                                F.lit(10).alias("weight"), F.lit('a "quoted" name').alias("name"), F.lit(5).alias("ts"))
    versions = nodes.select("host").distinct().select("host", F.lit(4).alias("version"), F.lit("now").alias("last_change"))
    writers.write_graph_documents(graph.document_parts(nodes, scores, symptoms, versions), str(tmp_path))
    parts = spark.read.parquet(str(tmp_path / "parts")).collect()
    manifest = {r["host"]: (r["parts"], r["chars"]) for r in spark.read.parquet(str(tmp_path / "manifest")).collect()}
    for host, own in names.items():
        texts = [r["text"] for r in sorted((r for r in parts if r["host"] == host), key=lambda r: r["part"])]
        assert [r["part"] for r in sorted((r for r in parts if r["host"] == host), key=lambda r: r["part"])] == list(range(len(texts)))
        assert manifest[host] == (len(texts), len("".join(texts))) and max(map(len, texts)) < 900
        document = json.loads("".join(texts))
        assert document["assurance-graph-version"] == 4 and [s["id"] for s in document["subservices"]] == own
        for s in document["subservices"]:
            depth = s["id"].count("/x[")
            assert s["health-score"] == depth * 10 and [x["id"] for x in s["symptoms"]] == (["s1", "s2"] if depth == 2 else [])
            assert [d["id"] for d in s["dependencies"]] == [n for n in own if n.rsplit("/", 1)[0] == s["id"]]
