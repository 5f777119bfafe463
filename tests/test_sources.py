"""Readers and writers on small hand-made files."""

import json

from pyspark.sql import functions as F

from trustloom.operators import catalog, intent, knowledge, recommend, rules, trust
from trustloom.sources import readers, writers


def test_rules_csv(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('name,path,severity,rule,\n"A (x)",/node/bm/mem,Orange,free<50\n'
                                        '"B",/node/bm/net/if,Red,(state=="up") and (gw_in_arp==0)\n"C",/p,Purple,a>1\n')
    rows = {r["name"]: (r["severity"], r["rule"]) for r in readers.rules_csv(spark, str(tmp_path / "rules.csv")).collect()}
    assert rows == {"A (x)": ("ORANGE", "free<50"), "B": ("RED", '(state=="up") and (gw_in_arp==0)')}


def test_shipped_rules_all_become_clauses(spark):
    clauses = rules.clause_table(rules.rule_table(spark))
    assert clauses.filter("NOT valid").count() == 0
    assert clauses.select("rule_id").distinct().count() == 39
    by_name = {}
    for r in clauses.collect():
        by_name.setdefault(r["name"], []).append((r["role"], r["metric"], r["dynamicity"], r["n"], r["op"], r["rhs_num"], r["rhs_str"], r["transform"]))
    assert sorted(by_name["Sensor reached maximum temperature"])[1][:2] == ("r", "max_temp")
    assert [x[:2] + (x[7],) for x in sorted(by_name["Low Buffer Availability"])] == [("a", "buffer_free", "/"), ("b", "buffer_total", "/")]
    long = [n for n in by_name if n.startswith("Average process")][0]
    assert {x[1:4] for x in by_name[long]} == {("sleep_count", True, 20), ("run_count", True, 20)}
    assert by_name["No CPU idle time for 5 min"][0][1:6] == ("idle_time", False, 100, "<=", 1.0)
    assert {x[6] for x in by_name["No ARP Entry For Default Gateway"]} == {"up", None}


def test_catalog_users_and_match(spark, tmp_path):
    doc = {"provider": "P", "id": "n1", "priceTag": 6, "levelOfTrust": 0.7, "assets": [
        {"id": "r1", "type": "resource", "virtualStorageDesc": [{"sizeOfStorage": 500, "sizeOfStorageUnit": "GB"}],
         "swImageDesc": {"operatingSystemCodename": "Focal", "operatingSystemVersion": "Ubuntu-server 20.04"},
         "virtualComputeDesc": [{"virtualMemory": {"virtualMemSize": 8, "virtualMemSizeUnit": "GB"}, "virtualCpu": [{"numCore": 4}]}]},
        {"id": "s1", "type": "service", "serviceDesc": {"type": "firewall", "serviceSW": "snort", "serviceVersion": "2.9"}},
        {"id": "i1", "type": "infrastructure", "infrastructureDesc": {"location": {"bandWidth": {"bandwidthValue": 8, "bandwidthUnit": "Gbps"}}}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"id": "n2", "provider": "Q"}))
    docs = readers.catalog_documents(spark, str(tmp_path))
    facets = catalog.service_facets(docs).unionByName(catalog.os_facets(docs))
    assert {(r["facet"], r["value"], r["distro"]) for r in facets.collect()} == {
        ("type", "firewall", None), ("software", "snort", None), ("distro", "ubuntu", None), ("flavor", "server", None), ("codename", "focal", "ubuntu")}
    asks = spark.createDataFrame([
        (1, "storage", "500 gb of disk"), (2, "storage", "1 TB"), (3, "compute", "8GB RAM"), (4, "compute", "4 cores"), (5, "service", "Snort 2.9 firewall"),
        (6, "service", "snort 3"), (7, "os", "ubuntu server 20.04"), (8, "os", "focal"), (9, "os", "ubuntu 22.04"), (10, "qos", "1GBps"), (11, "qos", "8 Gbps"),
        (12, "storage", "500 GB"), (12, "qos", "9 Gbps"), (13, "storage", "1 TB"), (13, "compute", "4 cores"), (14, "service", "nothing known")],
        "request_id int, kind string, requirement string")
    wanted = catalog.requirement_keys(asks, facets)
    matches = catalog.match_documents(wanted, catalog.asset_facts(docs))
    assert sorted(r["request_id"] for r in matches.collect()) == [1, 3, 4, 5, 7, 8, 10, 11, 13]
    assert [r["request_id"] for r in catalog.unfiltered_requests(wanted).collect()] == [14]
    assert {(r["request_id"], r["doc_id"]) for r in catalog.whole_answers(wanted, docs, pages=3).collect()} == {(14, "n1"), (14, "n2")}
    row = catalog.result_rows(matches.filter("request_id = 1"), docs).first()
    assert (row["resource_id"], row["infrastructure_id"], row["price_tag"]) == ("r1", "i1", "6")
    (tmp_path / "users").mkdir()
    (tmp_path / "users" / "u.json").write_text(json.dumps({"id": "u", "levelOfTrust": 0.5, "tlas": [{"id": "3", "related-ns": ["a"]}]}))
    users = readers.user_documents(spark, str(tmp_path / "users"))
    signed = spark.createDataFrame([("u", ["n1"])], "user_id string, related_ns array<string>")
    assert [t["id"] for t in intent.with_agreement(users, signed).first()["tlas"]] == ["3", "4"]


def test_latency_log(spark, tmp_path):
    line = "-" * 50
    text = "".join(f"[2025-03-18 13:24:47.79{i}] Stage one:\n  Start time: 13:24:46.963\n  End time: 13:24:47.799\n  Elapsed time: {i}.5 ms\n{line}\n" for i in range(4))
    (tmp_path / "log.txt").write_text(text)
    rows = readers.latency_log(spark, str(tmp_path / "log.txt"))
    assert trust.latency_stats(rows).first().asDict() == {"op": "Stage one", "n": 4, "mean_ms": 2.0, "min_ms": 0.5, "max_ms": 3.5, "median_ms": 2.0}


def test_snapshots_and_concepts(spark, tmp_path):
    messages = [{"id": "a", "timestamp": "5", "data": {"/health/node/trust_index": 80.0}}, {"id": "a", "timestamp": "9", "data": {"/health/node/trust_index": 60}},
                {"id": "b", "timestamp": "7", "data": {}}]
    (tmp_path / "s.json").write_text(json.dumps(messages))
    snapshots = readers.snapshot_file(spark, str(tmp_path / "s.json"))
    got = trust.trust_per_device(trust.scores_from_snapshots(snapshots, 1, 8)).collect()
    assert [tuple(r) for r in got] == [("a", 0.8, 1)]
    writers.append_snapshots(snapshots, str(tmp_path / "out"))
    writers.append_snapshots(snapshots, str(tmp_path / "out"))
    assert readers.snapshot_lines(spark, str(tmp_path / "out")).filter("malformed IS NULL").count() == 6
    (tmp_path / "c.json").write_text(json.dumps([{"Person": {"givenName": "Jo Ann", "lastName": "Doe"}}, {"Reward": {"value": "1"}}, {"Person": {"givenName": "X"}}]))
    records = readers.concept_records(spark, str(tmp_path / "c.json"))
    rows = knowledge.triples(records, knowledge.mapping_table(spark), "http://b/").unionByName(knowledge.fixed_instances(spark, "http://b/"))
    assert {r["s"] for r in rows.filter("p = 'rdf:type' AND o IN ('foaf:Person', 'kg:value')").collect()} == {"http://b/Person/Jo%20Ann_Doe", "http://b/Reward/1"}
    writers.load_graph(knowledge.kg_nodes(rows), knowledge.kg_edges(rows), str(tmp_path / "kg"), replace=True)
    classes = {r["o"] for r in rows.filter("p = 'rdf:type'").select("o").distinct().collect()}
    nodes = {r["uri"] for r in spark.read.parquet(str(tmp_path / "kg" / "kg_nodes")).collect()}
    assert classes <= nodes and len(nodes - classes) == 40  # classes are nodes too
    writers.write_triples(rows, {"rdf": "http://r/", "kg": "http://k/"}, str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).count() == rows.count()


def test_rule_activation_keeps_the_old_file(spark, tmp_path):
    full = spark.createDataFrame([("r1", "A", "/p", "Red", "a>1"), ("r2", "B", "/p", "Red", "b>1")], "id string, name string, path string, severity string, rule string")
    target = str(tmp_path / "active")
    assert writers.activate_rules(recommend.chosen_rules(full, full.filter("id = 'r2'")), target)
    assert not writers.activate_rules(recommend.chosen_rules(full, full.filter("id = 'zz'")), target)
    assert [r["name"] for r in readers.rules_csv(spark, target).collect()] == ["B"]


def test_dictionary_and_host_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"compute": ["processing"], "network": ["latency", "throughput"], "speed": ["latency"]}))
    lookup = {r["term"]: r["members"] for r in recommend.synonym_lookup(readers.dictionary_json(spark, str(tmp_path / "d.json"))).collect()}
    assert lookup["latency"] == ["speed", "latency"] and lookup["throughput"] == ["network", "latency", "throughput"]
    folder = tmp_path / "hosts" / "host=h1" / "ts=12" / "proc"
    folder.mkdir(parents=True)
    (folder / "uptime").write_text("5.0 9.0\n")
    row = readers.host_snapshots(spark, str(tmp_path / "hosts")).first()
    assert (row["host"], row["ts"], row["file"], row["content"]) == ("h1", 12, "/proc/uptime", "5.0 9.0\n")


def test_encoder_runs_once_per_text(spark):
    import numpy as np

    def make():
        return lambda texts: np.stack([[float(len(t)), 1.0] for t in texts])
    rows = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "ab")], "id int, text string")
    got = {r["id"]: r["vector"] for r in recommend.encode_texts(rows, make).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [2.0, 1.0]}
