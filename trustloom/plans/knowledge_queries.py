"""Triples, graph tables and audits over customers, orders and nations as concept records."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trustloom.functions.local import local_table
from trustloom.operators import knowledge
from trustloom.plans.tables import table

BASE = "http://example.org/"

MAPPING = """
User | User/{identifier} | kg:User | dct:identifier | reference | identifier
User | User/{identifier} | kg:User | kg:belongsTo | template | AdministrativeDomain/{belongsTo}
User | User/{identifier} | kg:User | rdfs:subClassOf | constant | kg:Person
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:trustor | reference | trustor
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:lot | reference | lot
Intent | Intent/{identifier} | icm:Intent | dct:identifier | reference | identifier
Intent | Intent/{identifier} | icm:Intent | kg:scope | reference | scope
Intent | Intent/{identifier} | icm:Intent | kg:manages | template | User/{owner}
"""


def _records(spark, folder):
    def record(**fields):
        return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
    customer = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    users = customer.select(F.lit("User").alias("concept"), record(
        identifier=F.col("c_custkey"), belongsTo=F.when(F.col("c_acctbal") > 0, F.col("n_name"))).alias("record"))
    trust = table(spark, folder, "orders").select(F.lit("LevelOfTrust").alias("concept"), record(
        trustor=F.concat(F.lit("c "), F.col("o_custkey").cast("string")), trustee=F.col("o_orderpriority"),
        lot=F.round(F.floor("o_totalprice") / 400000, 3)).alias("record"))
    intents = table(spark, folder, "orders").select(F.lit("Intent").alias("concept"), record(
        identifier=F.col("o_orderkey"), scope=F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        owner=F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))).alias("record"))
    return users.unionByName(trust).unionByName(intents)


def _triples(spark, folder):
    return knowledge.triples(_records(spark, folder), knowledge.mapping_table(spark, MAPPING), BASE)


def triples(spark, folder):
    return _triples(spark, folder)


def _mapping_lines():
    return [[part.strip() for part in line.split("|")] for line in knowledge.CONCEPT_MAPPING.strip().splitlines()]


def _concept_fields():
    """The fields that the mapping of each concept reads, in order."""
    fields: dict[str, list[str]] = {}
    for concept, subject, _, _, kind, text in _mapping_lines():
        own = fields.setdefault(concept, [])
        for name in [*re.findall(r"{([^}]*)}", subject), *([text] if kind == "reference" else re.findall(r"{([^}]*)}", text) if kind == "template" else [])]:
            if name not in own:
                own.append(name)
    return fields


def full_mapping(spark, folder):
    """Triples of all concepts of the shipped mapping and of its fixed instances; a record of every concept per customer."""
    key = F.col("c_custkey")

    def record(fields):
        entries = [x for i, name in enumerate(fields) for x in (F.lit(name), F.when((key + i) % 6 != 0, F.concat(F.lit(name), (key % 50).cast("string"))))]
        return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    records = F.array(*[F.struct(F.lit(concept).alias("concept"), record(fields).alias("record")) for concept, fields in _concept_fields().items()])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file of keys is small, its triples are not
    rows = table(spark, folder, "customer").repartition(parts, "c_custkey").select(F.explode(records).alias("r")).select("r.concept", "r.record")
    return knowledge.triples(rows, knowledge.mapping_table(spark), BASE).unionByName(knowledge.fixed_instances(spark, BASE))


def kg_nodes(spark, folder):
    out = knowledge.kg_nodes(_triples(spark, folder))
    return out.select("uri", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform(
        F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("props"))


def kg_edges(spark, folder):
    return knowledge.kg_edges(_triples(spark, folder))


def duplicate_uris(spark, folder):
    nodes = table(spark, folder, "lineitem").select(F.concat(F.lit(BASE), F.col("l_orderkey").cast("string"), F.lit("_"),
                                                             F.col("l_linenumber").cast("string")).alias("uri"))
    return knowledge.duplicate_uris(nodes).select("uri", "count")


def cardinality_audit(spark, folder):
    spec = local_table(spark, [("LevelOfTrust", "lot", "1"), ("User", "manages", "*"), ("Intent", "scope", "1")],
                       "concept STRING, relation STRING, max_cardinality STRING")
    return knowledge.cardinality_violations(_triples(spark, folder), spec)


def range_audit(spark, folder):
    return knowledge.range_violations(_triples(spark, folder)).select("s", "o")


def competency_minimum(spark, folder):
    """Intents without a manager and users without a domain."""
    rows = _triples(spark, folder)
    return knowledge.missing_relation(rows, "Intent", "manages").unionByName(knowledge.missing_relation(rows, "User", "belongsTo"))


def competency_maximum(spark, folder):
    return knowledge.multiple_relation(_triples(spark, folder), "LevelOfTrust", "lot")


def competency_chain(spark, folder):
    """Domains behind the intents: intent -> user -> domain, as counts."""
    return knowledge.related(_triples(spark, folder), ["manages", "belongsTo"]).groupBy("end").agg(F.count(F.lit(1)).alias("n"))


def ntriples_lines(spark, folder):
    prefixes = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "kg": "http://example.org/kg#", "dct": "http://purl.org/dc/terms/"}
    rows = _triples(spark, folder).filter("p IN ('kg:lot', 'kg:belongsTo')")
    return knowledge.ntriples(rows, prefixes)


QUERIES = {f.__name__: f for f in (
    full_mapping, 
    triples, kg_nodes, kg_edges, duplicate_uris, cardinality_audit, range_audit, competency_minimum, competency_maximum,
    competency_chain, ntriples_lines)}

T = """WITH u AS (SELECT 'http://example.org/User/' || c_custkey AS s, c_custkey, CASE WHEN c_acctbal > 0 THEN n_name END AS d
               FROM customer JOIN nation ON c_nationkey = n_nationkey),
    l AS (SELECT 'http://example.org/LevelOfTrust/c%20' || o_custkey || '_' || replace(o_orderpriority, ' ', '%20') AS s,
                 'c ' || o_custkey AS trustor, CAST(round(floor(o_totalprice) / 400000, 3) AS VARCHAR) AS lot FROM orders),
    i AS (SELECT 'http://example.org/Intent/' || o_orderkey AS s, o_orderkey, o_custkey, o_orderstatus FROM orders),
    t AS (SELECT s, 'rdf:type' AS p, 'kg:User' AS o, true AS o_is_iri FROM u UNION SELECT s, 'dct:identifier', CAST(c_custkey AS VARCHAR), false FROM u
    UNION SELECT s, 'kg:belongsTo', 'http://example.org/AdministrativeDomain/' || replace(d, ' ', '%20'), true FROM u WHERE d IS NOT NULL
    UNION SELECT s, 'rdfs:subClassOf', 'kg:Person', true FROM u
    UNION SELECT s, 'rdf:type', 'kg:LevelOfTrust', true FROM l UNION SELECT s, 'kg:trustor', trustor, false FROM l UNION SELECT s, 'kg:lot', lot, false FROM l
    UNION SELECT s, 'rdf:type', 'icm:Intent', true FROM i UNION SELECT s, 'dct:identifier', CAST(o_orderkey AS VARCHAR), false FROM i
    UNION SELECT s, 'kg:scope', o_orderstatus, false FROM i WHERE o_orderstatus <> 'P'
    UNION SELECT s, 'kg:manages', 'http://example.org/User/' || o_custkey, true FROM i WHERE o_custkey % 5 <> 0)"""

ORACLE = {
    "triples": f"{T} SELECT s, p, o, o_is_iri FROM t",
    "kg_edges": f"{T} SELECT DISTINCT s AS src, split_part(p, ':', 2) AS rel, o AS dst FROM t WHERE o_is_iri",
    "kg_nodes": f"""{T}, n AS (SELECT s AS uri FROM t UNION SELECT o FROM t WHERE o_is_iri),
        lab AS (SELECT s AS uri, string_agg(split_part(o, ':', 2), ',' ORDER BY o) AS labels FROM t WHERE p = 'rdf:type' GROUP BY 1),
        k AS (SELECT s AS uri, split_part(p, ':', 2) AS k, max(o) AS v FROM t WHERE NOT o_is_iri GROUP BY 1, 2),
        pr AS (SELECT uri, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM k GROUP BY 1)
        SELECT uri, coalesce(labels, '') AS labels, coalesce(props, '') AS props FROM n LEFT JOIN lab USING (uri) LEFT JOIN pr USING (uri)""",
    "duplicate_uris": """SELECT 'http://example.org/' || l_orderkey || '_' || l_linenumber AS uri, count(*) AS count FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "cardinality_audit": f"""{T} SELECT s, 'LevelOfTrust' AS label, 'lot' AS rel, count(*) AS n, 1 AS most FROM t WHERE p = 'kg:lot' GROUP BY s HAVING count(*) > 1""",
    "range_audit": f"{T} SELECT s, o FROM t WHERE p = 'kg:lot' AND NOT CAST(o AS DOUBLE) BETWEEN 0 AND 1",
    "competency_minimum": f"""{T} SELECT s FROM i WHERE o_custkey % 5 = 0 UNION ALL SELECT s FROM u WHERE d IS NULL""",
    "competency_maximum": f"{T} SELECT s, count(*) AS n FROM t WHERE p = 'kg:lot' GROUP BY s HAVING count(*) > 1",
    "competency_chain": f"""{T} SELECT b.o AS end, count(DISTINCT a.s) AS n FROM t a JOIN t b ON a.o = b.s AND a.p = 'kg:manages' AND b.p = 'kg:belongsTo' GROUP BY 1""",
    "ntriples_lines": f"""{T} SELECT '<' || s || '> <http://example.org/kg#' || split_part(p, ':', 2) || '> ' ||
        CASE WHEN o_is_iri THEN '<' || o || '>' ELSE '"' || o || '"' END || ' .' AS value FROM t WHERE p IN ('kg:lot', 'kg:belongsTo')""",
}


def _full_sql() -> str:
    """A branch per mapping line and one per class; a field is its name and a number, or missing."""
    fields, parts = _concept_fields(), []
    for concept, subject, cls, p, kind, text in [*_mapping_lines(), *{(c, s, k, knowledge.RDF_TYPE, "constant", k): 0 for c, s, k, *_ in map(tuple, _mapping_lines())}]:
        def value(name):
            return f"'{name}' || (c_custkey % 50)"

        def filled(template):
            return f"'{BASE}' || " + " || ".join(value(x[1:-1]) if x.startswith("{") else f"'{x}'" for x in re.split(r"({[^}]*})", template) if x)
        used = set(re.findall(r"{([^}]*)}", subject)) | ({text} if kind == "reference" else set(re.findall(r"{([^}]*)}", text)) if kind == "template" else set())
        there = " AND ".join(f"(c_custkey + {fields[concept].index(name)}) % 6 <> 0" for name in sorted(used))
        o = value(text) if kind == "reference" else filled(text) if kind == "template" else f"'{text}'"
        parts.append(f"SELECT {filled(subject)} AS s, '{p}' AS p, {o} AS o, {str(kind != 'reference').lower()} AS o_is_iri FROM customer WHERE {there}")
    for cls, names in knowledge.FIXED_INSTANCES.items():
        for name in names:
            parts.append(f"SELECT '{BASE}{cls}/{name}', '{knowledge.RDF_TYPE}', 'kg:{cls}', true UNION SELECT '{BASE}{cls}/{name}', '{knowledge.LABEL}', '{name}', false")
    return " UNION ".join(parts)


ORACLE["full_mapping"] = _full_sql()
