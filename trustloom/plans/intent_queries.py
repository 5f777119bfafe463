"""Requirement messages rendered from the tables: tagging, services, requirements and catalogue matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import catalog, intent
from trustloom.plans.tables import table
from trustloom.session import staged
from trustloom.sources.schemas import CATALOG, ENTITIES, SERVICES, USER

# Words of the documents and conversations that stand for entities.
GAZETTEER = {"the": "middlebox", "of": "service", "and": "storage_resource", "de": "middlebox", "la": "service",
             "das": "operating_system", "in": "compute_resource", "und": "middlebox", "der": "service", "en": "qos_value"}
FORMS = sorted(GAZETTEER, key=lambda f: (-len(f), f))


def _messages(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text", intent.tag_entities(F.col("text"), GAZETTEER).alias("entities"))


def entity_tags(spark, folder):
    """All entities of all documents, over their whole texts."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(
        intent.tag_entities(F.col("text"), GAZETTEER)).alias("e"))
    return rows.groupBy("doc_id", "e.entity").agg(F.count(F.lit(1)).alias("n"))


def entity_spans(spark, folder):
    """Spans agree with the text they were cut from."""
    rows = _messages(spark, folder).select("conv_id", "turn", "text", F.posexplode("entities").alias("no", "e"))
    return rows.select("conv_id", "turn", "no", F.lower("e.value").alias("form"), (F.expr(
        "substring(text, e.start + 1, e.end - e.start)") == F.col("e.value")).alias("exact"))


def agreement_requirements(spark, folder):
    """Values of the requirement entities of every turn, as an agreement lists them."""
    tagged = intent.tag_entities(F.col("text"), {"the": "requirements", "and": "other", "de": "requirements"})
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(intent.requirement_list(tagged), "|").alias("requirements"))


def _services(spark, folder):
    return _messages(spark, folder).withColumn("services", intent.group_services(F.col("text"), F.col("entities")))


def service_grouping(spark, folder):
    return _services(spark, folder).select("conv_id", "turn", F.posexplode("services").alias("no", "s")).select(
        "conv_id", "turn", "no", F.lower("s.middlebox").alias("middlebox"), F.size("s.assets").alias("assets"),
        F.lower(F.array_join(F.transform("s.assets", lambda a: F.concat(a["type"], F.lit(":"), a["value"])), "|")).alias("list"))


def requirement_routing(spark, folder):
    return intent.route_requirements(_services(spark, folder), "conv_id", "turn").groupBy(
        "conv_id", "turn", "kind").agg(F.count(F.lit(1)).alias("n"))


def service_summary(spark, folder):
    return _services(spark, folder).select("conv_id", "turn", F.lower(intent.summary_text(F.col("services"))).alias("summary"))


def _part_services():
    """Two services per part: a named one and one without a middlebox."""
    def asset(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))
    word = F.split("p_name", " ")
    return F.array(
        F.struct(word[1].alias("middlebox"), F.array(asset("service", F.lower("p_type")), asset("storage_resource", word[0])).alias("assets")),
        F.struct(F.lit(None).cast("string").alias("middlebox"), F.array(asset("operating_system", F.col("p_brand"))).alias("assets"))).cast(SERVICES)


def feedback_annotation(spark, folder):
    text = F.concat(F.lit("Put a "), F.upper("p_name"), F.lit(" next to "), F.col("p_brand"), F.lit(" of "), F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", intent.feedback_line(text, _part_services()).alias("line"))


def _show(services):
    return F.array_join(F.transform(services, lambda s: F.concat(F.coalesce(s["middlebox"], F.lit("-")), F.lit("="), F.array_join(
        F.transform(s["assets"], lambda a: a["value"]), ","))), ";")


def add_asset(spark, folder):
    word = F.split("p_name", " ")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("use "), F.upper(word[1]))).otherwise(F.lit("nothing"))
    value = F.when(F.col("p_size") > 25, F.upper(word[0])).otherwise(F.lit("new"))
    return table(spark, folder, "part").select("p_partkey", _show(intent.add_asset(
        text, _part_services(), F.lit("service"), value)).alias("services"))


def add_middlebox(spark, folder):
    word = F.split("p_name", " ")
    text = (F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a router with "), F.col("p_brand")))
            .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a router and "), word[0])).otherwise(F.lit("none")))
    return table(spark, folder, "part").select("p_partkey", _show(intent.add_middlebox(
        text, _part_services(), F.lit("router"))).alias("services"))


def remove_value(spark, folder):
    word = F.split("p_name", " ")
    value = (F.when(F.col("p_partkey") % 4 == 0, F.upper(word[1])).when(F.col("p_partkey") % 4 == 1, word[0])
             .when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).otherwise(F.lit("absent")))
    return table(spark, folder, "part").select("p_partkey", _show(intent.remove_value(
        _part_services(), value)).alias("services"))


def feedback_parse(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", F.concat(F.lit("Add: the thing: "), F.col("p_name"), F.when(
        F.col("p_size") > 40, F.lit(": ")).otherwise(F.lit(""))).alias("text"), F.when(
        F.col("p_partkey") % 2 == 0, "middlebox").otherwise("other").alias("entity"))
    return intent.parse_feedback(rows).select("p_partkey", "feedback_entity", "feedback_value")


def confidence_gate(spark, folder):
    scores = table(spark, folder, "events").groupBy(F.col("user_id").alias("msg_id"), F.col("event_type").alias("intent")).agg(
        (F.floor(F.max("value")) / 250).alias("score"))
    return intent.confidence_gate(scores)


def _sessions(spark, folder, **cut):
    rows = table(spark, folder, "events").select("user_id", "event_id", F.expr(
        "unix_date(CAST(ts AS DATE)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts)").alias("s"))
    return intent.sessions(rows, "user_id", "s", ["s", "event_id"], **cut)


def session_120m(spark, folder):
    return _sessions(spark, folder)


def sessions_cut(spark, folder):
    """The same sessions with every user's events cut into short pieces."""
    return _sessions(spark, folder, chunk_rows=4)


def synonym_canonical(spark, folder):
    synonyms = table(spark, folder, "nation").select(F.col("n_name").alias("surface"), F.lower(F.substring("n_name", 1, 3)).alias("canonical"))
    values = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("c_name")).alias("value"))
    return intent.canonical(values, synonyms)


def signed_agreements(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.array(
        F.struct(F.lit("1").alias("id"), F.array(F.lit("x")).alias("related-ns")),
        F.struct(F.lit("4").alias("id"), F.array(F.lit("y")).alias("related-ns")))).alias("tlas"))
    signed = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), F.array(
        F.col("o_orderpriority")).alias("related_ns"))
    return intent.sign_agreements(users, signed).select("user_id", "tla_id", F.array_join("related_ns", ",").alias("ns"))


def requirement_parse(spark, folder):
    """Sizes, memory, frequency, cores and rates read from requirement texts."""
    rows = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("string").alias("n"), F.explode(F.array(
        F.concat("p_size", F.lit(" gb disk")), F.concat("p_size", F.lit("MB of RAM")), F.concat("p_size", F.lit(".5 GHz cpu")),
        F.concat("p_size", F.lit(" cores")), F.concat("p_size", F.lit(" MBps")), F.concat("p_size", F.lit(" Kbps")), F.lit("plain"))).alias("text"))
    s, c, q = catalog.parse_storage(F.col("text")), catalog.parse_compute(F.col("text")), catalog.parse_qos(F.col("text"))
    return rows.select("p_partkey", "text", s["size"].alias("size"), s["unit"].alias("unit"), c["ram_size"].alias("ram"),
                       c["freq_value"].alias("freq"), c["num_cores"].alias("cores"), q["value"].alias("rate"), q["unit"].alias("rate_unit"))


def _catalog(spark, folder):
    """One catalogue document per part with a resource, a service and an infrastructure asset."""
    word = F.split("p_name", " ")

    def asset(letter, kind, **parts):
        return F.struct(F.concat(F.lit(letter), F.col("p_partkey").cast("string")).alias("id"), F.lit(kind).alias("type"), *[
            (F.when(F.lit(name in parts), value) if name in parts else F.when(F.lit(False), value)).alias(name)
            for name, value in every.items()])
    every = {
        "virtualStorageDesc": F.array(F.struct(F.col("p_size").alias("sizeOfStorage"), F.lit("GB").alias("sizeOfStorageUnit"))),
        "swImageDesc": F.struct(F.lit("focal").alias("operatingSystemCodename"), F.concat(
            F.lower("p_type"), F.lit("-server "), F.col("p_size").cast("string"), F.lit(".04")).alias("operatingSystemVersion")),
        "serviceDesc": F.struct(word[1].alias("type"), word[0].alias("serviceSW"), F.concat(
            F.col("p_size").cast("string"), F.lit(".1")).alias("serviceVersion")),
        "infrastructureDesc": F.struct(F.struct(F.struct(
            F.col("p_size").alias("bandwidthValue"), F.lit("Gbps").alias("bandwidthUnit")).alias("bandWidth")).alias("location"))}
    doc = F.to_json(F.struct(
        F.col("p_brand").alias("provider"), F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("priceTag"),
        F.lit(0.5).alias("levelOfTrust"), F.array(
            asset("r", "resource", virtualStorageDesc=1, swImageDesc=1), asset("s", "service", serviceDesc=1),
            asset("i", "infrastructure", infrastructureDesc=1)).alias("assets")))
    parts = table(spark, folder, "part").repartition("p_partkey")  # a small file would be one task
    return parts.select(F.from_json(doc, CATALOG).alias("d")).select("d.*")


def service_facets(spark, folder):
    return catalog.service_facets(_catalog(spark, folder)).select("facet", "value")


def os_facets(spark, folder):
    return catalog.os_facets(_catalog(spark, folder)).select("facet", "value")


def _requests(spark, folder):
    """One request per supplier: storage or a named service or a system, some with a rate."""
    n = F.col("s_suppkey") % 50 + 1

    def need(kind, before, after):
        return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), n.cast("string"), F.lit(after)).alias("requirement"))
    turn = F.col("s_suppkey") % 4
    first = (F.when(turn == 0, need("storage", "", " GB")).when(turn == 1, need("service", "a RED widget ", ".1"))
             .when(turn == 2, need("os", "economy server ", ".04")).otherwise(need("storage", "", " TB")))
    rate = need("qos", "", " Gbps")
    both = F.when(F.col("s_suppkey") % 3 == 0, F.array(first, rate)).otherwise(F.array(first))
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("request_id"), F.explode(both).alias("r")).select(
        "request_id", "r.kind", "r.requirement")


def _keys_and_assets(docs, requests):
    facets = catalog.service_facets(docs).unionByName(catalog.os_facets(docs))
    return staged(catalog.requirement_keys(requests, facets), "keys"), staged(catalog.asset_facts(docs), "assets")


def _open_requests(spark, folder):
    """Every fifth request has a text without any requirement."""
    return _requests(spark, folder).withColumn("requirement", F.when(F.col("request_id") % 5 == 0, "anything").otherwise(F.col("requirement")))


def catalog_match(spark, folder):
    docs = staged(_catalog(spark, folder), "catalog")
    wanted, assets = _keys_and_assets(docs, _requests(spark, folder))
    sets = catalog.request_sets(wanted.filter("request_id IS NOT NULL"))
    rows = catalog.per_request(catalog.result_rows(catalog.set_documents(sets, assets), docs), sets)
    return rows.select("request_id", "doc_id", "resource_id", "provider", "infrastructure_id", "price_tag")


def availability(spark, folder):
    requests = _requests(spark, folder)
    wanted, assets = _keys_and_assets(staged(_catalog(spark, folder), "catalog"), requests)
    return intent.availability(requests, catalog.match_sizes(wanted, assets))


def availability_open(spark, folder):
    """Availability with open requests: the whole catalogue answers them."""
    docs, requests = staged(_catalog(spark, folder), "catalog"), _open_requests(spark, folder)
    wanted, assets = _keys_and_assets(docs, requests)
    return intent.availability(requests, catalog.answer_sizes(wanted, assets, docs))


def catalog_match_open(spark, folder):
    """All answers, the whole catalogue for every open request."""
    docs = staged(_catalog(spark, folder), "catalog")
    wanted, assets = _keys_and_assets(docs, _open_requests(spark, folder))
    sets = catalog.request_sets(wanted)
    matches = catalog.set_documents(sets.filter("request_id IS NOT NULL"), assets).unionByName(catalog.open_documents(sets, docs))
    rows = catalog.per_request(catalog.result_rows(matches, docs), sets.filter("request_id IS NOT NULL OR size(needs) = 0"))
    return rows.select("request_id", "doc_id", "resource_id", "price_tag")


QUERIES = {f.__name__: f for f in (
    entity_tags, entity_spans, agreement_requirements, service_grouping, requirement_routing, service_summary, feedback_annotation, add_asset,
    add_middlebox, remove_value, feedback_parse, confidence_gate, session_120m, sessions_cut, synonym_canonical, signed_agreements,
    requirement_parse, service_facets, os_facets, catalog_match, catalog_match_open, availability, availability_open)}

WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
LIST = "[" + ", ".join(f"'{f}'" for f in FORMS) + "]"
FOUND = f"list_filter({WORDS}, lambda w: list_contains({LIST}, lower(w)))"
KIND = "CASE lower(m) " + " ".join(f"WHEN '{f}' THEN '{GAZETTEER[f]}'" for f in FORMS) + " END"
CONV = f"""WITH t AS (SELECT conv_id, turn, {FOUND} AS ms FROM conversations),
    e AS (SELECT conv_id, turn, CAST(i AS INTEGER) - 1 AS no, lower(ms[i]) AS form, {KIND.replace('lower(m)', 'lower(ms[i])')} AS entity
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM t)),
    g AS (SELECT *, sum(CASE WHEN entity = 'middlebox' OR no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY no) - 1 AS grp FROM e),
    s AS (SELECT conv_id, turn, CAST(grp AS INTEGER) AS no, max(form) FILTER (entity = 'middlebox') AS middlebox,
                 CAST(count(*) FILTER (entity <> 'middlebox') AS INTEGER) AS assets,
                 coalesce(string_agg(entity || ':' || form, '|' ORDER BY no) FILTER (entity <> 'middlebox'), '') AS list,
                 coalesce(string_agg(chr(10) || '    - ' || entity || ': ' || form, '' ORDER BY no) FILTER (entity <> 'middlebox'), '') AS lines
          FROM g GROUP BY 1, 2, 3)"""
PART = """WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"""
CAT = """WITH doc AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size AS n, split_part(p_name, ' ', 1) AS sw, split_part(p_name, ' ', 2) AS tp,
                        lower(p_type) AS os, p_brand FROM part),
    r AS (SELECT s_suppkey AS request_id, s_suppkey % 50 + 1 AS n, s_suppkey % 4 AS kind, s_suppkey % 3 = 0 AS rate FROM supplier),
    m AS (SELECT request_id, doc_id, doc.n, p_brand FROM r JOIN doc ON
          CASE kind WHEN 0 THEN r.n = doc.n
               WHEN 1 THEN tp = 'widget' AND sw = 'red' AND contains(doc.n || '.1', r.n || '.1')
               WHEN 2 THEN os = 'economy' AND contains(doc.n || '.04', r.n || '.04') ELSE false END
          AND (NOT rate OR r.n = doc.n))"""

ORACLE = {
    "entity_tags": f"""
        WITH t AS (SELECT doc_id, unnest({FOUND}) AS m FROM documents)
        SELECT doc_id, {KIND} AS entity, count(*) AS n FROM t GROUP BY 1, 2""",
    "agreement_requirements": f"""
        SELECT conv_id, turn, array_to_string(list_filter({WORDS}, lambda w: lower(w) IN ('the', 'de')), '|') AS requirements FROM conversations""",
    "entity_spans": f"{CONV} SELECT conv_id, turn, no, form, true AS exact FROM e",
    "service_grouping": f"{CONV} SELECT conv_id, turn, no, middlebox, assets, list FROM s",
    "requirement_routing": f"""{CONV} SELECT conv_id, turn, CASE entity WHEN 'storage_resource' THEN 'storage' WHEN 'compute_resource' THEN 'compute'
            WHEN 'operating_system' THEN 'os' WHEN 'qos_value' THEN 'qos' ELSE 'service' END AS kind, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "service_summary": f"""{CONV}, l AS (SELECT conv_id, turn, string_agg('middlebox ' || (no + 1) || ': ' || coalesce(middlebox, 'unknown middlebox') ||
            CASE WHEN assets > 0 THEN chr(10) || '  using assets:' || lines ELSE '' END, chr(10) || chr(10) ORDER BY no) AS summary FROM s GROUP BY 1, 2)
        SELECT c.conv_id, c.turn, coalesce(summary, '') AS summary FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn""",
    "feedback_annotation": f"""{PART} SELECT p_partkey, '- Put a [' || upper(a) || '](' || CASE WHEN lower(p_type) = a THEN 'service' ELSE 'storage_resource' END || ') [' || upper(b) || '](middlebox) next to [' ||
            p_brand || '](operating_system) of [' || p_type || '](service)' AS line FROM p""",
    "add_asset": f"""{PART}, v AS (SELECT *, CASE WHEN p_size > 25 THEN upper(a) ELSE 'new' END AS x FROM p)
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size <= 25 AND a <> 'new' THEN b || '=' || lower(p_type) || ',' || a || ',new;-=' || p_brand
               ELSE b || '=' || lower(p_type) || ',' || a || ';-=' || p_brand || ',' || x END AS services FROM v""",
    "add_middlebox": f"""{PART} SELECT p_partkey, b || '=' || lower(p_type) || ',' || a || ';' || CASE p_partkey % 3 WHEN 0 THEN 'router=' || p_brand
               WHEN 1 THEN '-=' || p_brand || ';router=' || a || CASE WHEN lower(p_type) = a THEN ',' || a ELSE '' END ELSE '-=' || p_brand END AS services FROM p""",
    "remove_value": f"""{PART} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-=' || p_brand WHEN 1 THEN b || '=' || lower(p_type) || ';-=' || p_brand
               WHEN 2 THEN b || '=' || lower(p_type) || ',' || a || ';-=' ELSE b || '=' || lower(p_type) || ',' || a || ';-=' || p_brand END AS services FROM p""",
    "feedback_parse": "SELECT p_partkey, 'middlebox' AS feedback_entity, p_name AS feedback_value FROM part WHERE p_partkey % 2 = 0 AND p_size <= 40",
    "confidence_gate": """
        WITH s AS (SELECT user_id AS msg_id, event_type AS intent, floor(max(value)) / 250 AS score FROM events GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s
              WINDOW w AS (PARTITION BY msg_id ORDER BY score DESC, intent DESC))
        SELECT msg_id, CASE WHEN score < 0.5 OR coalesce(score - second, 1.0) < 0.1 THEN 'fallback' ELSE intent END AS intent, score FROM r WHERE n = 1""",
    "session_120m": """
        WITH e AS (SELECT user_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events),
        m AS (SELECT *, CASE WHEN s - lag(s) OVER w < 7200 THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
        n AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS session_no FROM m)
        SELECT user_id, session_no, min(s) AS start_s, max(s) AS end_s, count(*) AS n FROM n GROUP BY 1, 2""",
    "synonym_canonical": """
        SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE c_name END AS value,
               CASE WHEN c_custkey % 2 = 0 THEN lower(n_name[1:3]) ELSE c_name END AS canonical
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "signed_agreements": """
        SELECT o_custkey AS user_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) +
               CASE WHEN o_custkey % 2 = 0 THEN 4 ELSE 0 END AS VARCHAR) AS tla_id, o_orderpriority AS ns
        FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
    "requirement_parse": """
        WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n, p_size AS i FROM part)
        SELECT p_partkey, n || ' gb disk' AS text, n AS size, 'GB' AS unit, CAST(i AS BIGINT) AS ram, NULL::DOUBLE AS freq, NULL::BIGINT AS cores,
               NULL::BIGINT AS rate, NULL AS rate_unit FROM p
        UNION ALL SELECT p_partkey, n || 'MB of RAM', n, 'MB', i, NULL, NULL, NULL, NULL FROM p
        UNION ALL SELECT p_partkey, n || '.5 GHz cpu', NULL, NULL, NULL, i + 0.5::DOUBLE, NULL, NULL, NULL FROM p
        UNION ALL SELECT p_partkey, n || ' cores', NULL, NULL, NULL, NULL, CASE WHEN i > 0 THEN i END, NULL, NULL FROM p
        UNION ALL SELECT p_partkey, n || ' MBps', n, 'MB', i, NULL, NULL, i * 8, 'Mbps' FROM p
        UNION ALL SELECT p_partkey, n || ' Kbps', n, 'KB', i, NULL, NULL, i, 'Kbps' FROM p
        UNION ALL SELECT p_partkey, 'plain', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p""",
    "service_facets": """SELECT DISTINCT 'type' AS facet, split_part(p_name, ' ', 2) AS value FROM part
        UNION ALL SELECT DISTINCT 'software', split_part(p_name, ' ', 1) FROM part""",
    "os_facets": """SELECT DISTINCT 'distro' AS facet, lower(p_type) AS value FROM part UNION ALL SELECT 'flavor', 'server'
        UNION ALL SELECT 'codename', 'focal'""",
    "catalog_match": f"""{CAT} SELECT request_id, doc_id, 'r' || doc_id AS resource_id, p_brand AS provider, 'i' || doc_id AS infrastructure_id,
               CAST(n AS VARCHAR) AS price_tag FROM m""",
    "catalog_match_open": f"""{CAT} SELECT request_id, doc_id, 'r' || doc_id AS resource_id, CAST(n AS VARCHAR) AS price_tag FROM m WHERE request_id % 5 <> 0
        UNION ALL SELECT s_suppkey, CAST(p_partkey AS VARCHAR), 'r' || p_partkey, CAST(p_size AS VARCHAR) FROM supplier, part WHERE s_suppkey % 5 = 0""",
    "availability_open": f"""{CAT}, c AS (SELECT request_id, count(*) AS k FROM m GROUP BY 1)
        SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 5 = 0 THEN (SELECT count(*) FROM part) ELSE coalesce(k, 0) END AS matches,
               s_suppkey % 5 = 0 OR k IS NOT NULL AS available FROM supplier LEFT JOIN c ON request_id = s_suppkey""",
    "availability": f"""{CAT}, c AS (SELECT request_id, count(*) AS k FROM m GROUP BY 1)
        SELECT s_suppkey AS request_id, coalesce(k, 0) AS matches, k IS NOT NULL AS available FROM supplier LEFT JOIN c ON request_id = s_suppkey""",
}
ORACLE["sessions_cut"] = ORACLE["session_120m"]
