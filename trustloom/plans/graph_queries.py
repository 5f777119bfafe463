"""Dependency graph and health roll-up over the dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.functions.paths import element_keys, element_name, element_type, split_path
from trustloom.operators import graph, rules
from trustloom.plans.tables import table

CUSTOMER = "CASE WHEN c_acctbal < 0 THEN 50 WHEN c_acctbal < 5000 THEN 10 ELSE 0 END"


def _tree(spark, folder):
    """World -> regions -> nations -> customers and suppliers as node rows, with their losses."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_nationkey", F.concat(F.lit("/node[name=w]/region[name="), "r_name", F.lit("]/nation[name="),
                                "n_name", F.lit("]")).alias("place"), "r_name")

    def leaves(df, key, nation_key, kind):
        return df.join(F.broadcast(places), df[nation_key] == places["n_nationkey"]).select(
            F.concat("place", F.lit(f"/{kind}[name="), F.col(key).cast("string"), F.lit("]")).alias("fullname"))
    inner = places.select(F.explode(F.array(
        F.lit("/node[name=w]"), F.concat(F.lit("/node[name=w]/region[name="), "r_name", F.lit("]")),
        "place")).alias("fullname")).distinct()
    named = inner.unionByName(leaves(customer, "c_custkey", "c_nationkey", "customer")).unionByName(
        leaves(supplier, "s_suppkey", "s_nationkey", "supplier"))
    nodes = graph.describe_nodes(named.withColumn("host", F.lit("w")))
    lost = leaves_loss(customer, "c_custkey", "c_acctbal", "customer").unionByName(
        leaves_loss(supplier, "s_suppkey", "s_acctbal", "supplier"))
    losses = nodes.join(lost, ["type", "name"]).select("host", "fullname", "loss")
    return nodes, losses


def leaves_loss(df, key, balance, kind):
    """Points lost by each account: 50 below zero, 10 below 5000, none above."""
    b = F.col(balance)
    return df.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("name"),
                     F.when(b < 0, 50).when(b < 5000, 10).otherwise(0).alias("loss"))


def _rollup(method):
    def run(spark, folder):
        nodes, losses = _tree(spark, folder)
        return graph.rollup_scores(nodes, losses, method).select("fullname", "health_score")
    return run


def health_rollup_inactive(spark, folder):
    """Roll-up that leaves out suppliers (inactive)."""
    nodes, losses = _tree(spark, folder)
    nodes = nodes.withColumn("active", F.col("type") != "supplier")
    return graph.rollup_scores(nodes, losses).filter(
        "fullname LIKE '%nation%' AND fullname NOT LIKE '%customer%'").select("fullname", "health_score")


DEEP = ("l_returnflag", "l_linestatus", "l_shipinstruct", "year", "month", "day", "l_linenumber", "supplier")


def _deep_lines(spark, folder):
    """A tree of eight levels: flag, status, parity, year, month, day, line and supplier of the order lines."""
    d = F.col("l_shipdate")
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_orderkey") % 2).alias("l_shipinstruct"), F.year(d).alias("year"), F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"), "l_linenumber", (F.col("l_suppkey") % 3).alias("supplier"), "l_discount")
    steps = [F.concat(F.lit(f"/s{i}[name="), F.col(c).cast("string"), F.lit("]")) for i, c in enumerate(DEEP)]
    names = [F.concat(F.lit("/node[name=w]"), *steps[:i]) for i in range(len(steps) + 1)]
    nodes = graph.describe_nodes(lines.select(F.lit("w").alias("host"), F.explode(F.array(*names)).alias("fullname")).distinct())
    losses = lines.filter("l_discount > 0.08").select(F.lit("w").alias("host"), names[-1].alias("fullname"), F.lit(40).alias("loss"))
    return nodes, losses


def deep_rollup(spark, folder):
    """Roll-up of the tree of eight levels."""
    return graph.rollup_scores(*_deep_lines(spark, folder)).select("fullname", "health_score")


def graph_edges(spark, folder):
    urls = table(spark, folder, "pages").select(
        F.regexp_replace(F.regexp_replace("url", r"^https?://", "/"), r"[?#].*$", "").alias("path"))
    return graph.graph_edges(urls)


def numbered_edges(spark, folder):
    return graph.number_edges(graph_edges(spark, folder)).select("source", "target", F.col("weight").cast("bigint").alias("weight"))


def _deep_nodes(spark, folder):
    return _deep_lines(spark, folder)[0]


def preorder(spark, folder):
    """Walk of the deep tree: every node with the size of its subtree and its place."""
    return graph.preorder(_deep_nodes(spark, folder)).select("fullname", "depth", "size", "position")


def _world_symptoms(losses):
    return losses.filter("loss > 0").select("host", F.col("fullname").alias("node"), F.lit("s1").alias("symptom_id"), F.col("loss").alias("weight"),
                                            F.when(F.col("loss") > 10, "Debt").otherwise("Low balance").alias("name"), F.lit(7).alias("ts"))


def graph_document(spark, folder):
    """The world as one graph document in numbered parts: 25 nations, all customers and suppliers."""
    nodes, losses = _tree(spark, folder)
    versions = nodes.select("host").distinct().select("host", F.lit(3).alias("version"), F.lit(12).alias("last_change"))
    return graph.document_parts(nodes, graph.rollup_scores(nodes, losses), _world_symptoms(losses), versions)


def symptom_feed(spark, folder):
    _, losses = _tree(spark, folder)
    return graph.symptom_feed(_world_symptoms(losses))


def health_feed(spark, folder):
    nodes, losses = _tree(spark, folder)
    return graph.health_feed(graph.rollup_scores(nodes, losses))


def compound_nodes(spark, folder):
    nodes, _ = _tree(spark, folder)
    return graph.compound_nodes(graph.graph_nodes(nodes.select(F.col("fullname").alias("path"))))


def activity_roots(spark, folder):
    """Roll-up in which the regions of a state table are switched off."""
    nodes, losses = _tree(spark, folder)
    states = nodes.filter("type = 'region'").select("host", "fullname", (F.length("name") > 4).alias("active"))
    return graph.rollup_scores(graph.set_active(nodes, states), losses).filter("fullname NOT LIKE '%nation%'").select("fullname", "health_score")


def activation_log(spark, folder):
    """Lines of the activation log: symptoms of customers with the rule behind them and the node's new score."""
    nodes, losses = _tree(spark, folder)
    kinds = rules.rule_table(spark, "Debt | /node/customer | Red | balance<0\nLow balance | /node/customer | Orange | balance<5000")
    symptoms = _world_symptoms(losses).filter("node LIKE '%/customer[%'").withColumns({
        "path": F.lit("/node/customer"), "severity": F.when(F.col("weight") > 10, "RED").otherwise("ORANGE")})
    return rules.activated_log(symptoms, kinds, graph.rollup_scores(nodes, losses))


def graph_nodes(spark, folder):
    nodes, _ = _tree(spark, folder)
    return graph.graph_nodes(nodes.select(F.col("fullname").alias("path")))


def ancestor_active(spark, folder):
    """Customers are active if they, their nation and their region are; odd ones are switched off."""
    nodes, _ = _tree(spark, folder)
    states = nodes.filter("type = 'region' AND name LIKE 'A%' OR type = 'nation' AND length(name) > 6").select(
        F.col("fullname").alias("path"), (F.col("name") == "ASIA").alias("active"))
    return graph.effective_activity(nodes.select(F.col("fullname").alias("path")), states)


def node_colours(spark, folder):
    nodes, losses = _tree(spark, folder)
    scores = graph.rollup_scores(nodes, losses)
    rows = nodes.withColumn("active", F.col("type") != "supplier").join(scores, ["host", "fullname"])
    return graph.node_colours(rows).select("fullname", "green", "red", "grey")


def child_reconcile(spark, folder):
    """Customers of each order priority that come and go between months."""
    d = F.col("o_orderdate")
    presence = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("parent"), F.col("o_custkey").alias("child"),
        (F.year(d) * 12 + F.month(d)).alias("tick"))
    return graph.child_changes(presence, ["parent"])


def graph_version(spark, folder):
    return graph.graph_versions(child_reconcile(spark, folder), ["parent"]).select(
        F.col("last_change").cast("int").alias("last_change"), F.col("added").cast("bigint").alias("added"),
        F.col("version").cast("bigint").alias("version"))


def subservice_bags(spark, folder):
    """One JSON bag per order: its lines are dependencies, big discounts are symptoms."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_discount").alias("discount"), F.max("l_quantity").cast("int").alias("score"))
    order = F.concat(F.lit("/node[name="), F.col("l_orderkey").cast("string"), F.lit("]"))
    named = lines.select(F.col("l_orderkey").cast("string").alias("host"), F.explode(F.array(
        order, F.concat(order, F.lit("/if[name="), F.col("l_linenumber").cast("string"), F.lit("]"))))
        .alias("fullname")).distinct()
    nodes = graph.describe_nodes(named)
    scores = lines.groupBy(F.col("l_orderkey").cast("string").alias("host"), order.alias("fullname")).agg(
        F.max("score").alias("health_score"))
    symptoms = lines.filter("discount > 0.08").select(
        F.col("l_orderkey").cast("string").alias("host"), order.alias("node"), F.lit("s1").alias("symptom_id"),
        F.lit(10).alias("weight"), F.lit("Big discount").alias("name"), F.col("l_linenumber").alias("ts"))
    return graph.subservice_bags(nodes, scores, symptoms).select("fullname", "page", "bag")


def symptom_text(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("node"), F.col("event_type").alias("name"),
        F.when(F.col("value") > 50, 50).otherwise(10).alias("weight"))
    return graph.symptom_text(rows)


def category_scores(spark, folder):
    """Order containers looked up from the paths of their lines."""
    lines = table(spark, folder, "lineitem").select(F.concat(
        F.lit("/node[name=w]/supplier[name="), F.col("l_suppkey").cast("string"), F.lit("]/if[name="),
        F.col("l_linenumber").cast("string"), F.lit("]")).alias("category")).distinct()
    scores = table(spark, folder, "supplier").select(F.concat(
        F.lit("/node[name=w]/supplier[name="), F.col("s_suppkey").cast("string"), F.lit("]"))
        .alias("fullname"), (F.col("s_suppkey") % 101).cast("int").alias("health_score"))
    return graph.category_scores(lines, scores)


def build_nodes(spark, folder):
    """Node rows of users seen with event types as interfaces, containers from the template."""
    entities = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("host"), F.lit("/node/bm/net/if").alias("path"),
        F.col("event_type").alias("entity"))
    return graph.build_nodes(entities).select("host", "fullname", "path", "parent", "type", "name", "depth")


def fleet_counters(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("host"), "*")
    nodes = graph.build_nodes(events.select("host", F.lit("/node/vm").alias("path"), F.col("event_type").alias("entity")), {})
    symptoms = events.filter("value > 100").select("host")
    uptimes = events.select("host", F.col("event_id").alias("ts"), F.col("event_id").cast("double").alias("up"))
    out = graph.fleet_counters(nodes, symptoms, uptimes)
    return out.select("host", "vms", "symptoms", F.expr("CAST(extract(DAY FROM uptime) * 86400 + extract(HOUR FROM uptime) * 3600"
                      " + extract(MINUTE FROM uptime) * 60 + extract(SECOND FROM uptime) AS BIGINT)").alias("up_s"))


def path_split(spark, folder):
    """Keyed paths with slashes inside the keys, split into elements, types, names and keys."""
    path = F.concat(F.lit("/node[name="), F.col("l_suppkey").cast("string"), F.lit("]/bm/net/if[name=eth"),
                    F.col("l_linenumber").cast("string"), F.lit("/0][unit="), F.col("l_partkey").cast("string"), F.lit("]"))
    parts = split_path(F.col("path"))
    last = F.element_at(parts, -1)
    return (table(spark, folder, "lineitem").select(path.alias("path")).distinct()
            .select("path", F.size(parts).alias("n"), element_type(last).alias("type"),
                    element_name(last).alias("name"), element_keys(last)["unit"].alias("unit")))


METHOD_KEYS = {"health_rollup_quadratic": "quadratic-mean", "health_rollup_mean": "mean",
               "health_rollup_geometric": "geometric-mean", "health_rollup_harmonic": "harmonic-mean",
               "health_rollup_malus": "malus"}

QUERIES = {**{key: _rollup(method) for key, method in METHOD_KEYS.items()}, **{f.__name__: f for f in (
    health_rollup_inactive, deep_rollup, preorder, graph_document, symptom_feed, health_feed, compound_nodes, activity_roots, activation_log, graph_edges, numbered_edges, graph_nodes, ancestor_active, node_colours,
    child_reconcile, graph_version, subservice_bags, symptom_text, category_scores, build_nodes,
    fleet_counters, path_split)}}


def _loss(balance: str) -> str:
    return f"CASE WHEN {balance} < 0 THEN 50 WHEN {balance} < 5000 THEN 10 ELSE 0 END"


TREE = f"""
    WITH place AS (SELECT n_nationkey, '/node[name=w]' AS world,
                          '/node[name=w]/region[name=' || r_name || ']' AS region,
                          '/node[name=w]/region[name=' || r_name || ']/nation[name=' || n_name || ']' AS nation,
                          r_name, n_name
                   FROM nation JOIN region ON n_regionkey = r_regionkey),
    leaf AS (SELECT nation || '/customer[name=' || c_custkey || ']' AS fullname, nation, region, world,
                    'customer' AS kind, 100 - {_loss('c_acctbal')} AS s
             FROM customer JOIN place ON c_nationkey = n_nationkey
             UNION ALL
             SELECT nation || '/supplier[name=' || s_suppkey || ']', nation, region, world, 'supplier',
                    100 - {_loss('s_acctbal')}
             FROM supplier JOIN place ON s_nationkey = n_nationkey)"""

AGG = {
    "quadratic-mean": "round_even(sqrt(avg(s * s)), 0)", "mean": "round_even(avg(s), 0)",
    "geometric-mean": "CASE WHEN min(s) <= 0 THEN 0 ELSE round_even(exp(avg(ln(greatest(s, 1)))), 0) END",
    "harmonic-mean": "CASE WHEN min(s) <= 0 THEN 0 ELSE round_even(count(s) / sum(1.0 / greatest(s, 1)), 0) END",
    "malus": "greatest(0, 100 - sum(100 - s))",
}


def _levels(method: str, where: str = "true") -> str:
    agg = f"CAST({AGG[method]} AS INTEGER)"
    return f"""{TREE},
    n1 AS (SELECT p.nation AS fullname, p.region, p.world, coalesce(a.s, 100) AS s FROM place p LEFT JOIN
           (SELECT nation, {agg} AS s FROM leaf WHERE {where} GROUP BY 1) a ON a.nation = p.nation),
    n2 AS (SELECT region AS fullname, world, {agg} AS s FROM n1 GROUP BY 1, 2),
    n3 AS (SELECT world AS fullname, {agg} AS s FROM n2 GROUP BY 1),
    everything AS (SELECT fullname, s FROM leaf UNION ALL SELECT fullname, s FROM n1
            UNION ALL SELECT fullname, s FROM n2 UNION ALL SELECT fullname, s FROM n3)"""


def _deep_sql() -> str:
    names = ["'/node[name=w]'"]
    for i in range(len(DEEP)):
        names.append(f"{names[-1]} || '/s{i}[name=' || c{i} || ']'")
    columns = ("l_returnflag", "l_linestatus", "l_orderkey % 2", "year(l_shipdate)", "month(l_shipdate)", "day(l_shipdate)", "l_linenumber",
               "l_suppkey % 3")
    base = ", ".join(f"{c} AS c{i}" for i, c in enumerate(columns))
    levels = [f"l{len(DEEP)} AS (SELECT {', '.join(f'c{i}' for i in range(len(DEEP)))}, "
              f"greatest(0, 100 - 40 * count(*) FILTER (WHERE l_discount > 0.08)) AS s FROM x GROUP BY ALL)"]
    for depth in range(len(DEEP) - 1, -1, -1):
        keys = ", ".join(f"c{i}" for i in range(depth))
        levels.append(f"l{depth} AS (SELECT {keys + ', ' if keys else ''}CAST({AGG['quadratic-mean']} AS INTEGER) AS s FROM l{depth + 1}"
                      f"{' GROUP BY ' + keys if keys else ''})")
    rows = " UNION ALL ".join(f"SELECT {names[i]} AS fullname, CAST(s AS INTEGER) AS health_score FROM l{i}" for i in range(len(DEEP) + 1))
    return f"WITH x AS (SELECT {base}, l_discount FROM lineitem), {', '.join(levels)} {rows}"


ORACLE = {
    "deep_rollup": _deep_sql(),
    **{key: f"{_levels(method)} SELECT fullname, s AS health_score FROM everything"
       for key, method in METHOD_KEYS.items()},
    "health_rollup_inactive": f"""{_levels('quadratic-mean', "kind = 'customer'")}
        SELECT fullname, s AS health_score FROM everything
        WHERE fullname LIKE '%nation%' AND fullname NOT LIKE '%customer%'
        UNION ALL SELECT fullname, s FROM leaf WHERE false""".replace(
        "AND fullname NOT LIKE '%customer%'", "AND fullname NOT LIKE '%customer%'"),
    "graph_edges": """
        WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(
                          url, '^https?://', '/'), '[?#].*$', ''), '/'), lambda e: e <> '') AS e FROM pages),
        i AS (SELECT e, unnest(range(1, len(e))) AS k FROM p)
        SELECT DISTINCT '/' || array_to_string(e[1:k], '/') AS source,
               '/' || array_to_string(e[1:k + 1], '/') AS target FROM i""",
    "graph_nodes": f"""{TREE},
        f AS (SELECT fullname AS id, 'leaf' AS l, nation FROM leaf)
        SELECT id, regexp_extract(id, '.*/(\\w+)', 1) AS name, 3 AS depth, nation || 'parent' AS compound FROM f
        UNION ALL SELECT nation, 'nation', 2, '' FROM place
        UNION ALL SELECT DISTINCT region, 'region', 1, '' FROM place
        UNION ALL SELECT DISTINCT world, 'node', 0, '' FROM place""",
    "ancestor_active": f"""{TREE},
        st AS (SELECT n_nationkey, region, nation, world,
                      CASE WHEN r_name LIKE 'A%' THEN r_name = 'ASIA' ELSE true END AS ra,
                      CASE WHEN length(n_name) > 6 THEN n_name = 'ASIA' ELSE true END AS na FROM place)
        SELECT leaf.fullname AS path, ra AND na AS active FROM leaf JOIN st ON leaf.nation = st.nation
        UNION ALL SELECT nation, ra AND na FROM st
        UNION ALL SELECT DISTINCT region, ra FROM st UNION ALL SELECT DISTINCT world, true FROM st""",
    "node_colours": f"""{_levels('quadratic-mean')}
        SELECT fullname, CASE WHEN sup THEN 0 ELSE s END AS green,
               CASE WHEN sup THEN 0 ELSE 100 - s END AS red, CASE WHEN sup THEN 100 ELSE 0 END AS grey
        FROM (SELECT fullname, s, fullname LIKE '%/supplier[%' AS sup FROM everything)""",
    "child_reconcile": """
        WITH p AS (SELECT DISTINCT o_orderpriority AS parent, o_custkey AS child,
                          CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS tick FROM orders),
        l AS (SELECT max(tick) AS m FROM p)
        SELECT parent, child, tick, 'added' AS change FROM p
        WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.parent = p.parent AND q.child = p.child AND q.tick = p.tick - 1)
        UNION ALL
        SELECT parent, child, tick + 1, 'gone' FROM p, l WHERE tick < m
          AND NOT EXISTS (SELECT 1 FROM p q WHERE q.parent = p.parent AND q.child = p.child AND q.tick = p.tick + 1)""",
    "graph_version": """
        WITH f AS (SELECT o_orderpriority, o_custkey,
                          min(CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER)) AS last_change
                   FROM orders GROUP BY 1, 2),
        a AS (SELECT last_change, count(*) AS added FROM f GROUP BY 1)
        SELECT last_change, added, CAST(sum(added) OVER (ORDER BY last_change) + 1 AS BIGINT) AS version FROM a""",
    "symptom_text": """
        SELECT node, string_agg(line, '' ORDER BY line) AS symptoms
        FROM (SELECT DISTINCT user_id AS node, '<br>' || event_type || ' (' ||
                     CASE WHEN value > 50 THEN '50' ELSE '10' END || ')' AS line FROM events) GROUP BY 1""",
    "category_scores": """
        SELECT DISTINCT '/node[name=w]/supplier[name=' || l_suppkey || ']/if[name=' || l_linenumber || ']' AS category,
               CAST(s_suppkey % 101 AS INTEGER) AS health_score
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
    "subservice_bags": """
        WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, max(l_discount) AS d,
                          max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1, 2)
        SELECT '/node[name=' || o || ']' AS fullname, 0 AS page,
               '{"type":"subservice-idty","id":"/node[name=' || o || ']","subservice-parameters":{"service":"/node",' ||
               '"instance-name":"' || o || '"},"label":"/node[name=' || o || ']","health-score":' || max(q) ||
               ',"symptoms":[' || coalesce(string_agg('{"id":"s1","health-score-weight":10,"label":"Big discount",' ||
               '"start-date-time":"' || n || '"}', ',' ORDER BY n) FILTER (d > 0.08), '') || '],"dependencies":[' ||
               string_agg('{"type":"subservice-idty","id":"/node[name=' || o || ']/if[name=' || n ||
               ']","dependency-type":"impacting-dependency"}', ',' ORDER BY n) || ']}' AS bag
        FROM l GROUP BY o""",
    "build_nodes": """
        WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS host FROM events),
        c AS (SELECT host, unnest(['cpus', 'sensors', 'disks', 'mem', 'proc', 'net']) AS t FROM u),
        f AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS host, event_type AS e FROM events)
        SELECT host, '/node[name=' || host || ']' AS fullname, '/node' AS path, NULL AS parent, 'node' AS type,
               host AS name, 0 AS depth FROM u
        UNION ALL SELECT host, '/node[name=' || host || ']/bm', '/node/bm', '/node[name=' || host || ']', 'bm', NULL, 1 FROM u
        UNION ALL SELECT host, '/node[name=' || host || ']/bm/' || t, '/node/bm/' || t, '/node[name=' || host || ']/bm',
                         t, NULL, 2 FROM c
        UNION ALL SELECT host, '/node[name=' || host || ']/bm/net/if[name=' || e || ']', '/node/bm/net/if',
                         '/node[name=' || host || ']/bm/net', 'if', e, 3 FROM f""",
    "fleet_counters": """
        SELECT CAST(user_id AS VARCHAR) AS host, count(DISTINCT event_type) AS vms,
               count(*) FILTER (value > 100) AS symptoms, max(event_id) AS up_s FROM events GROUP BY 1""",
    "path_split": """
        SELECT DISTINCT '/node[name=' || l_suppkey || ']/bm/net/if[name=eth' || l_linenumber || '/0][unit=' || l_partkey || ']' AS path,
               4 AS n, 'if' AS type, 'eth' || l_linenumber || '/0' AS name, CAST(l_partkey AS VARCHAR) AS unit
        FROM lineitem""",
}
ORACLE["numbered_edges"] = f"""
    SELECT source, target, row_number() OVER (ORDER BY source COLLATE "C", target COLLATE "C") AS weight
    FROM ({ORACLE['graph_edges']})""".replace(' COLLATE "C"', "")


def _preorder_sql() -> str:
    names = ["'/node[name=w]'"]
    columns = ("l_returnflag", "l_linestatus", "l_orderkey % 2", "year(l_shipdate)", "month(l_shipdate)", "day(l_shipdate)", "l_linenumber", "l_suppkey % 3")
    for i, column in enumerate(columns):
        names.append(f"{names[-1]} || '/s{i}[name=' || {column} || ']'")
    trails = " UNION ALL ".join(f"SELECT DISTINCT [{', '.join(names[:i + 1])}] AS trail FROM lineitem" for i in range(len(names)))
    return f"""WITH t AS ({trails}), z AS (SELECT fullname, count(*) AS size FROM (SELECT unnest(trail) AS fullname FROM t) GROUP BY 1),
        p AS (SELECT trail[len(trail)] AS fullname, (len(trail) - 1)::INTEGER AS depth, row_number() OVER (ORDER BY trail) - 1 AS position FROM t)
        SELECT fullname, depth, size, position FROM p JOIN z USING (fullname)"""


ORACLE["preorder"] = _preorder_sql()
WORLD = f"""{_levels('quadratic-mean')},
    nd AS (SELECT DISTINCT world AS fullname, NULL AS parent, '/node' AS path, 'w' AS name FROM place
           UNION ALL SELECT DISTINCT region, world, '/node/region', r_name FROM place
           UNION ALL SELECT nation, region, '/node/region/nation', n_name FROM place
           UNION ALL SELECT fullname, nation, '/node/region/nation/' || kind, regexp_extract(fullname, 'name=([^\\]]*)\\]$', 1) FROM leaf),
    sy AS (SELECT fullname, 100 - s AS weight, CASE WHEN 100 - s > 10 THEN 'Debt' ELSE 'Low balance' END AS name FROM leaf WHERE s < 100)"""
ORACLE["graph_document"] = f"""{WORLD},
    raw AS (
        SELECT 0 AS place, '' AS fullname, 0 AS section, '' AS entry, '{{"assurance-graph-version":3,"assurance-graph-last-change":"12","subservices":[' AS text
        UNION ALL SELECT 2, '', 0, '', ']}}'
        UNION ALL SELECT 1, fullname, 0, '', '{{"type":"subservice-idty","id":"' || fullname || '","subservice-parameters":{{"service":"' || path ||
                         '","instance-name":"' || name || '"}},"label":"' || fullname || '","health-score":' || s || ',"symptoms":[' FROM nd JOIN everything USING (fullname)
        UNION ALL SELECT 1, fullname, 2, '', '],"dependencies":[' FROM nd
        UNION ALL SELECT 1, fullname, 4, '', ']}}' FROM nd
        UNION ALL SELECT 1, fullname, 1, 'x', '{{"id":"s1","health-score-weight":' || weight || ',"label":"' || name || '","start-date-time":"7"}}' FROM sy
        UNION ALL SELECT 1, parent, 3, fullname, '{{"type":"subservice-idty","id":"' || fullname || '","dependency-type":"impacting-dependency"}}' FROM nd
                  WHERE parent IS NOT NULL),
    o AS (SELECT *, row_number() OVER (ORDER BY place, fullname, section, entry) - 1 AS part,
                 row_number() OVER (PARTITION BY place, fullname, section ORDER BY entry) AS n, min(fullname) FILTER (place = 1) OVER () AS first FROM raw)
    SELECT 'w' AS host, part, CASE WHEN entry <> '' AND n > 1 OR place = 1 AND section = 0 AND fullname <> first THEN ',' ELSE '' END || text AS text FROM o"""
ORACLE["symptom_feed"] = f"{WORLD} SELECT fullname || '/symptoms[name=' || name || ']/severity' AS path, weight::VARCHAR AS value FROM sy"
ORACLE["health_feed"] = f"{_levels('quadratic-mean')} SELECT '/health' || fullname AS path, s::VARCHAR AS value FROM everything"
ORACLE["compound_nodes"] = f"{TREE} SELECT DISTINCT nation || 'parent' AS id FROM leaf"
ORACLE["activity_roots"] = f"""{_levels('quadratic-mean')} SELECT fullname, s AS health_score FROM n2
    UNION ALL SELECT world, CAST({AGG['quadratic-mean']} AS INTEGER) FROM n2 WHERE length(regexp_extract(fullname, 'region.name=([^\\]]*)', 1)) > 4 GROUP BY 1"""
ORACLE["activation_log"] = f"""{WORLD} SELECT sy.fullname AS node, name AS activated_rule, '/node/customer' AS path, CASE WHEN weight > 10 THEN 'RED' ELSE 'ORANGE' END AS severity,
    weight, CASE WHEN weight > 10 THEN 'balance<0' ELSE 'balance<5000' END AS rule, s AS new_health_score
    FROM sy JOIN everything USING (fullname) WHERE sy.fullname LIKE '%/customer[%'"""
ORACLE["health_rollup_inactive"] = f"""{_levels('quadratic-mean', "kind = 'customer'")}
    SELECT fullname, s AS health_score FROM everything
    WHERE fullname LIKE '%nation%' AND fullname NOT LIKE '%customer%'"""
