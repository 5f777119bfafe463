"""Dependency graph of subservices and the roll-up of health scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.hof import let
from trustloom.functions.paths import (element_name, element_type, full_name, parent_of,
                                       path_prefixes, split_path, strip_leaf)
from trustloom.functions.scalar import half_even
from trustloom.functions.skew import prefix_sums
from trustloom.functions.text import list_map
from trustloom.session import ensure_checkpoint_dir, staged

# Node type -> containers every such node has.
TEMPLATE = {
    "bm": ("cpus", "sensors", "disks", "mem", "proc", "net"),
    "vm": ("cpus", "mem", "net", "proc"),
    "kb": ("proc", "mem", "net"),
}

METHODS = ("quadratic-mean", "mean", "geometric-mean", "harmonic-mean", "malus")


def build_nodes(entities: DataFrame, template: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Node rows of every host from its observed leaf entities (``host, path, entity``).

    Each entity contributes itself and all its ancestors; containers of the
    template are added below every node of their type. ``active`` and
    ``impacting`` start true.
    """
    template = TEMPLATE if template is None else template
    leaves = entities.select("host", "path", "entity").distinct()
    seen = leaves.select("host", F.explode(path_prefixes(split_path(
        full_name(F.col("host"), F.col("path"), F.col("entity"))))).alias("fullname"))
    roots = leaves.select("host").distinct().select(
        "host", F.explode(F.array(
            F.concat(F.lit("/node[name="), "host", F.lit("]")),
            F.concat(F.lit("/node[name="), "host", F.lit("]/bm")))).alias("fullname"))
    found = seen.unionByName(roots).distinct()
    containers = list_map(template)
    kind = element_type(F.element_at(split_path(F.col("fullname")), -1))
    filled = found.select("host", "fullname", F.explode_outer(
        F.try_element_at(containers, kind)).alias("child"))
    added = filled.filter("child IS NOT NULL").select(
        "host", F.concat("fullname", F.lit("/"), "child").alias("fullname"))
    return describe_nodes(found.unionByName(added).distinct())


def describe_nodes(named: DataFrame) -> DataFrame:
    """Path, parent, type, name and depth of ``host, fullname`` rows."""
    elements = F.col("_elements")
    last = F.element_at(elements, -1)
    return named.withColumn("_elements", split_path(F.col("fullname"))).select(
        *named.columns,
        F.concat(F.lit("/"), F.array_join(F.transform(elements, element_type), "/")).alias("path"),
        parent_of(elements).alias("parent"), element_type(last).alias("type"),
        element_name(last).alias("name"), (F.size(elements) - 1).alias("depth"),
        F.lit(True).alias("active"), F.lit(True).alias("impacting"))


def set_active(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Overwrite ``active`` of the nodes that have a state row (``host, fullname, active``)."""
    state = states.select("host", "fullname", F.col("active").alias("_state"))
    return (nodes.join(state, ["host", "fullname"], "left")
            .withColumn("active", F.coalesce("_state", "active")).drop("_state"))


def child_changes(presence: DataFrame, keys: Sequence[str], tick: str = "tick") -> DataFrame:
    """Children added to or gone from each tick against the tick before.

    ``presence`` has one row per key, child and whole-numbered tick. One
    equi-join of the table with itself shifted by a tick; no tick is compared
    with any other.
    """
    now = presence.select(*keys, "child", tick).distinct()
    before = now.withColumn(tick, F.col(tick) + 1).withColumn("_was", F.lit(True))
    last = presence.agg(F.max(tick)).first()[0]
    both = (now.withColumn("_is", F.lit(True)).join(before, [*keys, "child", tick], "full_outer")
            .filter(F.col(tick) <= F.lit(last)))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "gone")
    return (both.withColumn("change", change).filter("change IS NOT NULL")
            .select(*keys, "child", tick, "change"))


def graph_versions(changes: DataFrame, keys: Sequence[str], tick: str = "tick") -> DataFrame:
    """Graph version per tick: one step per child seen for the first time, plus the initial one."""
    firsts = (changes.filter("change = 'added'").groupBy(*keys, "child")
              .agg(F.min(tick).alias(tick)))
    added = firsts.groupBy(*[k for k in keys if k != "parent"], tick).agg(
        F.count(F.lit(1)).alias("added"))
    host = [k for k in keys if k != "parent"]
    w = (Window.partitionBy(*host) if host else Window.partitionBy(F.lit(0))).orderBy(tick)
    return added.withColumn("version", F.sum("added").over(
        w.rowsBetween(Window.unboundedPreceding, 0)) + 1).withColumnRenamed(tick, "last_change")


def propagate(score: Column, method: str) -> Column:
    """Aggregate of child scores for one roll-up method, not below 0."""
    if method == "quadratic-mean":
        out = half_even(F.sqrt(F.avg(score * score)))
    elif method == "mean":
        out = half_even(F.avg(score))
    elif method == "geometric-mean":
        out = F.when(F.min(score) <= 0, F.lit(0.0)).otherwise(
            half_even(F.exp(F.avg(F.ln(F.when(score > 0, score))))))
    elif method == "harmonic-mean":
        out = F.when(F.min(score) <= 0, F.lit(0.0)).otherwise(
            half_even(F.count(score) / F.sum(F.lit(1.0) / F.when(score > 0, score))))
    elif method == "malus":
        out = F.lit(100.0) - F.sum(F.lit(100.0) - score)
    else:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    return F.greatest(out, F.lit(0.0))


def rollup_scores(nodes: DataFrame, losses: DataFrame, method: str = "quadratic-mean",
                  keys: Sequence[str] = ("host",)) -> DataFrame:
    """Health score of every node.

    ``nodes`` has the keys, ``fullname, parent, depth, active, impacting``;
    ``losses`` has the keys, ``fullname`` and ``loss`` (points lost to symptoms,
    one row per symptom). A node scores the roll-up of its active impacting
    children, 100 without any, less its own losses. The nodes are written once,
    split by depth, so each level reads its own part only; the deepest level is
    read from that table. One aggregate and one join per level; the aggregate
    combines before the shuffle, so a parent with very many children is no hot
    spot. Every eighth level is written too, so plans of deep trees stay short.
    """
    keys = list(keys)
    total = losses.groupBy(*keys, "fullname").agg(F.sum("loss").alias("_loss"))
    base = nodes.select(*keys, "fullname", "parent", "depth", "active", "impacting").join(
        total, [*keys, "fullname"], "left").withColumn("_loss", F.coalesce("_loss", F.lit(0)))
    base = staged(base, "rollup", "depth")
    own = F.greatest(F.lit(0.0), F.coalesce("_rolled", F.lit(100.0)) - F.col("_loss"))
    scored = None
    above = None
    deepest = base.agg(F.max("depth")).first()[0]
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = base.filter(F.col("depth") == depth)
        if above is None:
            level = level.withColumn("_rolled", F.lit(None).cast("double"))
        else:
            level = level.join(above, [*keys, "fullname"], "left")
        level = level.withColumn("health_score", own)
        above = (level.filter(F.col("active") & F.col("impacting") & F.col("parent").isNotNull())
                 .groupBy(*keys, F.col("parent").alias("fullname"))
                 .agg(propagate(F.col("health_score"), method).alias("_rolled")))
        if depth % 8 == 0 and depth:
            above = staged(above, "rollup-level")
        done = level.select(*keys, "fullname", F.col("health_score").cast("int").alias("health_score"))
        scored = done if scored is None else scored.unionByName(done)
    if scored is None:
        return base.select(*keys, "fullname", F.lit(None).cast("int").alias("health_score"))
    return scored


def symptom_feed(symptoms: DataFrame) -> DataFrame:
    """Symptom rows as ``path, value`` telemetry."""
    return symptoms.select(
        F.concat("node", F.lit("/symptoms[name="), "name", F.lit("]/severity")).alias("path"),
        F.col("weight").cast("string").alias("value"))


def health_feed(scores: DataFrame) -> DataFrame:
    return scores.select(F.concat(F.lit("/health"), "fullname").alias("path"),
                         F.col("health_score").cast("string").alias("value"))


def subservice_bags(nodes: DataFrame, scores: DataFrame, symptoms: DataFrame,
                    keys: Sequence[str] = ("host",), page_rows: int = 1000) -> DataFrame:
    """One JSON bag per node with its symptoms and dependencies.

    A node with more than ``page_rows`` entries gets several bags, numbered by
    ``page``, so that no row grows with the data; most nodes have page 0 only.
    """
    keys = list(keys)
    deps = (nodes.filter("parent IS NOT NULL").select(
        *keys, F.col("parent").alias("fullname"), F.struct(
            F.lit("subservice-idty").alias("type"), F.col("fullname").alias("id"),
            F.when(F.col("impacting"), "impacting-dependency")
            .otherwise("informational-dependency").alias("dependency-type")).alias("dep"),
        F.col("fullname").alias("_id"), F.lit(None).cast(
            "struct<id:string,`health-score-weight`:int,label:string,`start-date-time`:string>")
        .alias("sym")))
    syms = symptoms.select(
        *keys, F.col("node").alias("fullname"), F.lit(None).cast(
            "struct<type:string,id:string,`dependency-type`:string>").alias("dep"),
        F.concat_ws("|", "symptom_id", "ts").alias("_id"),
        F.struct(F.col("symptom_id").alias("id"), F.col("weight").alias("health-score-weight"),
                 F.col("name").alias("label"),
                 F.col("ts").cast("string").alias("start-date-time")).alias("sym"))
    items = deps.unionByName(syms)
    # Only nodes with several pages are looked up: they are few, and the items need not be sorted for it.
    pages = items.groupBy(*keys, "fullname").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(page_rows)).alias("pages")).filter("pages > 1")
    paged = items.join(pages, [*keys, "fullname"], "left").withColumn(
        "page", F.when(F.col("pages").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64("_id"), F.col("pages"))).cast("int"))
    lists = paged.groupBy(*keys, "fullname", "page").agg(
        F.array_sort(F.collect_list("dep")).alias("dependencies"),
        F.array_sort(F.collect_list("sym")).alias("symptoms"))
    full = (nodes.join(scores, [*keys, "fullname"]).join(lists, [*keys, "fullname"], "left"))
    empty = F.array()
    return full.select(
        *keys, "fullname", F.coalesce("page", F.lit(0)).alias("page"),
        F.to_json(F.struct(
            F.lit("subservice-idty").alias("type"), F.col("fullname").alias("id"),
            F.struct(F.col("path").alias("service"), F.col("name").alias("instance-name"))
            .alias("subservice-parameters"),
            F.col("fullname").alias("label"), F.col("health_score").alias("health-score"),
            F.coalesce("symptoms", empty).alias("symptoms"),
            F.coalesce("dependencies", empty).alias("dependencies"))).alias("bag"))


def preorder(nodes: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """``keys, fullname, depth, size, position`` of every node: its subtree's node count and its place in a walk from the roots.

    A node comes before its children, these in the order of their names. Subtree sizes are added up level by level from the
    deepest; positions go down again: a child stands behind its parent and the subtrees of the siblings before it. Siblings are
    summed by ranges of names, so a node with very many children is no hot spot. Subtrees are intervals: a node is below another
    if its position is less than ``size`` behind it.
    """
    keys = list(keys)
    base = staged(nodes.select(*keys, "fullname", "parent", "depth"), "preorder", "depth")
    deepest = base.agg(F.max("depth")).first()[0]
    if deepest is None:
        return base.select(*keys, "fullname", "depth", F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("position"))
    sized, above = [], None
    for depth in range(deepest, -1, -1):
        level = base.filter(F.col("depth") == depth)
        below = F.lit(0).cast("bigint")
        if above is not None:
            level, below = level.join(above, [*keys, "fullname"], "left"), F.coalesce("_below", F.lit(0))
        level = staged(level.withColumn("size", below + 1).select(*keys, "fullname", "parent", "depth", "size"), "subtrees")
        above = level.groupBy(*keys, F.col("parent").alias("fullname")).agg(F.sum("size").alias("_below"))
        sized.append(level)
    placed, out = None, None
    for level in reversed(sized):
        siblings = keys if placed is None else [*keys, "parent"]
        level = prefix_sums(level, siblings, ["fullname"], F.col("size"), "_before")
        if placed is None:
            level = level.withColumn("position", F.col("_before"))
        else:
            up = placed.select(*keys, F.col("fullname").alias("parent"), F.col("position").alias("_up"))
            level = level.join(up, [*keys, "parent"]).withColumn("position", F.col("_up") + 1 + F.col("_before"))
        placed = staged(level.select(*keys, "fullname", "depth", "size", "position"), "places")
        out = placed if out is None else out.unionByName(placed)
    return out


def document_parts(nodes: DataFrame, scores: DataFrame, symptoms: DataFrame, versions: DataFrame) -> DataFrame:
    """The graph document of every host in numbered parts: ``host, part, text``; the texts in order are one JSON document.

    A part is an opening, one symptom, one dependency or a closing, so no row grows with the graph. ``versions`` has one row per
    host (``version, last_change``). Parts are numbered by ranges, so a host may be in many tasks.
    """
    ids = nodes.join(scores, ["host", "fullname"])

    def part(rows: DataFrame, section: int, entry: Column, text: Column, item: bool = False) -> DataFrame:
        return rows.select("host", F.lit(1).alias("place"), "fullname", F.lit(section).alias("section"), entry.alias("entry"), text.alias("text"),
                           F.lit(item).alias("item"))
    none = F.lit("")
    head = F.struct(F.lit("subservice-idty").alias("type"), F.col("fullname").alias("id"),
                    F.struct(F.col("path").alias("service"), F.col("name").alias("instance-name")).alias("subservice-parameters"),
                    F.col("fullname").alias("label"), F.col("health_score").alias("health-score"))
    opened = F.concat(F.expr("left(_json, length(_json) - 1)"), F.lit(',"symptoms":['))
    open_ = part(ids.withColumn("_json", F.to_json(head)), 0, none, opened)
    raised = symptoms.select("host", F.col("node").alias("fullname"), F.to_json(F.struct(
        F.col("symptom_id").alias("id"), F.col("weight").alias("health-score-weight"), F.col("name").alias("label"),
        F.col("ts").cast("string").alias("start-date-time"))).alias("_json")).distinct().join(ids.select("host", "fullname"), ["host", "fullname"])
    middle = part(ids, 2, none, F.lit('],"dependencies":['))
    children = nodes.filter("parent IS NOT NULL").select("host", F.col("parent").alias("fullname"), F.to_json(F.struct(
        F.lit("subservice-idty").alias("type"), F.col("fullname").alias("id"),
        F.when(F.col("impacting"), "impacting-dependency").otherwise("informational-dependency").alias("dependency-type"))).alias("_json")).join(
        ids.select("host", "fullname"), ["host", "fullname"])
    entries = part(raised, 1, F.col("_json"), F.col("_json"), True).unionByName(part(children, 3, F.col("_json"), F.col("_json"), True))
    close = part(ids, 4, none, F.lit("]}"))
    whole = versions.join(ids.select("host").distinct(), "host")
    ends = whole.select("host", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.concat(F.lit('{"assurance-graph-version":'), F.col("version").cast("string"), F.lit(',"assurance-graph-last-change":"'),
                                                   F.col("last_change").cast("string"), F.lit('","subservices":[')).alias("text")),
        F.struct(F.lit(2).alias("place"), F.lit("]}").alias("text")))).alias("e")).select(
        "host", "e.place", F.lit("").alias("fullname"), F.lit(0).alias("section"), none.alias("entry"), "e.text", F.lit(False).alias("item"))
    parts = open_.unionByName(entries).unionByName(middle).unionByName(close).unionByName(ends)
    # The first entry of a list and the first node of a document have no comma before them.
    lists = entries.groupBy("host", "fullname", "section").agg(F.min("entry").alias("_first"))
    first = ids.groupBy("host").agg(F.min("fullname").alias("_node"))
    parts = parts.join(lists, ["host", "fullname", "section"], "left").join(first, "host")
    comma = F.when(F.col("item"), F.col("entry") != F.col("_first")).otherwise(
        (F.col("place") == 1) & (F.col("section") == 0) & (F.col("fullname") != F.col("_node")))
    parts = parts.withColumn("text", F.when(comma, F.concat(F.lit(","), "text")).otherwise(F.col("text"))).select(
        "host", "place", "fullname", "section", "entry", "text")
    return prefix_sums(parts, ["host"], ["place", "fullname", "section", "entry"], F.lit(1), "part").select("host", "part", "text")


def document_manifest(parts: DataFrame) -> DataFrame:
    """``host, parts, chars`` of every document, to be written after its parts: a document without it is not complete."""
    return parts.groupBy("host").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("text")).alias("chars"))


def graph_edges(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct parent-child edges between the prefixes of every path, numbered by weight."""
    pairs = let(path_prefixes(split_path(F.col(column))), lambda prefixes: F.transform(
        F.slice(prefixes, F.lit(2), F.size(prefixes)), lambda p, i: F.struct(
            F.get(prefixes, i).alias("source"), p.alias("target"))))
    return (paths.filter(F.size(split_path(F.col(column))) > 0)
            .select(F.explode(pairs).alias("e")).select("e.*").distinct())


def number_edges(edges: DataFrame) -> DataFrame:
    """Running number of each edge in (source, target) order.

    Range partitions are counted first, so numbering needs no single-task sort.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    ordered = (edges.repartitionByRange(F.col("source"), F.col("target"))
               .sortWithinPartitions("source", "target").withColumn("_p", F.spark_partition_id()))
    ordered = ordered.checkpoint()
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_p").count().withColumn(
        "_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("_p").orderBy("source", "target")
    return (ordered.join(F.broadcast(starts), "_p")
            .withColumn("weight", F.row_number().over(inside) + F.col("_start"))
            .select("source", "target", "weight"))


def graph_nodes(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct prefixes of all paths with depth and compound parent (depth above 2 only)."""
    seen = paths.select(F.explode(path_prefixes(split_path(F.col(column)))).alias("id")).distinct()
    elements = F.col("_elements")
    size = F.size(elements)
    return seen.withColumn("_elements", split_path(F.col("id"))).select(
        "id", element_type(F.element_at(elements, -1)).alias("name"), (size - 1).alias("depth"),
        F.when(size > 3, F.concat(parent_of(elements), F.lit("parent")))
        .otherwise(F.lit("")).alias("compound"))


def compound_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("compound <> ''").select(F.col("compound").alias("id")).distinct()


def effective_activity(paths: DataFrame, states: DataFrame, column: str = "path") -> DataFrame:
    """Active only if the node and all its ancestors are; a node without a state is active."""
    expanded = paths.select(column, F.explode(path_prefixes(split_path(F.col(column))))
                            .alias("prefix"))
    state = states.select(F.col("path").alias("prefix"), "active")
    return (expanded.join(state, "prefix", "left")
            .groupBy(column).agg(F.bool_and(F.coalesce("active", F.lit(True))).alias("active")))


def node_colours(nodes: DataFrame) -> DataFrame:
    """Green, red and grey shares from ``active`` and ``health_score`` (100 when missing)."""
    health = F.coalesce("health_score", F.lit(100))
    return nodes.withColumns({
        "green": F.when(F.col("active"), health).otherwise(0),
        "red": F.when(F.col("active"), F.lit(100) - health).otherwise(0),
        "grey": F.when(F.col("active"), 0).otherwise(100)})


def symptom_text(symptoms: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Text of the distinct symptoms of each node; their number is bounded by the rule table."""
    once = symptoms.select(*keys, "name", "weight").distinct()
    line = F.concat(F.lit("<br>"), "name", F.lit(" ("), F.col("weight").cast("string"), F.lit(")"))
    return once.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(line)), "").alias("symptoms"))


def category_scores(categories: DataFrame, scores: DataFrame) -> DataFrame:
    """Score of the container of each category path (leaf element stripped)."""
    return (categories.withColumn("fullname", strip_leaf(F.col("category")))
            .join(scores, "fullname").select("category", "health_score"))


def fleet_counters(nodes: DataFrame, symptoms: DataFrame, uptimes: DataFrame) -> DataFrame:
    """VM count, symptom count and uptime as a duration per host."""
    vms = nodes.groupBy("host").agg(F.count_if(F.col("type") == "vm").alias("vms"))
    raised = symptoms.groupBy("host").agg(F.count(F.lit(1)).alias("symptoms"))
    up = uptimes.groupBy("host").agg(F.max_by("up", "ts").alias("up"))
    return (vms.join(raised, "host", "left").join(up, "host", "left")
            .select("host", "vms", F.coalesce("symptoms", F.lit(0)).alias("symptoms"),
                    F.make_dt_interval(secs=F.col("up")).alias("uptime")))
