"""Sinks: files, topics and tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustloom.operators.knowledge import ntriples
from trustloom.session import folder_names, staged


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append messages as JSON lines; earlier files are never rewritten."""
    snapshots.select("id", "timestamp", "data").write.mode("append").json(path)


def stream_snapshots(snapshots: DataFrame, path: str, checkpoint: str,
                     **trigger: object) -> StreamingQuery:
    return (snapshots.select("id", "timestamp", "data").writeStream.format("json")
            .option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def as_messages(rows: DataFrame) -> DataFrame:
    """Rows as JSON text in ``value``, the shape a topic sink takes."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_kafka(rows: DataFrame, servers: str, topic: str,
                extra: Mapping[str, str] | None = None) -> None:
    (as_messages(rows).write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).options(**(extra or {})).save())


def stream_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str,
                 extra: Mapping[str, str] | None = None) -> StreamingQuery:
    return (as_messages(rows).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .options(**(extra or {})).option("checkpointLocation", checkpoint).start())


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows (activated symptoms, recommendations) as CSV with a header."""
    rows.write.mode("append").option("header", True).csv(path)


def activate_rules(chosen: DataFrame, path: str) -> bool:
    """Replace the active rule file by the chosen rules; without any, the old file stays."""
    if chosen.isEmpty():
        return False
    chosen.select("name", "path", "severity", "rule").coalesce(1).write.mode("overwrite").option(
        "header", True).csv(path)
    return True


def write_triples(rows: DataFrame, prefixes: Mapping[str, str], path: str) -> None:
    ntriples(rows, prefixes).write.mode("overwrite").text(path)


def load_graph(nodes: DataFrame, edges: DataFrame, path: str, replace: bool = False) -> None:
    """Write node and edge tables. ``replace`` wipes the stored graph first; else nodes and edges that are stored already, by URI and
    by source, relation and target, are not written again."""
    spark = nodes.sparkSession
    for name, rows, keys in (("kg_nodes", nodes, ["uri"]), ("kg_edges", edges, ["src", "rel", "dst"])):
        target = f"{path}/{name}"
        fresh = rows.dropDuplicates(keys)
        if not replace and name in folder_names(spark, path):
            fresh = staged(fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti").select(*rows.columns), "graph")
        fresh.write.mode("overwrite" if replace else "append").parquet(target)


def append_feedback(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def write_graph_documents(parts: DataFrame, path: str) -> None:
    """Write the parts of graph documents and then, once they are all there, the manifest."""
    from trustloom.operators.graph import document_manifest
    parts.write.mode("overwrite").parquet(f"{path}/parts")
    document_manifest(parts.sparkSession.read.parquet(f"{path}/parts")).write.mode("overwrite").parquet(f"{path}/manifest")
