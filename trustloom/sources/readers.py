"""Readers: files and topics with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.flatten import parse_snapshots
from trustloom.operators.rules import valid_severity
from trustloom.sources import schemas
from trustloom.sources.json_array import json_objects


def kafka_options(servers: str, topic: str, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, **(extra or {})}


def kafka_replay(spark: SparkSession, servers: str, topic: str,
                 extra: Mapping[str, str] | None = None) -> DataFrame:
    """All health messages of a topic from the first offset to the last one at start."""
    rows = (spark.read.format("kafka").options(**kafka_options(servers, topic, extra))
            .option("startingOffsets", "earliest").option("endingOffsets", "latest").load())
    return topic_snapshots(rows)


def topic_snapshots(rows: DataFrame) -> DataFrame:
    """Snapshot columns of topic rows with their partition and offset as arrival order."""
    text = rows.select("partition", "offset", F.col("value").cast("string").alias("value"))
    return parse_snapshots(text, "value", "partition", "offset")


def kafka_stream(spark: SparkSession, servers: str, topic: str,
                 extra: Mapping[str, str] | None = None) -> DataFrame:
    """A topic as a stream of text values; the query's checkpoint keeps the offsets."""
    return (spark.readStream.format("kafka").options(**kafka_options(servers, topic, extra))
            .option("startingOffsets", "earliest").load()
            .select("partition", "offset", F.col("value").cast("string").alias("value")))


def request_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    """Request rows of a text stream; text that is no request has NULL ids."""
    return lines.withColumn("_r", F.from_json(column, schemas.REQUEST)).select(
        F.sha1(column).alias("request_id"), F.col("_r.ids").alias("ids"))


def snapshot_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or lines) of health messages, read by ranges; a missing path raises at once."""
    return json_objects(spark, path).select(F.from_json("value", schemas.SNAPSHOT).alias("m")).select("m.*")


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of health messages, one message per line: splittable at any size."""
    return parse_snapshots(spark.read.text(path))


def envelope_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed telemetry envelopes as a file stream."""
    return spark.readStream.schema(schemas.ENVELOPE).json(path)


def envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENVELOPE).json(path)


def rules_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows; a trailing empty header column is ignored, unknown severities are dropped."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=False,
                          schema=schemas.RULE_FILE + ", `_c4` STRING") \
        if _has_trailing_column(spark, path) else spark.read.csv(
            path, header=True, quote='"', escape='"', schema=schemas.RULE_FILE)
    return valid_severity(rows.select("name", "path", "severity", "rule"))


def _has_trailing_column(spark: SparkSession, path: str) -> bool:
    return spark.read.text(path).first()["value"].rstrip().endswith(",")


def metric_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Metric catalogue, one row per (subservice, metric), the last one, with its ``place`` in the file; a row without counter has 0."""
    rows = spark.read.csv(path, header=True, schema=schemas.METRIC_CATALOG, enforceSchema=True)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    placed = (rows.select("*", place.alias("place")).filter("name IS NOT NULL AND type IN ('int', 'float', 'str')")
              .withColumn("counter", F.coalesce("counter", F.lit(0))))
    rest = [c for c in placed.columns if c not in ("subservice", "name")]
    return placed.groupBy("subservice", "name").agg(F.max_by(F.struct(*rest), "place").alias("_r")).select(
        "subservice", "name", *[F.col(f"_r.{c}") for c in rest])


def rule_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.RULE_CORPUS)


def rule_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.RULE_CATALOG, quote='"', escape='"')


def labelled_queries_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.LABELLED_QUERY, quote='"', escape='"')


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """``term, synonyms, group_no`` of a JSON object of lists, in file order."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,array<string>>"))
    return text.select(F.posexplode(entries).alias("group_no", "e")).select(
        F.col("e.key").alias("term"), F.col("e.value").alias("synonyms"), "group_no")


def phrases_json(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("phrase"))


def catalog_documents(spark: SparkSession, path: str) -> DataFrame:
    """Service-catalogue documents, one JSON document per file; missing parts are NULL."""
    return spark.read.schema(schemas.CATALOG).json(path, multiLine=True)


def user_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USER).json(path, multiLine=True)


def concept_records(spark: SparkSession, path: str) -> DataFrame:
    """``concept, record`` of a JSON array of single-key objects, read by ranges."""
    one = json_objects(spark, path).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return one.select(F.explode("m").alias("concept", "record"))


def wide_scores_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.WIDE_SCORE)


def latency_log(spark: SparkSession, path: str) -> DataFrame:
    """``ts, op, start, end, elapsed_ms`` of text blocks ended by a dashed line."""
    return latency_blocks(spark.read.text(path, lineSep="-" * 50))


def latency_blocks(blocks: DataFrame, column: str = "value") -> DataFrame:
    """The same from one text block per row."""
    def part(pattern: str, n: int = 1):
        return F.regexp_extract(column, pattern, n)
    head = r"\[([0-9-]+ [0-9:.]+)\]\s*(.*?):\s*(?:\n|$)"
    return blocks.filter(F.col(column).rlike(r"Elapsed time:")).select(
        part(head).cast("timestamp_ntz").alias("ts"), part(head, 2).alias("op"),
        part(r"Start time:\s*(\S+)").alias("start"), part(r"End time:\s*(\S+)").alias("end"),
        part(r"Elapsed time:\s*([0-9.]+)").cast("double").alias("elapsed_ms"))


def host_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Landed host files below ``host=.../ts=...`` folders, each as one row of text."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("_f"), F.col("value").alias("content"))
    where = r"/host=([^/]+)/ts=(\d+)(/.*)$"
    return rows.select(F.regexp_extract("_f", where, 1).alias("host"),
                       F.regexp_extract("_f", where, 2).cast("bigint").alias("ts"),
                       F.regexp_extract("_f", where, 3).alias("file"), "content")
