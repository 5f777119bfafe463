"""The corpus pipeline over ``documents``: reject, deduplicate, mix and pack; every stage is written and read again.

Tables that a stage stages for itself are deleted when the next stage begins and its ``docs`` reads none of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.additive import accepted
from trustloom.llm.exact import exact_dedup
from trustloom.llm.mixing import mixed_texts
from trustloom.llm.near import near_dedup
from trustloom.llm.packing import packed, vocabulary_path
from trustloom.session import discard, recorded, ship_package, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[tuple[str, str]] = []  # session and folder of the tables of the stage before


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        session = spark.sparkContext.applicationId
        own = [path for app, path in _left if app == session]
        read = docs.inputFiles() if own else []
        unread = [path for path in own if not any(path.rsplit("/", 1)[1] in file for file in read)]
        for path in unread:
            discard(spark, path)
        with recorded() as tables:
            out = function(spark, docs, sf_dir)
        _left[:] = [(session, path) for path in [*own, *tables] if path not in unread]
        return out
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier learned from ``labels`` accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five words a shingle, a similarity of 0.8 or more."""
    return near_dedup(docs, words=5, percent=80)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a row per pass over a document."""
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("bigint"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in the packed sequences."""
    return packed(docs, vocabulary_path(), with_ids=True)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; only the last table stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with recorded() as tables:
            docs = staged(stage(spark, docs, sf_dir), name)
        *inner, last = tables
        for path in [*inner, before] if before else inner:
            discard(spark, path)
        before = last
    return docs
