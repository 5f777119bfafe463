"""State of a stream as a stored table: one folder per micro-batch, keys in hash buckets.

A micro-batch reads the newest earlier version of the buckets it touches and writes new versions of these alone; a retry overwrites
its own folder. So ordered state needs no sorting in Python: the kept rows and the fresh ones are one DataFrame, which Spark's sorter
puts in order (and spills). The state can start from a batch table, as batch ``START``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustloom.session import folder_names, remove_folder

BUCKETS = 64
START = -1


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The micro-batches that wrote each bucket, oldest first."""
    out: dict[int, list[int]] = {}
    batches = sorted(int(name.split("=")[1]) for name in folder_names(spark, path) if name.startswith("batch="))
    for number in batches:
        for name in folder_names(spark, f"{path}/batch={number}"):
            if name.startswith("bucket="):
                out.setdefault(int(name.split("=")[1]), []).append(number)
    return out


def read_state(spark: SparkSession, path: str, schema: StructType, before: int, buckets: Sequence[int] | None = None) -> DataFrame:
    """The state rows as they were before a micro-batch, of all buckets or of some."""
    found = _versions(spark, path)
    wanted = [f"{path}/batch={max(n for n in numbers if n < before)}/bucket={bucket}" for bucket, numbers in found.items()
              if (buckets is None or bucket in buckets) and any(n < before for n in numbers)]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def write_state(rows: DataFrame, path: str, number: int, keys: Sequence[str]) -> None:
    """New versions of the buckets of ``rows``; versions that no retry can ask for are deleted."""
    spark = rows.sparkSession
    (rows.withColumn("bucket", bucket_of(keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{path}/batch={number}"))
    for bucket, numbers in _versions(spark, path).items():
        for old in [n for n in numbers if n < number][:-1]:
            remove_folder(spark, f"{path}/batch={old}/bucket={bucket}")


def touched_buckets(batch: DataFrame, keys: Sequence[str]) -> list[int]:
    return [r[0] for r in batch.select(bucket_of(keys)).distinct().collect()]  # at most BUCKETS
