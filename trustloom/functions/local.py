"""Small fixed tables as local relations."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Rows of a fixed table as a local relation."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.table({f.name: pa.array(list(c)) for f, c in zip(schema, columns)})
    return spark.createDataFrame(table, schema)
