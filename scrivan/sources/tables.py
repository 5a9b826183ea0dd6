"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; timestamps without a zone are read as UTC instants (watermarks need them)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(casts) if casts else df
