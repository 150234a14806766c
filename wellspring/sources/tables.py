"""Access to the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Scan ``<data_dir>/<name>.parquet``; projections and filters written
    after this call are pushed into the parquet scan by Catalyst."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
