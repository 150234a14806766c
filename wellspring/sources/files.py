"""File sources and sinks (SRC1, SRC2, SRC4, SRC5, SRC12, SNK1-SNK5).

Readers are plain ``spark.read`` scans with the options the exports need;
writers are plain ``df.write`` calls. Nothing is read on the driver.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

log = logging.getLogger(__name__)

_BAD = "_overflow"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv_skip_bad(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
                      encoding: str = "UTF-8") -> DataFrame:
    """SRC2/SRC5: header CSV, quoted multi-line fields, ``""`` escapes.

    ``path`` may be several files with one header. With known ``columns`` one extra overflow column is declared: lines with
    more fields than the header fill it and are dropped; short lines are
    padded with NULL (the pandas ``on_bad_lines='skip'`` behaviour).
    """
    reader = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
                   .option("escape", '"').option("encoding", encoding).option("mode", "PERMISSIVE"))
    if columns is None:  # the header names the columns
        columns = spark.read.option("header", True).option("quote", '"').option("escape", '"').option(
            "encoding", encoding).csv(path if isinstance(path, str) else path[0]).columns
    schema = StructType([StructField(c, StringType()) for c in columns] + [StructField(_BAD, StringType())])
    df = reader.schema(schema).csv(path)
    return df.filter(F.col(_BAD).isNull()).drop(_BAD)


def read_any(spark: SparkSession, path: str, empty_schema: str = "id string, text string") -> DataFrame:
    """SRC1: by extension - parquet, jsonl/ndjson (line JSON), json
    (multi-line), csv; a missing file or unknown extension gives an empty
    frame with a warning."""
    ext = os.path.splitext(path)[1].lower()
    if not _exists(spark, path):
        log.warning("missing input %s", path)
        return spark.createDataFrame([], empty_schema)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if ext == ".json":
        return spark.read.option("multiLine", True).json(path)
    if ext == ".csv":
        return read_csv_skip_bad(spark, path)
    log.warning("unknown extension %s", path)
    return spark.createDataFrame([], empty_schema)


def with_source_file(df: DataFrame, record_type: str | None = None) -> DataFrame:
    """SRC4: ``type`` and ``source_file`` columns for a folder source."""
    out = df.withColumn("source_file", F.input_file_name())
    return out.withColumn("type", F.lit(record_type)) if record_type else out


def read_report(spark: SparkSession, path: str, map_cols=("source_counts", "type_counts")) -> DataFrame:
    """SRC12: report CSV with Python-literal dict columns -> map<string,bigint>
    (quotes swapped to JSON quotes), NULL/blank -> empty map."""
    df = read_csv_skip_bad(spark, path)
    for c in map_cols:
        if c in df.columns:
            parsed = F.from_json(F.translate(F.col(c), "'", '"'), "map<string,bigint>")
            df = df.withColumn(c, F.coalesce(parsed, F.create_map().cast("map<string,bigint>")))
    return df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """SNK1/SNK2: overwrite parquet (optionally partitioned); skipped, with a
    warning, when the frame is empty. Returns whether it was written."""
    if df.isEmpty():
        log.warning("skipping %s: no rows", path)
        return False
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return True


def write_report_csv(df: DataFrame, path: str) -> None:
    """SNK3/SNK4/SNK5: one CSV file with a header (reports are small);
    map columns are written as JSON text."""
    out = df
    for f in df.schema.fields:
        if f.dataType.typeName() in ("map", "array", "struct"):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
