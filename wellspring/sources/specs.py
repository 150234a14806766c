"""Sources by specification (SRC3-SRC5, SRC8, EXT4).

A ``SourceSpec`` names a folder or file, its record type and its field map. ``load_source`` finds the
files (CSV before line JSON before Parquet), reads them with the encoding they have, and maps them to
the common forum schema; ``load_sources`` unites any number of them. A new dataset is one more spec.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import FIELD_MAPS, RECORD_TYPES, normalize_forum
from ..operators.reports import stage_counter
from ..operators.reviews import Op, merge_posts
from .files import read_csv_skip_bad

log = logging.getLogger(__name__)

#: Kinds of files in the order in which a folder is searched for them.
KINDS = (".csv", ".jsonl", ".parquet")

FORUM_SCHEMA = ("id string, type string, channel string, title string, text string, author string, "
                "created_utc timestamp, score long, url string, source_file string")


@dataclass(frozen=True)
class SourceSpec:
    """One dataset. ``path``: a file, or a folder whose files of the first kind found are its parts.
    ``epoch_time``: whether times are epoch seconds (None: decided by the data, one pass)."""
    name: str
    path: str
    record_type: str = "post"
    field_map: Mapping[str, str] = field(default_factory=dict)
    epoch_time: bool | None = None


def forum_specs(base: str) -> list[SourceSpec]:
    """The five known forum exports, each in a folder of its name below ``base``."""
    return [SourceSpec(name, f"{base.rstrip('/')}/{name}", RECORD_TYPES[name], FIELD_MAPS[name]) for name in FIELD_MAPS]


def _kind(path: str) -> str:
    """The extension; parts of JSON that Spark wrote are line JSON."""
    name = path.rsplit("/", 1)[-1].lower()
    kind = "." + name.rsplit(".", 1)[-1]
    return ".jsonl" if kind == ".ndjson" or (kind == ".json" and name.startswith("part-")) else kind


def find_files(spark: SparkSession, path: str) -> list[str]:
    """SRC4: ``path`` itself if it is a file, else the folder's files of the first kind present, by
    name. Hidden files and those that start with ``_`` don't count. Listed through Hadoop, so any store will do."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop_path):
        return []
    if store.getFileStatus(hadoop_path).isFile():
        return [path]
    files = sorted(str(f.getPath()) for f in store.listStatus(hadoop_path)
                   if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    for kind in KINDS:
        found = [f for f in files if _kind(f) == kind]
        if found:
            return found
    return []


def invalid_utf8_files(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """SRC5: which of the files hold bytes that are not UTF-8. Lines are read as they are and
    checked where they lie, so files of any size are split; only file names come to the driver."""
    lines = spark.read.text(list(paths)).filter(~F.is_valid_utf8(F.col("value")))
    return {r[0] for r in lines.select(F.col("_metadata.file_path")).distinct().collect()}


def _plain(path: str) -> str:
    """A path without scheme and slashes in excess, to compare names from different readers."""
    return "/" + path.split(":", 1)[-1].lstrip("/")


def read_csv_by_encoding(spark: SparkSession, paths: Sequence[str], fallback: str = "ISO-8859-1") -> DataFrame:
    """SRC5: CSV files as UTF-8 or, where a file isn't that, as ``fallback``; columns by name."""
    bad = {_plain(p) for p in invalid_utf8_files(spark, paths)}
    frames = []
    for encoding, chosen in (("UTF-8", [p for p in paths if _plain(p) not in bad]), (fallback, [p for p in paths if _plain(p) in bad])):
        if chosen:
            frames.append(read_csv_skip_bad(spark, chosen, encoding=encoding))
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """One frame of files of one kind; None without files."""
    if not paths:
        return None
    kind = _kind(paths[0])
    if kind == ".csv":
        return read_csv_by_encoding(spark, paths)
    if kind == ".jsonl":
        return spark.read.json(list(paths))
    return spark.read.parquet(*paths)


def load_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The dataset in the common forum schema; empty, with a warning, if there are no files."""
    raw = read_files(spark, find_files(spark, spec.path))
    if raw is None:
        log.warning("no data files in %s", spec.path)
        return spark.createDataFrame([], FORUM_SCHEMA)
    return normalize_forum(raw, spec.record_type, spec.path, spec.field_map, spec.epoch_time)


def load_sources(spark: SparkSession, specs: Iterable[SourceSpec]) -> tuple[DataFrame, dict]:
    """SRC8: the union of all datasets, and an observation per dataset whose ``get`` tells the rows
    read once a job has run over the union (AGG8)."""
    out, counts = spark.createDataFrame([], FORUM_SCHEMA), {}
    for spec in specs:
        count, counts[spec.name] = stage_counter(f"read {spec.name}")
        out = out.unionByName(load_source(spark, spec).transform(count))
    return out, counts


def load_export(spark: SparkSession, path: str, job: Op, count: Op | None = None) -> DataFrame | None:
    """SRC5-SRC7: the files of one export through a job of ``operators.reviews``; ``count`` (a stage counter)
    sees the rows as read. None, with a warning, if there are no files."""
    raw = read_files(spark, find_files(spark, path))
    if raw is None:
        log.warning("no data files in %s", path)
        return None
    return (raw if count is None else raw.transform(count)).transform(job)


def load_posts(spark: SparkSession, exports: Sequence[tuple[str, Op]], order: Sequence[str] = ()) -> DataFrame | None:
    """SRC8: ``(path, job)`` of several forum exports in order, those without files left out; one row a text."""
    frames = [load_export(spark, path, job) for path, job in exports]
    frames = [f for f in frames if f is not None]
    return merge_posts(frames, order) if frames else None
