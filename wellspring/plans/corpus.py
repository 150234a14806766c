"""Corpus build: filter, deduplicate, cap, redact, label, union, report.

Stage order per frame follows the reference job: channel allowlist ->
text quality -> min score -> dedup by id -> date range -> per-channel cap.
The date filter stays after the dedup on purpose (keep-first is not
commutative with it). Posts and comments are filtered separately, so an id
shared by a post and a comment survives in both.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as FL
from ..operators.dedup import deduplicate
from ..operators.normalize import UNION_COLUMNS, union_columns
from ..operators.reports import coverage_report, stage_counter
from ..operators.sampling import cap_per_group
from ..operators.sentiment import add_sentiment


@dataclass
class CorpusOptions:
    allowlist: list = field(default_factory=list)
    min_text_length: int = 30
    min_score: int | None = 2
    date_from: str | None = "2020-01-01"
    date_to: str | None = "2024-12-31"
    max_per_channel: int | None = None
    sentiment_mode: str = "none"
    allowed_sources: tuple = ("forum", "reviews")
    seed: int = 42


class StageCounts:
    """AGG8: rows that enter and leave each stage of a job, counted by the job itself.

    ``at(part, stage)`` is put behind a stage; the numbers are metrics of whichever action runs
    first over the frame, so they cost no job and no pass. ``read()`` gives them after that action.
    """

    def __init__(self):
        self._observed: list[tuple[str, str, object]] = []

    def at(self, part: str, stage: str):
        op, observation = stage_counter(f"{part}: {stage}")
        self._observed.append((part, stage, observation))
        return op

    def read(self) -> list[tuple[str, str, int]]:
        return [(part, stage, observation.get["rows"]) for part, stage, observation in self._observed]


def _no_count(part: str, stage: str):
    return lambda df: df


def forum_stage(df: DataFrame, opt: CorpusOptions, count=_no_count, part: str = "forum") -> DataFrame:
    out = df.transform(count(part, "read")).transform(FL.filter_channels(opt.allowlist)).transform(count(part, "channels"))
    out = out.transform(FL.filter_text_quality(opt.min_text_length)).transform(count(part, "quality"))
    if opt.min_score is not None:
        out = out.transform(FL.filter_min_score(opt.min_score)).transform(count(part, "score"))
    out = out.transform(deduplicate()).transform(count(part, "dedup"))
    out = out.transform(FL.filter_dates(opt.date_from, opt.date_to)).transform(count(part, "dates"))
    if opt.max_per_channel:
        out = out.transform(cap_per_group(opt.max_per_channel, "channel", "id", opt.seed)).transform(count(part, "cap"))
    return out.withColumn("source", F.lit("forum"))


def review_stage(df: DataFrame, opt: CorpusOptions, count=_no_count, part: str = "review") -> DataFrame:
    out = df.transform(count(part, "read")).withColumn("text", T.redact("text"))
    out = out.transform(FL.filter_text_quality(opt.min_text_length)).transform(count(part, "quality"))
    out = out.transform(deduplicate()).transform(count(part, "dedup"))
    out = out.transform(FL.filter_dates(opt.date_from, opt.date_to)).transform(count(part, "dates"))
    return out.withColumn("source", F.lit("reviews"))


def build_corpus(corpus: DataFrame, opt: CorpusOptions, lexicon: DataFrame | None = None,
                 counts: StageCounts | None = None) -> DataFrame:
    """The canonical union (S2 columns). ``counts`` gets the rows of every stage when a job runs
    over the result. A row of a source that isn't allowed fails the job: rows of no part are looked
    for by their source alone, and the guard stops at the first."""
    count = counts.at if counts else _no_count
    allowed = list(opt.allowed_sources)
    posts = forum_stage(corpus.filter((F.col("source") == "forum") & (F.col("type") == "post")), opt, count, "post")
    comments = forum_stage(corpus.filter((F.col("source") == "forum") & (F.col("type") == "comment")), opt, count, "comment")
    reviews = review_stage(corpus.filter(F.col("source") == "reviews"), opt, count)
    parts = []
    for part in (posts, comments, reviews):
        for c in ("title", "author", "url"):
            if c not in part.columns:
                part = part.withColumn(c, F.lit(""))
        parts.append(part.transform(add_sentiment(opt.sentiment_mode, lexicon)).transform(union_columns))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = out.select(*[c for c in UNION_COLUMNS if c in out.columns])
    foreign = corpus.filter(FL.disallowed_source(allowed)).transform(FL.guard_sources(allowed, stage="corpus"))
    foreign = foreign.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields])
    return out.unionByName(foreign).transform(FL.guard_sources(allowed, stage="corpus"))


def write_corpus(corpus: DataFrame, opt: CorpusOptions, path: str, lexicon: DataFrame | None = None) -> list[tuple[str, str, int]]:
    """The corpus job: one job writes the union as Parquet by source, and tells ``(part, stage, rows)``."""
    counts = StageCounts()
    out = build_corpus(corpus, opt, lexicon, counts)
    out.write.mode("overwrite").partitionBy("source").parquet(path)
    return counts.read()


def corpus_coverage(corpus: DataFrame, opt: CorpusOptions) -> DataFrame:
    return coverage_report(build_corpus(corpus, opt))
