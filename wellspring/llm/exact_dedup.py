"""Exact dedup: two Bloom passes find possibly repeated hashes, only those rows shuffle.

Pass one hashes every normalised text and keeps the filter bits that two rows hit.
Pass two tests each row against that filter. Rows that miss are unique and pass
straight through; the others, true repeats and a few false positives, are grouped
by SHA-256. Text never enters a shuffle in ``dedup_report``; in ``dedup`` only the
text of possibly repeated rows does. DataFrame functions only.

Defined results: NULL text counts as empty, all empty texts are one group. The row
with the most code points stays, then the smallest doc_id (NULL ids last). Rows
that repeat both the text and the doc_id are one row as far as the result can tell:
exactly one of them is kept. An empty table gives an empty result. Other columns
are carried by ``dedup`` and never read; input columns named like an output column
of ``dedup_report`` don't matter, as that selects only what it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import bloom_table, id_or_lowest, join_groups, plain_names, possibly_in, without_space
from wellspring.session import cut_lineage

REPORT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _marked(docs: DataFrame, text: str, name: str = "_may") -> DataFrame:
    """``docs`` with a flag on rows whose normalised text is possibly repeated."""
    hashed = docs.select(F.xxhash64(without_space(F.col(text))).alias("_h"))
    bloom = bloom_table(hashed, "_h", docs.count(), at_least=2)
    out = possibly_in(docs.withColumn("_h", F.xxhash64(without_space(F.col(text)))), "_h", bloom, name)
    return out.drop("_h")


def _order(doc_id: str):
    """Sorts as the rule of who stays: longest, then smallest id, NULL last."""
    return F.struct((-F.col("_len")).alias("l"), F.col(doc_id).isNull().alias("o"), F.col(doc_id).alias("i"))


def _prints(marked: DataFrame, doc_id: str, text: str) -> DataFrame:
    return marked.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("_may"),
                         F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_len"),
                         F.unhex(F.sha2(without_space(F.col(text)), 256)).alias("_sha"))


def _decided(prints: DataFrame) -> DataFrame:
    """Fingerprints of possibly repeated rows -> ``(doc_id, _sha, _len, copies, keep_id, group_size, wins)``.

    Rows equal in id, length and text are one row here with their number in ``copies``.
    """
    same = cut_lineage(prints.groupBy("doc_id", "_sha", "_len").agg(F.count(F.lit(1)).alias("copies")))
    groups = same.groupBy("_sha").agg(F.min(_order("doc_id")).alias("best"), F.sum("copies").alias("group_size"))
    groups = cut_lineage(groups.filter("group_size > 1"))
    out = join_groups(same, groups, "_sha", "group_size", prints.count(), ["doc_id", "_len"])
    return out.select("doc_id", "_sha", "_len", "copies",
                      F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.i")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      (F.col("group_size").isNull() | _order("doc_id").eqNullSafe(F.col("best"))).alias("wins"))


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(doc_id, text)
    prints = cut_lineage(_prints(_marked(docs, text), doc_id, text))
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    alone = prints.filter(~F.col("_may")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha)
    some = _decided(prints.filter("_may")).select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    some = some.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("_copy") == 1)).alias("kept"), sha)
    return alone.union(some)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they came."""
    docs, (doc_id, text), names = plain_names(docs, doc_id, text)
    cols = docs.columns
    prints = cut_lineage(_prints(_marked(docs.select(doc_id, text), text), doc_id, text).filter("_may"))
    lost = _decided(prints).filter("not wins or copies > 1")
    lost = cut_lineage(lost.select(F.xxhash64(id_or_lowest(F.col("doc_id")), "_sha", "_len").alias("_k"),
                                   F.col("wins").alias("_wins")))
    sha = F.unhex(F.sha2(without_space(F.col(text)), 256))
    length = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    keyed = docs.withColumn("_k", F.xxhash64(id_or_lowest(F.col(doc_id)), sha, length))
    keyed = possibly_in(keyed, "_k", bloom_table(lost, "_k", lost.count()), "_may")
    # Rows that cannot be among the lost pass straight; the others meet their decision by key.
    met = keyed.filter("_may").join(lost, "_k", "left")
    once = met.filter("_wins").dropDuplicates(["_k"])
    return keyed.filter("not _may").select(*cols).union(met.filter("_wins is null").select(*cols)).union(
        once.select(*cols)).toDF(*names)
