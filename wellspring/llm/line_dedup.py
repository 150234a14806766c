"""Line dedup: runs of lines that occur again are found and the later ones deleted.

A document is the sequence of its non-empty lines, each hashed without white space. A run
of lines that has ``min_words`` words or more and occurs at an earlier place too (by doc_id,
then place, in other documents or the same) is deleted; so are all parts of it.

Every such run is the union of its least stretches of ``min_words`` words: of each of its
lines the shortest stretch that starts there, or the shortest that ends there, or one around
it, lies in the run. So a document's fingerprints are the hashes of the shortest
stretches from and up to each line, at most two a line and ``min_words`` lines long each.
Whichever places a run has in common with others, each of its stretches occurs where the
run does, and all of a fingerprint's occurrences but the first are deleted: nothing is
extended or aligned, and lines of any length and runs with any neighbours are found whole.
Occurrences meet their fingerprint's first place only, so a hash that a third of the
documents hold costs one row for each occurrence. DataFrame functions only.

Lines alike without white space can differ in words ("ab" and "a b"). They count with the
most words that one of them has, so that a run is as long wherever it occurs.

Defined results: NULL text is treated as empty and comes back NULL; empty lines are
never deleted; a NULL doc_id sorts last; rows that repeat doc_id and text are one
document (they get the same result, and none is later than another). Other columns
are carried; ``n_lines``, ``deleted`` and ``n_deleted`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import (WHITE_SPACE, bloom_table, id_or_lowest, join_groups, only_possible, plain_names, possibly_in,
                                   without_space)
from wellspring.session import cut_lineage


def _uid(doc_id: str, text: str) -> Column:
    return F.xxhash64(id_or_lowest(F.col(doc_id)), F.coalesce(F.col(text), F.lit("")))


def _word_count(line: Column) -> Column:
    return F.size(F.array_remove(F.split(F.translate(line, WHITE_SPACE, " " * len(WHITE_SPACE)), " "), ""))


def hashed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, uid, h, w)``: hashes and words of each document's non-empty lines, checkpointed."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: without_space(x) != "")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _uid(doc_id, text).alias("uid"),
                       F.transform(lines, lambda x: F.struct(F.xxhash64(without_space(x)).alias("h"),
                                                             _word_count(x).alias("w"))).alias("lines"))
    # filtered when checkpointed: before, the lines would be hashed twice
    rows = cut_lineage(rows).filter(F.size("lines") > 0)
    each = rows.select("uid", F.posexplode("lines").alias("at", "line")).select("uid", "at", "line.*")
    odd = each.groupBy("h").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.count(F.lit(1)).alias("n"))
    odd = cut_lineage(odd.filter("least < most").select("h", "most", "n"))
    rows = rows.select("doc_id", "uid", F.col("lines.h").alias("h"), F.col("lines.w").alias("w"))
    if not odd.take(1):
        return rows
    n = each.count()
    most = join_groups(each, odd, "h", "n", n, ["uid", "at"], how="inner").groupBy("uid").agg(
        F.map_from_entries(F.collect_set(F.struct("at", "most"))).alias("m"))
    most = cut_lineage(most.withColumnRenamed("uid", "_uid"))
    rows = only_possible(rows, "uid", most.withColumnRenamed("_uid", "uid"), most.count())
    met = rows.filter("_may").join(most, F.col("uid") == F.col("_uid"), "left")
    met = met.withColumn("w", F.transform("w", lambda x, i: F.coalesce(F.element_at("m", i), x)))
    cols = ["doc_id", "uid", "h", "w"]
    return cut_lineage(met.select(*cols).union(rows.filter("not _may").select(*cols)))


def _stretch(words: Column, min_words: int) -> Column:
    """How many leading elements have ``min_words`` words together; NULL if all have fewer."""
    # words above 2^20, lines below
    enough = min_words << 20
    acc = F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: F.when(acc >= enough, acc).otherwise(
        acc + x.cast("long") * (1 << 20) + 1))
    return F.when(acc >= enough, acc.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))


def fingerprints(rows: DataFrame, min_words: int) -> DataFrame:
    """``(fp, doc_id, uid, pos, size)``: the shortest stretches of ``min_words`` words from and up to each line."""
    def pack(pos: Column, size: Column) -> Column:
        return F.when(size.isNotNull(), pos.cast("long") * (1 << 20) + size)

    lines = F.when(F.size("h") > 0, F.sequence(F.lit(1), F.size("h")))
    onward = F.transform(lines, lambda i: pack(i, _stretch(F.slice("w", i, F.lit(min_words)), min_words)))

    def back(i: Column) -> Column:
        low = F.greatest(i - min_words + 1, F.lit(1))
        size = _stretch(F.reverse(F.slice("w", low, i - low + 1)), min_words)
        return pack(i - size + 1, size)

    both = F.array_compact(F.array_distinct(F.concat(onward, F.transform(lines, back))))
    rows = rows.select("doc_id", "uid", "h", F.explode(both).alias("at"))
    rows = rows.withColumn("pos", F.shiftright("at", 20).cast("int")).withColumn(
        "size", F.col("at").bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))
    return rows.select(F.xxhash64(F.slice("h", F.col("pos"), F.col("size"))).alias("fp"), "doc_id", "uid", "pos", "size")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """``(uid, places)``: for each document with lines to delete, their places among its non-empty lines (from 1)."""
    rows = cut_lineage(fingerprints(hashed_lines(docs, doc_id, text), min_words))
    place = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "uid", "pos")
    twice = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")).filter("n > 1")
    twice = cut_lineage(twice)
    met = join_groups(rows, twice, "fp", "n", rows.count(), ["uid", "pos"], how="inner")
    met = met.filter(~(F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "pos").eqNullSafe(F.col("place"))))
    runs = met.groupBy("uid").agg(F.collect_set(F.struct("pos", "size")).alias("runs"))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["size"] - 1)))
    return runs.select("uid", F.sort_array(F.array_distinct(places)).alias("places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 20) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from ``text``, plus ``n_lines`` (all lines),
    ``deleted`` (their numbers from 1) and ``n_deleted``. Documents without such runs pass unshuffled."""
    docs = docs.drop("n_lines", "deleted", "n_deleted")
    docs, (doc_id, text), names = plain_names(docs, doc_id, text)
    cols = docs.columns
    lost = cut_lineage(repeated_lines(docs, doc_id, text, min_words))
    keyed = docs.withColumn("_uid", _uid(doc_id, text))
    lost = lost.withColumnRenamed("uid", "_lost")
    keyed = possibly_in(keyed, "_uid", bloom_table(lost, "_lost", lost.count()), "_may")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    numbers = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: without_space(F.element_at("_lines", i)) != "")
    met = keyed.filter("_may").join(lost, F.col("_uid") == F.col("_lost"), "left").withColumn("_lines", lines)
    chosen = F.get(F.transform(F.array(numbers), lambda at: F.transform("places", lambda p: F.element_at(at, p))), F.lit(0))
    met = met.withColumn("deleted", F.coalesce(F.when(F.col("places").isNotNull(), chosen), F.array().cast("array<int>")))
    rest = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("deleted", i + 1)), "\n")
    met = met.withColumn(text, F.when(F.size("deleted") > 0, rest).otherwise(F.col(text)))
    out = [F.size("_lines").alias("n_lines"), "deleted", F.size("deleted").alias("n_deleted")]
    straight = keyed.filter("not _may").withColumn("_lines", lines).withColumn("deleted", F.array().cast("array<int>"))
    return met.select(*cols, *out).union(straight.select(*cols, *out)).toDF(*names, "n_lines", "deleted", "n_deleted")
