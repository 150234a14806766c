"""Shared helpers of the training-text operators: Bloom filters as tables,
joins that survive a hot key, bounded Arrow blocks and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.session import cut_lineage, scratch_path

#: ``[\x20\x09-\x0D]``, the white space of every text rule here.
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: Bits of one Bloom page; 32768 bits is what ``bitmap_construct_agg`` builds (4 KB).
PAGE_BITS = 32768

#: Rows and characters that a Python worker holds decoded at a time.
BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 18

_LOWEST = -(1 << 63)


def without_space(text: Column) -> Column:
    """Text without its white space; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def id_or_lowest(col: Column) -> Column:
    """A non-null stand-in for a NULL id, for keys of joins."""
    return F.coalesce(col.cast("long"), F.lit(_LOWEST))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Limit Arrow batches to ``mb`` MB, so that very long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def drop_unused(spark: SparkSession) -> None:
    """Collect garbage on the driver: only then does Spark remove the shuffle files and checkpoints
    of tables that nobody refers to, and a job of many small steps keeps those of all of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Steps:
    """Large tables between the steps of one job, as Parquet below the shared checkpoint folder. They cut the
    lineage as checkpoints do and outlive executors, and are deleted once their last reader has run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written as ``name`` and read again."""
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Delete the tables named, and the shuffle files that nobody needs any more."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        drop_unused(self.spark)


def plain_names(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` under names that no helper column has, the new names of the columns ``used``, and the
    old names in order (for ``toDF``): extra columns may have any name."""
    names = [f"col_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in used], docs.columns


# ----------------------------------------------------------------- Bloom filters


def bloom_table(hashes: DataFrame, h: str, n: int, at_least: int = 1, bits_per_key: int = 16,
                max_bits: int = 1 << 28) -> DataFrame:
    """A paged Bloom filter as rows ``(page, bits)``, built by aggregation only.

    ``h`` is a well-mixed 64-bit hash (NULLs are left out). Low bits choose a 4 KB
    page, two further groups of 15 bits choose two positions in it. With
    ``at_least=2`` a bit is set only where two rows hit it, so the filter answers
    "possibly repeated". ``n`` (rows) sizes the filter up to ``max_bits`` (32 MB):
    beyond that more rows pass the test, and results stay the same.
    """
    pages = 1
    while pages * PAGE_BITS < min(max_bits, n * bits_per_key):
        pages *= 2
    key = F.col(h)
    page = key.bitwiseAND(F.lit(pages - 1))
    at = F.explode(F.array(*[page * PAGE_BITS + p for p in _positions(key)]))
    bit = hashes.filter(key.isNotNull()).select(at.alias("_at"))
    if at_least > 1:
        bit = bit.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return (bit.groupBy(F.shiftright("_at", 15).alias("_page"))
            .agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(PAGE_BITS - 1))).alias("_bits"),
                 F.lit(pages).alias("_pages")))


def _positions(key: Column) -> list[Column]:
    return [F.shiftrightunsigned(key, s).bitwiseAND(F.lit(PAGE_BITS - 1)) for s in (15, 30)]


def possibly_in(df: DataFrame, h: str, bloom: DataFrame, name: str) -> DataFrame:
    """Add boolean ``name``: the filter may hold ``df[h]`` (never a false "no").

    The filter is collected once as at most ``max_bits`` bits and broadcast; the test
    itself is a map-side join on the page.
    """
    bloom = cut_lineage(bloom)
    first = bloom.select("_pages").first()
    if first is None:
        return df.withColumn(name, F.lit(False))
    key = F.col(h)

    out = df.withColumn("_page", key.bitwiseAND(F.lit(first[0] - 1)))
    out = out.join(F.broadcast(bloom.select("_page", "_bits")), "_page", "left")
    hit = F.lit(True)
    for p in _positions(key):
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10)
        hit = hit & (F.getbit(byte.cast("int"), p.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_page", "_bits")


# ----------------------------------------------------------------- joins with hot keys


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int, spread: Sequence[str],
                how: str = "left", share: int = 1000) -> DataFrame:
    """Give each row its group's columns where one group may hold a third of all rows.

    ``groups`` has one row per ``key``. Groups of more than ``n / share`` rows, of which there
    are fewer than ``share``, are broadcast; their rows then get a salt from ``spread`` and
    meet nothing in the shuffled join, so no task gets more than ``n / share`` rows of a key.
    """
    cols = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * share > n).select(key, *[F.col(c).alias(f"_hot_{c}") for c in cols])
    out = rows.join(F.broadcast(hot), key, "left")
    is_hot = F.col(f"_hot_{size}").isNotNull()
    salt = F.when(is_hot, 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 30))).otherwise(F.lit(0).cast("long"))
    cold = groups.withColumn("_salt", F.lit(0).cast("long"))
    out = out.withColumn("_salt", salt).join(cold, [key, "_salt"], "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_hot_{c}"), F.col(c)) for c in cols})
    out = out.drop("_salt", *[f"_hot_{c}" for c in cols])
    return out if how == "left" else out.filter(F.col(size).isNotNull())


def only_possible(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` that may have their ``key`` (long) in ``keys`` (``n`` rows): a map-side
    Bloom test that spares the rest of the rows a shuffle."""
    hashed = keys.select(F.xxhash64(F.col(key)).alias("_h"))
    out = possibly_in(df.withColumn("_h", F.xxhash64(F.col(key))), "_h", bloom_table(hashed, "_h", n), "_may")
    return out.drop("_h")


# ----------------------------------------------------------------- positions in an order


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: each row's position (from 0) in the ascending order of ``order`` (NULLs first).

    One range shuffle sorts the rows; a position is the row's place in its partition plus the rows
    of the partitions before it, which are as many numbers as there are partitions. Rows that are
    equal in ``order`` come in any order, and a hash of where they were read deals them to
    several partitions. The sorted rows are checkpointed, so that positions stay what they were.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    ordered = df.withColumn("_spread", spread).repartitionByRange(*order, "_spread").sortWithinPartitions(*order, "_spread")
    placed = cut_lineage(ordered.drop("_spread").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((row["part"], before))
        before += row["count"]
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    out = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, at).drop("_part", "_before", "_at")


# ----------------------------------------------------------------- Python blocks


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most ``BLOCK_ROWS`` rows and about ``BLOCK_CHARS`` characters (a longer
    text comes alone), with their texts; NULL becomes the empty text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, chars, texts = 0, 0, []
        for i in range(batch.num_rows):
            value = column[i].as_py() or ""
            if texts and (len(texts) >= BLOCK_ROWS or chars + len(value) > BLOCK_CHARS):
                yield batch.slice(start, len(texts)), texts
                start, chars, texts = i, 0, []
            texts.append(value)
            chars += len(value)
        if texts:
            yield batch.slice(start, len(texts)), texts


def map_texts(df: DataFrame, keep: Sequence[str], text: str, fn: Callable[[list[str]], dict[str, pa.Array]],
              fields: str) -> DataFrame:
    """``keep`` columns plus what ``fn`` makes of each block of texts (one value a row)."""
    src = df.select(*keep, F.col(text).alias("_text"))
    added = T._parse_datatype_string(fields)
    schema = T.StructType([src.schema[c] for c in keep] + list(added))
    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "_text"):
            made = fn(texts)
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [made[c] for c in names],
                                             names=[*keep, *names])

    return src.mapInArrow(run, schema)


# ----------------------------------------------------------------- components


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, comp)``: connected components of undirected ``links(a, b)`` (long), the least
    node naming each. Alternates large-star and small-star steps, every one a grouped
    minimum plus a join, until only stars are left; each round is checkpointed."""
    def oriented(df: DataFrame) -> DataFrame:
        return df.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(edges: DataFrame, n: int, large: bool) -> DataFrame:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size"))
        least = least.withColumn("m", F.least("m", "a"))
        joined = join_groups(near, least, "a", "size", n, ["b"])
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            # a points to its least neighbour, and so do its other neighbours
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b")))
        return oriented(out)

    def stand(df: DataFrame) -> tuple[int, bool]:
        """Edges, and whether some node is not yet in a star: it has two lesser neighbours, or a lesser and a greater."""
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                 F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        seen = df.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        n, open_ = seen.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        return n or 0, bool(open_)

    edges = cut_lineage(oriented(links))
    for _ in range(max_rounds):
        n, open_ = stand(edges)
        if not open_:
            break
        edges = cut_lineage(star(star(edges, 2 * n, True), n, False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
