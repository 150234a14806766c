"""Order MinHash: fingerprints of texts whose likeness follows edit distance.

A text's k-mers (of code points) carry their number of occurrence, so that repeats count. For each
of ``m`` sketches a hash orders the numbered k-mers; the ``picks`` least are selected, put back into
the order in which the text has them, and hashed as a tuple. Two texts share a sketch where they
share those k-mers in the same order, which insertions, deletions and replacements spoil in
proportion, and moved passages spoil too. Likeness is the share of equal sketches.

``neighbours`` fingerprints every text, the text after an edit that borrows from the next
document, and compares it with the next one's. Rows are dealt by ranges of ids and sorted descending, so
each task has met the next document when it comes to a row and holds two texts at a time; each range gets one
more row, the first document of the next range. An id with many rows gets ranges of its own,
dealt by hash.

Defined results: NULL counts as the empty text; a text of fewer than ``k`` code points is one k-mer;
a text of fewer than ``picks`` k-mers gives the tuple of what it has; equal texts have equal
fingerprints. A NULL id comes first. The next document is the one of the next greater id (after the greatest: the
least), and of several rows of that id, the least text; so rows of one id share it, and a lone id is its own next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import bounded_batches, id_or_lowest

#: Code points of a k-mer, k-mers of a sketch, sketches of a fingerprint.
K = 8
PICKS = 2
SKETCHES = 32

#: Numbered k-mers hashed for all sketches at a time.
_CHUNK = 1 << 11

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NUMBERS = np.arange(1, SKETCHES + 1, dtype=np.uint64)
#: A sketch orders 32-bit hashes ``x`` by ``(x ^ seed) * factor``, factors being odd.
_SEEDS = ((_NUMBERS * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)[:, None]
_FACTORS = (((_NUMBERS * _MIX) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]


# ----------------------------------------------------------------- fingerprints


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kmer_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-mers of code points (of the whole where there are fewer than k)."""
    k = min(k, len(points))
    n = len(points) - k + 1
    wide = points.astype(np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * _MIX + wide[j:j + n]
    return _mixed(out)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes come before each."""
    n = len(hashes)
    bits = np.uint64(n.bit_length())
    # one sort by the hash's high bits, then by place
    packed = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[1:] = (packed[1:] >> bits) != (packed[:-1] >> bits)
    out = np.empty(n, dtype=np.uint64)
    out[place] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _least(ranks: np.ndarray) -> list[np.ndarray]:
    """Places of the PICKS least numbers of each row (of ties the first); -1 where there are none left."""
    rows, found = np.arange(len(ranks)), []
    for pick in range(PICKS):
        if pick >= ranks.shape[1]:
            found.append(np.full(len(ranks), -1))
            continue
        at = ranks.argmin(axis=1)
        found.append(at)
        if pick + 1 < PICKS:
            ranks[rows, at] = np.iinfo(np.uint32).max
    return found


def signature(points: np.ndarray) -> np.ndarray:
    """The fingerprint of code points: SKETCHES 64-bit hashes."""
    if not len(points):
        return np.zeros(SKETCHES, dtype=np.uint64)
    hashes = kmer_hashes(points)
    numbered = _mixed(hashes + occurrences(hashes) * _MIX)
    short = (numbered >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(SKETCHES)[:, None]
    best = np.empty((SKETCHES, 0), dtype=np.int64)
    for start in range(0, len(short), _CHUNK):  # the least of each chunk, then the least of those
        ranks = (short[None, start:start + _CHUNK] ^ _SEEDS) * _FACTORS
        places = np.stack([p for p in _least(ranks) if p[0] >= 0], axis=1) + start
        best = np.concatenate((best, places), axis=1)
    if best.shape[1] > PICKS:
        best.sort(axis=1)
        ranks = (short[best] ^ _SEEDS) * _FACTORS
        best = best[rows, np.stack(_least(ranks), axis=1)]
    best.sort(axis=1)  # back into the text's order
    out = np.full(SKETCHES, best.shape[1], dtype=np.uint64)
    for pick in range(best.shape[1]):
        out = _mixed(out * _MIX + numbered[best[:, pick]])
    return out


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(sketches: np.ndarray) -> str:
    return sketches.astype(">u8").tobytes().hex()


# ----------------------------------------------------------------- documents and their neighbours


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first code points of ``following``, or all of it."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _range_of(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by halving."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.try_element_at(table, at + step) <= key, F.lit(False)), at + step).otherwise(at))


def ranges(df: DataFrame, key: Column, text: str, share: int = 200, salts: int = 64) -> DataFrame:
    """Rows ``(_range, _part, _last, _key, <columns>)``: every row of ``df``, and for each part of each range one row
    (``_last``) with the first document of the next range. Only ids with more than 1 / ``share`` of
    the rows have several parts. Bounds and first ids, at most as many as shuffle partitions and twice
    ``share``, go through the driver."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = df.select(key.alias("_key"))
    at = [i / parts for i in range(1, parts)]
    n, cuts = ids.agg(F.count(F.lit(1)), F.percentile_approx("_key", at, 10 * parts)).first()
    sizes = ids.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    hot = [r["_key"] for r in sizes.filter(F.col("n") * share > n).select("_key").collect()]
    bounds = sorted({*(cuts or []), *hot, *(h + 1 for h in hot)})
    number = _range_of(bounds, F.col("_key"))
    firsts = ids.groupBy(number.alias("_range")).agg(F.min("_key").alias("first")).orderBy("_range").collect()
    busy = {bounds.index(h) + 1 for h in hot}

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    part = F.when(F.col("_range").isin(*busy), salt).otherwise(F.lit(0)) if busy else F.lit(0)
    rows = df.withColumn("_key", key).withColumn("_range", number).withColumn("_part", part).withColumn("_last", F.lit(False))

    # the first document of each range goes to the end of every part of the range before
    guards = [(firsts[(i + 1) % len(firsts)]["first"], r["_range"], p) for i, r in enumerate(firsts)
              for p in (range(salts) if r["_range"] in busy else [0])]
    places = spark.createDataFrame(guards, "_key long, _range int, _part int")
    first = rows.join(F.broadcast(places.select("_key").distinct()), "_key", "left_semi")
    first = first.groupBy("_key").agg(F.min(F.coalesce(text, F.lit(""))).alias(text))
    last = first.join(F.broadcast(places), "_key").withColumn("_last", F.lit(True))
    return rows.unionByName(last, allowMissingColumns=True)


_FIELDS = ("n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")


def neighbours(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``n_chars``, ``edited`` (the text whose last quarter comes from the next document),
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``, likeness of the
    fingerprint to the edited text's and the next document's."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    dealt = ranges(src, id_or_lowest(F.col("id")), "text")
    # a range's last row has no greater key but in the range that wraps around, where it is the least
    dealt = (dealt.repartitionByRange("_range", "_part")
             .sortWithinPartitions("_range", "_part", F.col("_last").desc(), F.col("_key").desc(), "text"))
    dealt = dealt.select("_range", "_part", "_last", "_key", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = current = None
        now = after = ("", None)  # the least text of the current id and of the next one
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                place, part, last, key, doc, value = (c[i].as_py() for c in columns)
                body = value or ""
                points = points_of(body)
                own = signature(points)
                if (place, part) != where or last:
                    where, current, now = (place, part), None, (body, own)
                    if last:
                        continue
                if key != current:
                    current, after, now = key, now, (body, own)
                changed = edited(body, after[0])
                theirs = signature(points_of(changed))
                out.append((doc, len(body), changed, as_text(own), as_text(theirs), likeness(own, theirs),
                            likeness(own, after[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.mapInArrow(run, f"id long, {_FIELDS}").withColumnRenamed("id", id_col)
