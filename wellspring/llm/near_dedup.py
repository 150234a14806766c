"""Near dedup with ProbMinHash: signatures, banding, verification, classes.

Words are runs without white space; a text's elements are its distinct runs of
``SHINGLE`` words (a shorter text is one element), an element that occurs c times weighing
1 + ln c. Each element is a Poisson process with its weight as rate; arrivals fall on one of
``SIZE`` components, and a component keeps the element that arrives first. A process stops
when it is later than all components' arrivals. Two texts agree on a component with their
probability Jaccard similarity (``likeness``), whatever the scale of either's weights; without
repeated elements it is the Jaccard similarity of the sets. Pairs are held to the same measure.

1. Each distinct text (64-bit hash of its words) gets a signature and ``BANDS`` band hashes,
   in Arrow blocks with numpy. Copies are grouped first and take part once.
2. Texts that share a band are candidates. In each band bucket one member, the least by a
   hash made with the bucket, is compared with all others: as many pairs as members.
   As every bucket has its own, texts of a large group meet many of them. Pairs of
   ``FIRST_BANDS`` bands come first; of the others those whose ends are not in one class by then.
3. Pairs are verified: equal components first (a pair that the signatures put below
   ``LOOSE`` is 5 standard errors under the threshold), then exactly, the
   probability Jaccard similarity being ``THRESHOLD`` or more. Hubs meet their members in
   blocks, so a hub's signature or set travels once for ``BLOCK`` members.
4. Links join texts to classes (connected components). Members of a bucket that are in
   another class than most of it are then compared with the bucket's members of other
   classes, so that no candidate pair across classes stays unverified. They are compared
   in blocks of about ``BLOCK`` members: a row holds two blocks, and only links come out. Signatures
   come first, and only members with a likely partner bring their sets.
5. Documents take their text's class, named by its smallest doc_id; that document stays.

No step makes rows of all pairs of a group: step 4 compares only members that are not yet
linked, block by block. Texts are read again only for candidates, found by a Bloom filter on doc_id.

Defined results: NULL and empty texts are equal to each other; NULL doc_ids sort last;
rows that repeat doc_id and text are copies, and one of them is kept; if rows share a
doc_id with different texts the id's class is that of each text. Other columns are carried.
At 10**10 distinct texts under 3 pairs of 64-bit text hashes are expected to collide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import ngrams
from wellspring.llm.common import (Steps, blocks, bounded_batches, components, drop_unused, id_or_lowest,
                                   join_groups, map_texts, only_possible, plain_names)
from wellspring.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 30, 6
SIZE = BANDS * ROWS
THRESHOLD, LOOSE = 0.8, 0.65
#: Members of a bucket that are compared as one block.
BLOCK = 32
#: Members with a likely partner that a task holds, some 30 MB, before it tells them.
HELD = 200_000
#: Bands whose pairs are verified first; pairs of the others count only across the classes found by then.
FIRST_BANDS = 4

_U = np.uint64


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their texts' numbers and how often each occurs there; word hashes and where each text's start."""
    hashed, offsets = ngrams.words(texts)
    shingle, own = ngrams.runs(hashed, offsets, SHINGLE)
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(hashed[offsets[i]:offsets[i + 1]].tobytes(), digest_size=8).digest(),
                                         "little") for i in short], dtype=_U)
        shingle, own = np.concatenate([shingle, whole]), np.concatenate([own, short])
    order = np.lexsort((shingle, own))
    shingle, own = shingle[order], own[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order))) if len(order) else at
    return shingle[at], own[at], times, hashed, offsets


def weights(times: np.ndarray) -> np.ndarray:
    """The weight of an element that occurs so many times."""
    return 1.0 + np.log(times)


def likeness(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Probability Jaccard similarity: over the common elements i, the sum of
    1 / sum over all j of max(wx_j / wx_i, wy_j / wy_i). ``x`` and ``y`` hold each element once.

    The maximum is the second term for the j whose ratio wy / wx is above that of i, so with the
    common elements in order of their ratios the inner sums are running sums.
    """
    if not len(x) and not len(y):
        return 1.0
    _, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    cx, cy = wx[ix], wy[iy]
    order = np.argsort(cy / cx, kind="stable")
    cx, cy = cx[order], cy[order]
    up_to = wx.sum() - cx.sum() + np.cumsum(cx)
    above = wy.sum() - np.cumsum(cy)
    return float((1.0 / (up_to / cx + above / cy)).sum())


def signatures(shingle: np.ndarray, own: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Rows x SIZE: the element that arrives first at each component (0 for no elements)."""
    best, first = np.full(rows * SIZE, np.inf), np.zeros(rows * SIZE, _U)
    now, live, done = np.zeros(len(shingle)), np.arange(len(shingle)), 0
    while len(live):
        # one arrival each at first, many at once when few processes are left
        steps = 1 if done < 3 else 16
        with np.errstate(over="ignore"):
            seed = (np.arange(done + 1, done + steps + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[None, :]
            x = ngrams.mix(shingle[live][:, None] + seed)
            slot = ((ngrams.mix(x + _U(1)) >> _U(32)) * _U(SIZE) >> _U(32)).astype(np.int64)
        gap = -np.log(((x >> _U(11)).astype(float) + 0.5) * 2.0 ** -53) / weight[live][:, None]
        when = now[live][:, None] + np.cumsum(gap, axis=1)
        now[live] = when[:, -1]
        slot += own[live][:, None] * SIZE
        what = np.repeat(shingle[live], steps).reshape(-1, steps)
        sooner = when < best[slot]
        at, time, what = slot[sooner], when[sooner], what[sooner]
        np.minimum.at(best, at, time)
        won = time == best[at]
        first[at[won]] = what[won]
        limit = best.reshape(rows, SIZE).max(axis=1)
        live = live[now[live] < limit[own[live]]]
        done += steps
    return first.reshape(rows, SIZE)


def describe(texts: list[str]) -> dict[str, pa.Array]:
    """``key`` (hash of the words), ``n`` (distinct shingles), ``bands`` and ``sig`` (a byte a component)."""
    shingle, own, times, hashed, offsets = elements(texts)
    sig = signatures(shingle, own, weights(times), len(texts))
    value = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(texts), 1))
    for j in range(ROWS):
        with np.errstate(over="ignore"):
            value = ngrams.mix(value * _U(0x9E3779B97F4A7C15) + sig.reshape(len(texts), BANDS, ROWS)[:, :, j])
    n = np.bincount(own, minlength=len(texts))
    bands = [row if c else [] for row, c in zip(value.view(np.int64).tolist(), n)]
    small = ngrams.mix(sig).astype(np.uint8)
    return {"key": pa.array(_keys(hashed, offsets)), "n": pa.array(n.astype(np.int64)),
            "bands": pa.array(bands, pa.list_(pa.int64())), "sig": pa.array([r.tobytes() for r in small], pa.binary())}


def _keys(hashed: np.ndarray, offsets: np.ndarray) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(hashed[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _likely(batches):
    """The pairs of a hub and a block's members whose signatures agree on ``LOOSE`` of the components or more."""
    for batch in batches:
        hubs, keys, sizes = [], [], []
        for i in range(batch.num_rows):
            members = batch.column(2)[i].as_py()
            sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(-1, SIZE)
            own = next((k for k, m in enumerate(members) if m["own"]), None)
            if own is None:
                continue
            agree = (sig == sig[own]).mean(axis=1) >= LOOSE
            near = [m["key"] for m, yes in zip(members, agree) if yes and not m["own"]]
            hubs += [members[own]["key"]] * len(near)
            sizes += [batch.column(1)[i].as_py()] * len(near)
            keys += near
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hubs, sizes, keys)], names=["hub", "size", "key"])


def _similar(batches):
    """The pairs of a hub and a block's members that are ``THRESHOLD`` similar or more."""
    for batch in batches:
        a, b = [], []
        for i in range(batch.num_rows):
            members = batch.column(2)[i].as_py()
            hub = next((m for m in members if m["own"]), None)
            if hub is None:
                continue
            x = _weighted(hub["sh"])
            for m in members:
                if not m["own"] and _is_near(x, _weighted(m["sh"])):
                    a.append(min(hub["key"], m["key"]))
                    b.append(max(hub["key"], m["key"]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _hub_blocks(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``(hub, size, members)``: the members that ``pairs(hub, size, key)`` give a hub, about ``BLOCK`` in a
    row, and the hub itself in each; ``size`` is the most members that it may have.

    ``values(key, <value>)`` are joined to the members and, once for each block, to the hub. A hub of
    very many blocks has its value in several copies, so that no task makes all its blocks.
    """
    part = F.pmod(F.xxhash64("hub", "key"), F.ceil(F.col("size") / BLOCK))
    dealt = pairs.select("hub", "size", part.alias("part"), "key")
    far = F.shiftright("part", 10)
    rows = dealt.select("hub", "size", "part", "key", F.lit(False).alias("own"), F.lit(0).cast("long").alias("copy")).union(
        dealt.groupBy("hub", "part").agg(F.max("size").alias("size")).select(
            "hub", "size", "part", F.col("hub").alias("key"), F.lit(True), far.cast("long")))
    wide = cut_lineage(dealt.filter(far > 0).select(F.col("hub").alias("key"), far.cast("long").alias("copy")).distinct())
    copies = values.withColumn("copy", F.lit(0).cast("long")).select("key", "copy", value)
    if wide.take(1):
        copies = copies.union(wide.join(values, "key").select("key", "copy", value))
    met = rows.join(copies, ["key", "copy"])
    return met.groupBy("hub", "part").agg(F.max("size").alias("size"),
                                          F.collect_list(F.struct("own", "key", value)).alias("members")).select(
        "hub", "size", "members")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, doc_id: str, text: str, steps: Steps) -> DataFrame:
    """``(a, b)``, checkpointed: the ``pairs(hub, size, key)`` of text keys that are similar."""
    likely = _hub_blocks(pairs, nodes.select("key", "sig"), "sig")
    likely = cut_lineage(likely.mapInArrow(_likely, "hub bigint, size bigint, key bigint"))
    sets = steps.keep("sets", _sets(docs, nodes, likely.select("hub").union(likely.select("key")), doc_id, text))
    out = _hub_blocks(likely, sets, "sh").mapInArrow(_similar, "a bigint, b bigint")
    out = cut_lineage(out.distinct())
    del likely, sets
    steps.drop("sets")
    return out


def _sets(docs: DataFrame, nodes: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(key, sh)``: the sets of shingles of the texts whose keys are in the only column of ``keys``."""
    found = _texts(docs, nodes, keys.toDF("key"), doc_id, text)
    return map_texts(found, ["key"], "_text", _shingle_bytes, "sh binary").dropDuplicates(["key"])


def _texts(docs: DataFrame, nodes: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(key, _text)`` of the texts named, each by the document that stands for it."""
    used = cut_lineage(keys.distinct().join(nodes.select("key", "rep"), "key"))

    def keyed(batches):
        for part, texts in blocks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_keys(*ngrams.words(texts))), part.column(1)],
                                             names=["_id", "_key", "_text"])

    src = docs.select(id_or_lowest(F.col(doc_id)).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    src = only_possible(src, "_id", used.select(F.col("rep").alias("_id")), used.count()).filter("_may").drop("_may")
    found = src.mapInArrow(keyed, "_id bigint, _key bigint, _text string")
    found = found.join(used.select(F.col("key").alias("_key"), F.col("rep").alias("_id")), ["_key", "_id"], "left_semi")
    return found.select(F.col("_key").alias("key"), "_text")


def _shingle_bytes(texts: list[str]) -> dict[str, pa.Array]:
    """Each text's shingles in order (8 bytes each), then how often they occur (4 bytes each)."""
    shingle, own, times, _, _ = elements(texts)
    at = np.searchsorted(own, np.arange(len(texts) + 1))
    times = times.astype(np.uint32)
    return {"sh": pa.array([shingle[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())}


def _weighted(sh: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights as ``_shingle_bytes`` packs them."""
    n = len(sh) // 12
    return np.frombuffer(sh, _U, n), weights(np.frombuffer(sh, np.uint32, n, 8 * n))


def _is_near(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    # a sum of fractions may miss a threshold that it meets exactly by some last bits
    return likeness(*x, *y) >= THRESHOLD - 1e-9


def _can_be(x: list[dict], y: list[dict]) -> np.ndarray:
    """Which members of two blocks are of different classes and agree on ``LOOSE`` of the components or more."""
    sx, sy = (np.frombuffer(b"".join(m["sig"] for m in side), np.uint8).reshape(-1, SIZE) for side in (x, y))
    cx, cy = (np.array([m["comp"] for m in side]) for side in (x, y))
    return (cx[:, None] != cy[None, :]) & ((sx[:, None, :] == sy[None, :, :]).mean(axis=2) >= LOOSE)


def _meeting(batches):
    """``(bucket, key)`` of the members of two blocks that have a likely partner in the other. A member meets
    many blocks: a task holds up to ``HELD`` members and tells each of them once."""
    def told(met):
        rows = sorted(met)
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in (0, 1)], names=["bucket", "key"])

    met = set()
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, x, y = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            can = _can_be(x, y)
            met.update((bucket, m["key"]) for side, any_ in ((x, can.any(axis=1)), (y, can.any(axis=0)))
                       for m, yes in zip(side, any_) if yes)
            if len(met) >= HELD:
                yield told(met)
                met = set()
    yield told(met)


def _compare(batches):
    """Links between the members of two blocks that are of different classes."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            x, y = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            can = _can_be(x, y)
            theirs = {c: _weighted(y[c]["sh"]) for c in np.flatnonzero(can.any(axis=0))}
            for r in np.flatnonzero(can.any(axis=1)):
                mine = _weighted(x[r]["sh"])
                out += [sorted((x[r]["key"], y[c]["key"])) for c in np.flatnonzero(can[r]) if _is_near(mine, theirs[c])]
        yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["a", "b"])


def _facing(at: DataFrame, values: DataFrame, cols: list[str], steps: Steps) -> DataFrame:
    """``(bucket, x, y)``: each block of a bucket's members outside its largest class with each of its blocks.
    Blocks are balanced by hash and kept as the step ``held``."""
    part = F.pmod(F.xxhash64("key", "bucket"), F.ceil(F.col("size") / BLOCK))
    held = at.join(values, "key").groupBy("bucket", part.alias("part")).agg(
        F.collect_list(F.struct("key", "comp", (F.col("comp") == F.col("main")).alias("main"), *cols)).alias("y"))
    held = steps.keep("held", held.select("bucket", "y"))
    open_ = held.select("bucket", F.filter("y", lambda m: ~m["main"]).alias("x")).filter(F.size("x") > 0)
    return open_.join(held, "bucket").select("bucket", "x", "y")


def _links_left(docs: DataFrame, nodes: DataFrame, members: DataFrame, comps: DataFrame, doc_id: str,
                text: str, steps: Steps) -> DataFrame:
    """Links across classes inside buckets, checkpointed."""
    at = members.select("bucket", "key").join(comps.select(F.col("node").alias("key"), "comp"), "key", "left")
    at = steps.keep("at", at.select("bucket", "key", F.coalesce("comp", "key").alias("comp")))
    size = at.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    split = size.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"),
                                       F.sum("c").alias("size"))
    split = cut_lineage(split.filter("comps > 1").select("bucket", F.col("m.comp").alias("main"), "size"))
    mixed = steps.keep("mixed", join_groups(at, split, "bucket", "size", max(1, at.count()), ["key"], how="inner"))
    del at, size, split
    steps.drop("at")
    # by signatures first: only members with a likely partner bring their sets into the buckets
    facing = _facing(mixed, nodes.select("key", "sig"), ["sig"], steps)
    likely = cut_lineage(facing.mapInArrow(_meeting, "bucket bigint, key bigint").distinct())
    del facing
    steps.drop("held")
    few = steps.keep("few", mixed.join(likely, ["bucket", "key"], "left_semi"))
    del mixed, likely
    steps.drop("mixed")
    sets = _sets(docs, nodes, few.select("key"), doc_id, text).join(nodes.select("key", "sig"), "key")
    facing = _facing(few, steps.keep("sets", sets), ["sig", "sh"], steps)
    out = cut_lineage(facing.mapInArrow(_compare, "a bigint, b bigint").distinct())
    del facing, sets, few
    steps.drop("held", "sets", "few")
    return out


def _star(members: DataFrame) -> DataFrame:
    """``(hub, size, key)``: each member of a bucket with the bucket's hub."""
    hubs = members.filter("first").select("bucket", F.col("key").alias("hub"), "size")
    star = join_groups(members.filter("not first").select("bucket", "key"), hubs, "bucket", "size",
                       max(1, members.count()), ["key"], how="inner")
    return star.groupBy("hub", "key").agg(F.max("size").alias("size")).select("hub", "size", "key")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one class yet. Hubs of many members are broadcast with their class."""
    of = comps.select("node", "comp")
    sides = pairs.join(of.select(F.col("node").alias("key"), F.col("comp").alias("mine")), "key", "left")
    hubs = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    hubs = hubs.join(of.select(F.col("node").alias("hub"), F.col("comp").alias("theirs")), "hub")
    sides = join_groups(sides, cut_lineage(hubs), "hub", "n", max(1, pairs.count()), ["key"])
    return sides.filter(~F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False))).select("hub", "size", "key")


def _stars(comps: DataFrame) -> DataFrame:
    """Classes as links: they are stars already, and a few rounds join them."""
    return comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (its class's smallest doc_id), class_size (documents),
    n_verified (pairs of its text that were compared and found similar; members of one class that no
    comparison needed are not among them) and kept (one document of each class)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    steps = Steps(spark, "near")
    docs = docs.select(doc_id, text)
    rows = map_texts(docs.select(id_or_lowest(F.col(doc_id)).alias("id"), F.col(doc_id).isNull().alias("no_id"), text),
                     ["id", "no_id"], text, describe, "key bigint, n bigint, bands array<bigint>, sig binary")
    full = steps.keep("full", rows)
    rows = cut_lineage(full.select("id", "no_id", "key"))
    first = rows.groupBy("key").agg(F.min(F.struct("no_id", "id")).alias("f"), F.count(F.lit(1)).alias("copies"))
    nodes = first.select("key", F.col("f.id").alias("rep"), F.col("f.no_id").alias("no_id"), "copies")
    what = full.join(nodes.select("key", F.col("rep").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key"])
    nodes = steps.keep("nodes", nodes.join(what.select("key", "bands", "sig"), "key"))
    del full, what, first
    steps.drop("full")

    bands = nodes.select(F.posexplode("bands").alias("band", "bucket"), "key")
    bands = bands.withColumn("turn", F.xxhash64("bucket", "key"))
    shared = bands.groupBy("bucket").agg(F.min("turn").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = steps.keep("shared", shared)
    members = join_groups(bands, shared, "bucket", "size", max(1, BANDS * nodes.count()), ["key"], how="inner")
    members = steps.keep("members", members.select(
        "band", "bucket", "key", "size", (F.col("turn") == F.col("least")).alias("first")))
    del bands, shared
    steps.drop("shared")

    # most members of a class meet in the first bands; of the others only pairs across classes are left
    links = verified(docs, nodes, _star(members.filter(F.col("band") < FIRST_BANDS)), doc_id, text, steps)
    comps = cut_lineage(components(links))
    rest = cut_lineage(_across(_star(members.filter(F.col("band") >= FIRST_BANDS)), comps))
    drop_unused(spark)
    more = verified(docs, nodes, rest, doc_id, text, steps)
    if more.take(1):
        links, comps = cut_lineage(links.union(more).distinct()), cut_lineage(components(_stars(comps).union(more)))
    drop_unused(spark)
    more = _links_left(docs, nodes, members, comps, doc_id, text, steps)
    del members, rest
    steps.drop("members")
    if more.take(1):
        links, comps = cut_lineage(links.union(more).distinct()), cut_lineage(components(_stars(comps).union(more)))

    ends = links.select(F.col("a").alias("key")).union(links.select("b")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_verified"))
    texts = nodes.select("key", "rep", "no_id", "copies").join(
        comps.select(F.col("node").alias("key"), "comp"), "key", "left").join(ends, "key", "left")
    texts = cut_lineage(texts.select("key", "rep", "no_id", "copies", F.coalesce("comp", "key").alias("comp"),
                                     F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified")))
    whole = texts.groupBy("comp").agg(F.min(F.struct("no_id", "rep", "key")).alias("head"),
                                      F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    texts = join_groups(texts, cut_lineage(whole), "comp", "class_size", max(1, rows.count()), ["key"])
    texts = cut_lineage(texts.select("key", "copies", "n_verified", "class_size", "head"))
    del nodes
    steps.drop("nodes")
    # rows that repeat id and text are alike: their number is enough
    same = rows.groupBy("key", "id", "no_id").agg(F.count(F.lit(1)).alias("times"))
    out = join_groups(same, texts, "key", "copies", max(1, rows.count()), ["id"])
    out = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    real = lambda i, none: F.when(~none, i)
    return out.select(real(F.col("id"), F.col("no_id")).alias("doc_id"),
                      real(F.col("head.rep"), F.col("head.no_id")).alias("class_id"), "class_size", "n_verified",
                      ((F.col("id") == F.col("head.rep")) & (F.col("no_id") == F.col("head.no_id"))
                       & (F.col("key") == F.col("head.key")) & (F.col("time") == 1)).alias("kept"), F.col("key").alias("text_key"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays for each class, with their columns as they came.

    Only rows whose doc_id may be among those that lose a row are shuffled.
    """
    docs, (doc_id, text), names = plain_names(docs, doc_id, text)
    cols = docs.columns
    judged = classes(docs, doc_id, text).select(id_or_lowest(F.col("doc_id")).alias("_id"), "kept", "text_key")
    judged = cut_lineage(judged)
    drop_unused(docs.sparkSession)
    ids = judged.groupBy("_id").agg(F.sum(F.col("kept").cast("int")).alias("_kept"), F.count(F.lit(1)).alias("_all"))
    ids = cut_lineage(ids.filter("_kept < _all").withColumnRenamed("_id", "_lost"))
    marked = docs.withColumn("_lost", id_or_lowest(F.col(doc_id)))
    marked = only_possible(marked, "_lost", ids, ids.count())
    met = marked.filter("_may").join(ids, "_lost", "left")
    # an id that keeps some of its rows: told apart by their texts
    mixed = map_texts(met.filter("_kept > 0"), [*cols, "_lost"], text, lambda texts: {
        "_key": pa.array(_keys(*ngrams.words(texts)))}, "_key bigint")
    winners = judged.filter("kept").select(F.col("_id").alias("_lost"), F.col("text_key").alias("_key"))
    mixed = mixed.join(winners, ["_lost", "_key"], "left_semi").dropDuplicates(["_lost", "_key"])
    return marked.filter("not _may").select(*cols).union(
        met.filter("_kept is null").select(*cols)).union(mixed.select(*cols)).toDF(*names)
