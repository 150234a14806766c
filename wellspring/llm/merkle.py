"""A Merkle manifest of a table: every row's digest, the roots over them, and a proof for each row.

Each group of rows (a language) has its own tree over its rows in ascending order, ``FAN``
children to a node; the groups' roots, in the order of the groups, are the leaves of one more
tree. A proof is a list of steps from the leaf to the root: the place of the node among its
siblings and the siblings' digests.

Proofs come by pointer jumping. At first each inner node points to its parent and holds one
step. A self-join replaces each node's pointer by the pointer of the node it points to and
appends that node's steps, so pointers reach twice as far in every round, until all reach the
root; leaves then take the steps of the node above them. Rounds are the logarithm of the depth.
No node has more than ``FAN`` children, so nothing is collected beyond that; groups of any size
are numbered by one range sort, and an ancestor that many nodes point to meets them by broadcast
(``_meet``).

Defined results: NULL fields count as ``-``; a NULL order value or group comes first; rows with
the same group and order value follow their digests, and rows that are equal in all are leaves of
their own; a table without rows gives no rows; other columns of the table are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import numbered
from wellspring.session import cut_lineage

#: Children of a node.
FAN = 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<pos:int,siblings:array<string>>>"


def row_digest(fields: Sequence[str | Column]) -> Column:
    """sha256 (hex) over the fields: ``-`` for NULL, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for field in fields:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _step(kids: Column, kid: Column, field: str) -> Column:
    """The step past the node over ``kids`` for one of them."""
    others = F.filter(kids, lambda k: k["pos"] != kid["pos"])
    return F.struct(kid["pos"].alias("pos"), F.transform(others, lambda k: k[field]).alias("siblings"))


def _families(nodes: DataFrame, *extra: Column) -> DataFrame:
    """Nodes ``(tree, idx, width, digest, ...)`` by parent: ``(tree, idx, width, kids)``, kids in order."""
    kid = F.struct((F.col("idx") % FAN).cast("int").alias("pos"), "digest", *extra)
    return (nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("up"), "width")
            .agg(F.array_sort(F.collect_list(kid)).alias("kids")).withColumnRenamed("up", "idx"))


def _above(families: DataFrame, level: int) -> DataFrame:
    """The parents as nodes; ``width`` is the number of nodes on the tree's level."""
    return families.select("tree", "idx", F.ceil(F.col("width") / FAN).alias("width"),
                           _joined(F.col("kids.digest")).alias("digest"), _key(level).alias("key"))


def _key(level: int) -> Column:
    return F.concat_ws("/", "tree", F.lit(str(level)), "idx")


def _grow(nodes: DataFrame, width: int, level: int) -> tuple[list[DataFrame], DataFrame]:
    """Builds the trees above ``nodes`` (at most ``width`` wide): links ``(key, anc, steps)`` of each
    level, and the trees' roots ``(tree, digest, key)``."""
    links, roots = [], nodes.filter("width = 1").select("tree", "digest", "key")
    while width > 1:
        level, width = level + 1, -(-width // FAN)
        families = cut_lineage(_families(nodes.filter("width > 1"), F.col("key")))
        kid = families.select(_key(level).alias("anc"), "kids", F.explode("kids").alias("kid"))
        links.append(kid.select("kid.key", "anc", F.array(_step(F.col("kids"), F.col("kid"), "digest")).alias("steps")))
        nodes = _above(families, level)
        roots = roots.union(nodes.filter("width = 1").select("tree", "digest", "key"))
    return links, roots


def _gathered(parts: Sequence[DataFrame]) -> DataFrame:
    """The union, in no more partitions than a shuffle has: without that, each union adds its inputs' partitions up."""
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.coalesce(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _meet(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with the one row of ``groups`` by ``key``. Groups of more than ``n / share`` of the ``n``
    rows, fewer than ``share``, are broadcast, and their rows stay out of the shuffled join."""
    is_hot = F.col(size) * share > n
    hot = groups.filter(is_hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).union(rest.join(groups.filter(~is_hot), key))


def paths_to_root(links: DataFrame, root: str, depth: int) -> DataFrame:
    """``(key, steps)`` from every node to ``root`` by pointer jumping over ``links(key, anc, steps)``."""
    state = links
    reach = 1
    while reach < depth:
        n = state.count()
        open_ = state.filter(F.col("anc") != root)
        sizes = open_.groupBy("anc").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("anc", "key")
        far = state.join(sizes, "key").select(F.col("key").alias("anc"), F.col("anc").alias("far"),
                                              F.col("steps").alias("more"), "size")
        jumped = _meet(open_, cut_lineage(far), "anc", "size", n)
        jumped = jumped.select("key", F.col("far").alias("anc"), F.concat("steps", "more").alias("steps"))
        state = cut_lineage(_gathered([jumped, state.filter(F.col("anc") == root)]))
        reach *= 2
    return state.select("key", "steps")


def manifest(df: DataFrame, order: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
             carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: ``order`` column, ``leaf``, the ``carry`` columns (computed from the
    row), ``subroot`` of its group, ``root`` and the proof's ``steps`` from leaf to root."""
    carry = dict(carry or {})
    rows = df.select(F.col(group).alias("_group"), F.col(order).alias("_order"), row_digest(fields).alias("digest"),
                     F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in carry.items()]).alias("_carry"))
    rows = numbered(cut_lineage(rows), ["_group", "_order", "digest"], "_pos")
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_group")), F.lit("")))
    groups = rows.groupBy("_key").agg(F.first("_group").alias("_group"), F.min("_pos").alias("_first"),
                                      F.count(F.lit(1)).alias("width"))
    groups = cut_lineage(numbered(groups, ["_group"], "tree").select("_key", "tree", "_first", "width"))
    n, trees, width = groups.agg(F.sum("width"), F.count(F.lit(1)), F.max("width")).first()

    rows = _meet(rows.drop("_group"), groups, "_key", "width", n or 0)
    rows = rows.withColumn("idx", F.col("_pos") - F.col("_first"))
    bottom = cut_lineage(_families(rows, F.col("_order"), F.col("_carry")))
    lone = F.col("width") == 1
    nodes = bottom.select("tree", "idx", F.ceil(F.col("width") / FAN).alias("width"), _key(1).alias("key"),
                          F.when(lone, F.col("kids")[0]["digest"]).otherwise(_joined(F.col("kids.digest"))).alias("digest"))
    links, subroots = _grow(nodes, -(-(width or 0) // FAN), 1)
    subroots = cut_lineage(subroots)
    top = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"),
                          F.lit(trees).cast("long").alias("width"), "digest", "key")
    top_links, roots = _grow(top, trees, 0)
    root = roots.first()

    trunks = groups.select("tree", F.col("width").alias("_size")).join(
        subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    bottom = _meet(bottom, trunks, "tree", "_size", n or 0).withColumn("key", _key(1)).drop("_size")
    links += top_links
    if links:
        paths = paths_to_root(cut_lineage(_gathered(links)), root["key"], len(links))
        bottom = bottom.join(paths, "key", "left")
    else:
        bottom = bottom.withColumn("steps", F.lit(None).cast(_STEP))
    out = bottom.select("subroot", "width", "kids", "steps", F.explode("kids").alias("kid"))
    own = F.when(F.col("width") == 1, F.array().cast(_STEP)).otherwise(
        F.array(_step(F.col("kids"), F.col("kid"), "digest")))
    steps = F.concat(own, F.coalesce("steps", F.array().cast(_STEP)))
    return out.select(F.col("kid._order").alias(order), F.col("kid.digest").alias("leaf"),
                      *[F.col(f"kid._carry.{name}").alias(name) for name in carry], "subroot",
                      F.lit(root["digest"] if root else None).cast("string").alias("root"), steps.alias("steps"))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    def up(node: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], F.lit(1), step["pos"])
        after = F.slice(step["siblings"], step["pos"] + 1, F.size(step["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")), 256)
    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    """sha256 over the siblings' digests, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: s["siblings"])), ""), 256)
