"""Text -> cluster routing and cluster -> track lookups (ML7-ML10, JOI1-JOI3).

TF-IDF routing fits the vectoriser on the profile documents plus the one
query, exactly as a per-query fit would, but in batch: with P profiles,
n = P + 1 and df(t) = df_profiles(t) + [t in query], so only the idf of terms
shared with the query changes. Per (query, cluster):

    dot    = sum_{t in q and c} tf_q tf_c idf1(t)^2
    |p_c|^2 = base_c - sum_{t in q and c} tf_c^2 (idf0(t)^2 - idf1(t)^2)

The profile tables are bounded (k clusters x a few snippets), so they are
broadcast; query terms are counted in-row and joined by hash.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, default_stop_words
from ..sources.dims import TRACKS
from .topics import remove_stop_words


def _term_rows(df: DataFrame, keys: Sequence[str], text_col: str, stop_words, tf_name: str) -> DataFrame:
    """(keys..., term, tf): tokens exploded and counted per key (a partial
    aggregation; copies of a term inside one text combine map-side)."""
    t = remove_stop_words(df.select(*keys, T.tokens(text_col).alias("_tok")), "_tok", "_terms", stop_words)
    t = t.select(*keys, F.explode("_terms").alias("term"))
    return t.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias(tf_name))


def tfidf_similarities(queries: DataFrame, profiles: DataFrame, qkeys: Sequence[str],
                       text_col: str = "text", profile_col: str = "profile",
                       stop_words: Sequence[str] | None = None) -> DataFrame:
    """ML8: (qkeys..., cluster_id, similarity) for clusters sharing a term."""
    qkeys = list(qkeys)
    n_prof = profiles.count()
    n = n_prof + 1
    pt = _term_rows(profiles, ["cluster_id"], profile_col, stop_words, "tf_c")
    dfp = pt.groupBy("term").agg(F.count(F.lit(1)).alias("dfp"))
    idf0 = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("dfp"))) + 1
    idf1 = F.log((F.lit(1.0) + n) / (F.lit(2.0) + F.coalesce(F.col("dfp"), F.lit(0)))) + 1
    prof = pt.join(dfp, "term").withColumn("idf0", idf0).withColumn("idf1", idf1)
    base = prof.groupBy("cluster_id").agg(F.sum((F.col("tf_c") * F.col("idf0")) ** 2).alias("base"))
    qt = _term_rows(queries, qkeys, text_col, stop_words, "tf_q")
    qt = qt.join(F.broadcast(dfp), "term", "left").withColumn("idf1", idf1)
    qnorm = qt.groupBy(*qkeys).agg(F.sqrt(F.sum((F.col("tf_q") * F.col("idf1")) ** 2)).alias("qnorm"))
    shared = (qt.select(*qkeys, "term", "tf_q")
                .join(F.broadcast(prof.select("term", "cluster_id", "tf_c", "idf0", "idf1")), "term")
                .groupBy(*qkeys, "cluster_id")
                .agg(F.sum(F.col("tf_q") * F.col("tf_c") * F.col("idf1") * F.col("idf1")).alias("dot"),
                     F.sum(F.col("tf_c") * F.col("tf_c") * (F.col("idf0") ** 2 - F.col("idf1") ** 2)).alias("corr")))
    sims = (shared.join(qnorm, qkeys).join(F.broadcast(base), "cluster_id")
                  .withColumn("pnorm", F.sqrt(F.col("base") - F.col("corr"))))
    sim = F.when((F.col("qnorm") > 0) & (F.col("pnorm") > 0), F.col("dot") / (F.col("qnorm") * F.col("pnorm"))).otherwise(0.0)
    return sims.select(*qkeys, "cluster_id", sim.alias("similarity"))


def embedding_similarities(queries: DataFrame, profiles: DataFrame, qkeys: Sequence[str],
                           q_emb: str = "embedding", p_emb: str = "embedding") -> DataFrame:
    """ML7: cosine of each query embedding with the k profile embeddings.
    The profile vectors (k x d, bounded) enter as one scalar subquery and
    each query row computes its k scores in-row; no join."""
    arr = profiles.agg(F.collect_list(F.struct("cluster_id", F.col(p_emb).alias("e"))).alias("p")).scalar()
    q = F.col(q_emb)
    sims = F.transform(F.col("_prof"), lambda p: F.struct(p["cluster_id"].alias("cluster_id"),
                                               cosine(q, p["e"]).alias("similarity")))
    return queries.withColumn("_prof", arr).select(*qkeys, F.inline(sims))


def top_matches(queries: DataFrame, sims: DataFrame, profiles: DataFrame, qkeys: Sequence[str],
                k: int = 3, method: str = "tfidf") -> DataFrame:
    """ML9/SRT3: best cluster, its similarity (4 dp) and the top ``k``;
    ties go to the higher cluster id; clusters sharing nothing with a query
    have similarity 0 and fill the list from the highest id down."""
    qkeys = list(qkeys)
    labels = F.broadcast(profiles.select("cluster_id", "cluster_label"))
    all_ids = profiles.agg(F.sort_array(F.collect_list("cluster_id"), asc=False).alias("ids")).scalar()
    ranked = (sims.filter(F.col("similarity") > 0)
                  .groupBy(*qkeys)
                  .agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("_ns"),
                                                            (-F.col("cluster_id")).alias("_nc"),
                                                            "cluster_id", "similarity"))).alias("_m")))
    out = queries.select(*qkeys).join(ranked, qkeys, "left").withColumn("_all_ids", all_ids)
    matched = F.coalesce(F.col("_m"), F.array().cast(ranked.schema["_m"].dataType.simpleString()))
    matched_ids = F.transform(matched, lambda m: m["cluster_id"])
    fill = F.transform(F.filter(F.col("_all_ids"), lambda c: ~F.array_contains(matched_ids, c)),
                       lambda c: F.struct(c.alias("cluster_id"), F.lit(0.0).alias("similarity")))
    top = F.slice(F.concat(F.transform(matched, lambda m: F.struct(m["cluster_id"].alias("cluster_id"),
                                                                    m["similarity"].alias("similarity"))), fill), 1, k)
    out = out.withColumn("_top", top).drop("_m", "_all_ids")
    best = F.try_element_at(F.col("_top"), F.lit(1))
    return (out.withColumn("cluster_id", best["cluster_id"])
               .withColumn("similarity", F.round(best["similarity"], 4))
               .withColumn("method", F.lit(method))
               .withColumn("top_matches", F.transform("_top", lambda m: F.struct(
                   m["cluster_id"].alias("cluster_id"), F.round(m["similarity"], 4).alias("similarity"))))
               .drop("_top")
               .join(labels, "cluster_id", "left"))


def track_memberships(spark) -> DataFrame:
    """(cluster_id, track_id, track_ord) from the fixed track table."""
    rows = [(cid, tid, i) for i, (tid, cids, _) in enumerate(TRACKS) for cid in cids]
    return spark.createDataFrame(rows, "cluster_id int, track_id string, track_ord int")


def cluster_tracks(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """JOI1/JOI2: all tracks covering each cluster (in track order; empty when
    none) and the first one. Broadcast left join on the fixed 19-row table,
    then one aggregation per distinct cluster."""
    tm = F.broadcast(track_memberships(df.sparkSession).withColumnRenamed("cluster_id", cluster_col))
    ids = df.select(cluster_col).distinct()
    j = ids.join(tm, cluster_col, "left")
    agg = j.groupBy(cluster_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("track_id").isNotNull(),
                                           F.struct("track_ord", "track_id")))).alias("_t"))
    return agg.select(cluster_col, F.transform("_t", lambda t: t["track_id"]).alias("track_ids"),
                      F.try_element_at(F.transform("_t", lambda t: t["track_id"]), F.lit(1)).alias("first_track_id"))


def explanation(cluster_id: Column, label: Column, similarity: Column, method: Column,
                track_ids: Column) -> Column:
    """CHK16: routing explanation sentence."""
    tracks = F.when(F.size(track_ids) > 0, F.array_join(track_ids, ", ")).otherwise(
        F.lit("no tracks configured for this cluster"))
    return F.format_string("Input matched cluster %s ('%s', similarity=%.2f via %s). Mapped to track(s): %s.",
                           cluster_id, label, similarity, method, tracks)
