"""Topic operators: keywords, centroids, representatives, silhouette, report.

ML3, ML5, ML6, AGG5-AGG7, JOI7, SMP3. Shuffles are limited to partial
aggregations (term document frequency, per-cluster vector sums); vectors
are summed with MLlib's ``Summarizer`` one row per cluster per partition.
Everything that is collected or broadcast has a proven bound: per-cluster
statistics (k x d).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T
from ..functions.vectors import default_stop_words, sq_distance, sq_norm
from ..session import cut_lineage
from .lloyd import vectors

# per-cluster statistics are broadcast only below this many doubles (k * d)
MAX_BROADCAST_DOUBLES = 20_000_000
# terms of a vocabulary that is broadcast, some 50 MB of memory
BROADCAST_TERMS = 500_000


def with_analyzed_terms(df: DataFrame, text_col: str = "text", out_col: str = "_terms",
                        stop_words: Sequence[str] | None = None, bigrams: bool = True) -> DataFrame:
    """TXT14: lowercase word tokens (2+ chars), stop words out, then
    unigrams followed by bigrams of the remaining tokens. The unigram array
    is a column of its own so the bigram lambda reads it, not re-derives it."""
    out = remove_stop_words(df.withColumn("_tok", T.tokens(text_col)), "_tok", "_uni", stop_words).drop("_tok")
    out = out.withColumn(out_col, T.with_bigrams(F.col("_uni")) if bigrams else F.col("_uni"))
    return out.drop("_uni") if out_col != "_uni" else out


def remove_stop_words(df: DataFrame, in_col: str, out_col: str,
                      stop_words: Sequence[str] | None = None) -> DataFrame:
    """MLlib ``StopWordsRemover`` (hash-set lookup per token; tokens are
    already lowercase, so the comparison is case-sensitive)."""
    stops = default_stop_words() if stop_words is None else list(stop_words)
    return StopWordsRemover(inputCol=in_col, outputCol=out_col, stopWords=stops,
                            caseSensitive=True).transform(df)


def weighted_terms(docs: DataFrame, terms_col: str = "_terms", min_df: float = 3, max_df: float = 0.85) -> DataFrame:
    """TF-IDF as a long table ``(id, cluster_id, term, w)`` from ``docs(id, cluster_id, terms_col)``.

    Terms within the document-frequency bounds; count x (``ln((1 + n) / (1 + df)) + 1``),
    L2-normalised by document. No limit on the vocabulary, and nothing of it is collected. ``id`` names
    a document: documents are shuffled by it once, with their terms as an array, so that counts and norms
    are made in place. Up to ``BROADCAST_TERMS`` terms within the bounds go to the counts, more are joined to them."""
    n_docs = docs.count()
    lo = min_df if min_df >= 1 else min_df * n_docs
    hi = max_df if (isinstance(max_df, int) or max_df > 1) else max_df * n_docs
    dealt = docs.select("id", "cluster_id", terms_col).repartition("id")
    # explode would add a filter on the array's size, which goes below the shuffle and makes the terms once more for
    # each of their uses; explode_outer gives a NULL for no terms
    counts = cut_lineage(dealt.select("id", "cluster_id", F.explode_outer(terms_col).alias("term")).filter("term is not null")
                         .groupBy("id", "cluster_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(lo, hi))
    idf = idf.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1.0).alias("idf"))
    idf = cut_lineage(idf)
    weights = counts.join(F.broadcast(idf) if idf.count() <= BROADCAST_TERMS else idf, "term").select("id", "cluster_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norm, "id").select("id", "cluster_id", "term", (F.col("w") / F.col("norm")).alias("w"))


def cluster_keywords(df: DataFrame, text_col: str = "text", cluster_col: str = "cluster_id",
                     n_keywords: int = 10, min_df: float = 3, max_df: float = 0.85,
                     stop_words: Sequence[str] | None = None, id_col: str = "id") -> DataFrame:
    """ML5: TF-IDF summed per cluster, top ``n_keywords`` terms with positive
    weight -> (cluster_id, rank 1.., term, weight)."""
    docs = with_analyzed_terms(df.select(F.col(id_col).alias("id"), F.col(cluster_col).alias("cluster_id"), F.col(text_col)),
                               text_col, "_terms", stop_words).select("id", "cluster_id", "_terms")
    sums = weighted_terms(docs, "_terms", min_df, max_df).groupBy("cluster_id", "term").agg(F.sum("w").alias("weight"))
    w = Window.partitionBy("cluster_id").orderBy(F.col("weight").desc(), F.col("term").asc())
    return (sums.filter(F.col("weight") > 0)
                .withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= n_keywords)
                .select("cluster_id", "rank", "term", "weight"))


def keyword_labels(keywords: DataFrame, n_label: int = 3) -> DataFrame:
    """Per cluster: ``top_keywords`` (', '-joined) and ``cluster_label``
    (top 3 joined by ' / ')."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return (keywords.groupBy("cluster_id")
                    .agg(ordered.alias("_k"))
                    .select("cluster_id",
                            F.array_join(F.transform("_k", lambda x: x["term"]), ", ").alias("top_keywords"),
                            F.array_join(F.slice(F.transform("_k", lambda x: x["term"]), 1, n_label), " / ")
                             .alias("cluster_label")))


def centroids(df: DataFrame, emb_col: str = "embedding", cluster_col: str = "cluster_id") -> DataFrame:
    """Mean vector per cluster (sum / count) and size."""
    return (df.groupBy(F.col(cluster_col).alias("cluster_id"))
              .agg(Summarizer.sum(array_to_vector(F.col(emb_col))).alias("_s"), F.count(F.lit(1)).alias("size"))
              .select("cluster_id", "size",
                      F.transform(vector_to_array("_s"), lambda v: v / F.col("size")).alias("centroid")))


def _maybe_broadcast(small: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(small) if rows * max(width, 1) <= MAX_BROADCAST_DOUBLES else small


def representatives(df: DataFrame, cents: DataFrame, n: int = 5, id_col: str = "id",
                    emb_col: str = "embedding", cluster_col: str = "cluster_id",
                    dim: int | None = None) -> DataFrame:
    """ML6/WIN8: the ``n`` members closest to their centroid, rank 0-based
    (ties by id). ``row_number <= n`` is planned with a partial
    WindowGroupLimit, so a hot cluster is cut to n rows map-side."""
    k = cents.count()
    c = _maybe_broadcast(cents.select(F.col("cluster_id").alias("_cid"), "centroid"), k, dim or 1024)
    j = df.join(c, F.col(cluster_col) == F.col("_cid"))
    j = j.withColumn("distance", F.sqrt(sq_distance(F.col(emb_col), F.col("centroid"))))
    w = Window.partitionBy(cluster_col).orderBy(F.col("distance"), F.col(id_col))
    return (j.withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= n)
             .withColumn("rank", F.col("_rn") - 1)
             .drop("_cid", "centroid", "_rn"))


def distance_sums(vec: Column, clusters: Sequence[Row]) -> Column:
    """The sum of squared distances from a vector to the members of each cluster, from its n, S and Q. A sum is NULL
    if the vector has a NULL, is NULL or is of another length than those of the cluster."""
    n, q = np.array([c["n"] for c in clusters], "f8"), np.array([np.nan if c["q"] is None else c["q"] for c in clusters], "f8")
    by_length: dict[int, list[int]] = {}
    for i, c in enumerate(clusters):
        if c["s"] is not None and c["q"] is not None:
            by_length.setdefault(len(c["s"]), []).append(i)
    parts = [(w, np.array(at), np.array([clusters[i]["s"] for i in at], "f8").reshape(-1, w)) for w, at in by_length.items()]

    @F.arrow_udf("array<double>")
    def sums(rows: pa.Array) -> pa.Array:
        out, known = np.full((len(rows), len(n)), np.nan), np.zeros((len(rows), len(n)), bool)
        lengths = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
        for w, at, s in parts:
            some = np.flatnonzero(lengths == w)
            flat = rows.take(pa.array(some)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(-1, w)
            whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, w).any(axis=1)
            out[np.ix_(some, at)] = n[at] * np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ s.T) + q[at]
            known[np.ix_(some, at)] = whole[:, None]
        offsets = np.arange(len(rows) + 1, dtype="i4") * len(n)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel(), mask=~known.ravel()))
    return sums(vec)


def silhouette(df: DataFrame, emb_col: str = "embedding", cluster_col: str = "cluster_id") -> DataFrame:
    """ML3, exact, squared Euclidean distance (the metric of MLlib's
    ClusteringEvaluator), without pairs: with per-cluster n, S = sum(y) and
    Q = sum(|y|^2), sum_j |x - y_j|^2 = n|x|^2 - 2 x.S + Q. a(i) averages
    over the other members (n - 1), b(i) is the smallest mean over other
    clusters, singletons score 0. Adds ``silhouette`` per row. The clusters'
    statistics are collected, so ``df`` is read once when this is called."""
    vec = array_to_vector(F.col(emb_col))
    stats = (df.groupBy(F.col(cluster_col).alias("cid"))
               .agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(vec).alias("_s"),
                    F.sum(sq_norm(F.col(emb_col))).alias("q"))
               .select("cid", "n", vector_to_array("_s").alias("s"), "q"))
    found = stats.collect()
    few = df.sparkSession.createDataFrame([(i, r["cid"], r["n"]) for i, r in enumerate(found)],
                                          StructType([StructField("i", IntegerType()), *stats.schema.fields[:2]]))
    arr = few.agg(F.array_sort(F.collect_list(F.struct("i", "cid", "n"))).alias("st")).scalar()
    sums = distance_sums(vectors(df, emb_col), found)
    per = F.zip_with("_stats", "_sums", lambda c, p: F.struct(c["cid"].alias("cid"), c["n"].alias("n"), p.alias("sumd")))
    mine = F.element_at(F.filter("_per", lambda p: p["cid"] == F.col(cluster_col)), 1)
    others = F.transform(F.filter("_per", lambda p: p["cid"] != F.col(cluster_col)), lambda p: p["sumd"] / p["n"])
    own, a, b = F.col("_own"), F.col("_own.sumd") / (F.col("_own.n") - 1), F.col("_b")
    s = F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    # the sums over all clusters are one matrix product for many rows. Steps are columns, so that they are
    # worked out once
    return (df.withColumn("_stats", arr).withColumn("_sums", sums).withColumn("_per", per)
              .withColumns({"_own": mine, "_b": F.array_min(others)})
              .withColumn("silhouette", s).drop("_stats", "_sums", "_per", "_own", "_b"))


def cluster_report(df: DataFrame, labels: DataFrame | None = None, sil: float | None = None,
                   cluster_col: str = "cluster_id") -> DataFrame:
    """AGG5: size, source and type count maps, keywords/label and the
    silhouette of the chosen k (same value on every row)."""
    def counts(col):
        per = df.groupBy(cluster_col, col).agg(F.count(F.lit(1)).alias("_n"))
        return per.groupBy(cluster_col).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(col), F.col("_n"))))).alias(f"{col}_counts"))
    sizes = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    out = sizes.join(counts("source"), cluster_col).join(counts("type"), cluster_col)
    if labels is not None:
        out = out.join(labels, cluster_col, "left")
    return out.withColumn("silhouette_score", F.lit(sil).cast("double"))


def map_to_text(c: Column) -> Column:
    """Canonical text of a count map: 'k=v' pairs sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def profile_documents(reps: DataFrame, snippet_col: str = "text_snippet") -> DataFrame:
    """AGG7: one document per cluster, snippets joined by a space in rank
    order; the label of the first-ranked row."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(snippet_col).alias("snip"),
                                                   F.col("cluster_label").alias("lab"))))
    return (reps.groupBy("cluster_id").agg(ordered.alias("_r"))
                .select("cluster_id",
                        F.array_join(F.transform("_r", lambda x: F.coalesce(x["snip"], F.lit(""))), " ").alias("profile"),
                        F.try_element_at(F.col("_r"), F.lit(1))["lab"].alias("cluster_label")))


def attach_labels(df: DataFrame, labels: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """JOI7: cluster label on every row (broadcast: one row per cluster)."""
    return df.join(F.broadcast(labels.select(cluster_col, "cluster_label")), cluster_col, "left")
