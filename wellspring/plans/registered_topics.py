"""Registered topic/routing queries and their SQL twins.

Cluster assignments come from ``embeddings.label`` (an oracle-checkable
stand-in for a KMeans run); ``kmeans_topics`` runs MLlib KMeans itself and
has no SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..functions.vectors import default_stop_words
from ..operators.recommend import recommend
from ..operators.routing import cluster_tracks, explanation, tfidf_similarities, top_matches
from ..operators.sampling import hash_subsample
from ..operators.topics import (centroids, cluster_keywords, cluster_report, keyword_labels, map_to_text,
                                profile_documents, representatives, silhouette)
from ..sources import dims as D
from ..sources import views as V
from . import sqltext as S
from .registered_checkin import catalog_sql

R = 6
N_REPS = 5


def _r(c, n=R):
    return F.round(F.col(c), n).alias(c)


# ------------------------------------------------------------------ SQL parts
def ec_sql() -> str:
    return V.ORACLE_CTES["corpus"] + """,
ec AS (SELECT c.*, e.embedding, e.label AS cluster_id FROM corpus c JOIN embeddings e ON c.id = CAST(e.vec_id AS VARCHAR))"""


def _stops_sql() -> str:
    return "[" + ", ".join(S.q(w) for w in default_stop_words()) + "]"


def terms_sql(expr: str, bigrams: bool) -> str:
    toks = (f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda t: NOT list_contains({_stops_sql()}, t))")
    if not bigrams:
        return toks
    return f"list_concat(t0, list_transform(range(1, len(t0)), lambda i: t0[i] || ' ' || t0[i + 1]))", toks


def keywords_sql() -> str:
    big, toks = terms_sql("text", True)
    return f"""{ec_sql()},
tk0 AS (SELECT id, cluster_id, {toks} AS t0 FROM ec),
tk AS (SELECT id, cluster_id, {big} AS terms FROM tk0),
dt AS (SELECT id, cluster_id, term, count(*) AS tf FROM (SELECT id, cluster_id, unnest(terms) AS term FROM tk) GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM ec),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS ttf FROM dt GROUP BY term),
vocab AS (SELECT term, df FROM dfs, nd WHERE df >= 3 AND df <= 0.85 * n),
wt AS (SELECT dt.id, dt.cluster_id, dt.term, dt.tf * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w FROM dt JOIN vocab v USING (term), nd),
nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id),
cs AS (SELECT wt.cluster_id, wt.term, sum(wt.w / nrm.norm) AS weight FROM wt JOIN nrm USING (id) GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rank
  FROM cs WHERE weight > 0) WHERE rank <= 10),
lab AS (SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS top_keywords,
  string_agg(term, ' / ' ORDER BY rank) FILTER (WHERE rank <= 3) AS cluster_label FROM kw GROUP BY cluster_id)"""


def reps_sql() -> str:
    return f"""ex AS (SELECT id, cluster_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM ec),
cen AS (SELECT cluster_id, i, sum(CAST(v AS DOUBLE)) / count(*) AS c FROM ex GROUP BY cluster_id, i),
dist AS (SELECT ex.id, ex.cluster_id, sqrt(sum((CAST(ex.v AS DOUBLE) - cen.c) * (CAST(ex.v AS DOUBLE) - cen.c))) AS distance
  FROM ex JOIN cen USING (cluster_id, i) GROUP BY ex.id, ex.cluster_id),
reps AS (SELECT d.*, e.source, e.type, e.channel, substring(coalesce(e.text, ''), 1, 300) AS text_snippet
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, id) - 1 AS rank FROM dist) d
  JOIN ec e USING (id) WHERE rank < {N_REPS})"""


# -------------------------------------------------------------- keywords (ML5)
def q_cluster_keywords(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    return cluster_keywords(ec).select("cluster_id", "rank", "term", _r("weight"))


def oracle_cluster_keywords() -> str:
    return f"""WITH {keywords_sql()}
SELECT cluster_id, CAST(rank AS INTEGER) AS rank, term, {S.rnd('weight', R)} AS weight FROM kw"""


# ------------------------------------------------------- representatives (ML6)
def _reps(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    reps = representatives(ec, centroids(ec), n=N_REPS)
    return reps.withColumn("text_snippet", snippet("text"))


def q_cluster_representatives(spark: SparkSession, data_dir: str) -> DataFrame:
    return _reps(spark, data_dir).select("cluster_id", F.col("rank").cast("int").alias("rank"), "id", "source",
                                          "type", "channel", _r("distance"), F.md5("text_snippet").alias("snippet_md5"))


def oracle_cluster_representatives() -> str:
    return f"""WITH {ec_sql()}, {reps_sql()}
SELECT cluster_id, CAST(rank AS INTEGER) AS rank, id, source, type, channel, {S.rnd('distance', R)} AS distance,
  md5(text_snippet) AS snippet_md5 FROM reps"""


# ---------------------------------------------------------- silhouette (ML3)
def q_cluster_silhouette(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    s = silhouette(ec)
    return s.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"),
                                       F.round(F.avg("silhouette"), R).alias("mean_silhouette"))


def oracle_cluster_silhouette() -> str:
    return f"""WITH {ec_sql()},
e2 AS (SELECT id, cluster_id, CAST(embedding AS DOUBLE[]) AS v FROM ec),
pairs AS (SELECT a.id, a.cluster_id AS ca, b.cluster_id AS cb,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM e2 a JOIN e2 b ON a.id <> b.id),
per AS (SELECT id, ca, cb, sum(d) AS sd, count(*) AS cnt FROM pairs GROUP BY ALL),
sizes AS (SELECT cluster_id, count(*) AS n FROM ec GROUP BY cluster_id),
ai AS (SELECT id, sd / cnt AS a FROM per WHERE ca = cb),
bi AS (SELECT id, min(sd / cnt) AS b FROM per WHERE ca <> cb GROUP BY id),
s AS (SELECT e.id, e.cluster_id,
    CASE WHEN sz.n <= 1 OR bi.b IS NULL THEN 0.0 ELSE (bi.b - ai.a) / greatest(ai.a, bi.b) END AS s
  FROM ec e JOIN sizes sz USING (cluster_id) LEFT JOIN ai ON ai.id = e.id LEFT JOIN bi ON bi.id = e.id)
SELECT cluster_id, count(*) AS size, {S.rnd('avg(s)', R)} AS mean_silhouette FROM s GROUP BY cluster_id"""


# ------------------------------------------------------------- report (AGG5)
def q_cluster_report(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    labels = keyword_labels(cluster_keywords(ec))
    rep = cluster_report(ec, labels)
    return rep.select("cluster_id", "size", map_to_text(F.col("source_counts")).alias("source_counts"),
                      map_to_text(F.col("type_counts")).alias("type_counts"), "top_keywords", "cluster_label")


def oracle_cluster_report() -> str:
    return f"""WITH {keywords_sql()},
sc AS (SELECT cluster_id, string_agg(source || '=' || n, ',' ORDER BY source) AS source_counts
  FROM (SELECT cluster_id, source, count(*) AS n FROM ec GROUP BY ALL) GROUP BY cluster_id),
tc AS (SELECT cluster_id, string_agg(type || '=' || n, ',' ORDER BY type) AS type_counts
  FROM (SELECT cluster_id, type, count(*) AS n FROM ec GROUP BY ALL) GROUP BY cluster_id)
SELECT s.cluster_id, s.size, sc.source_counts, tc.type_counts, lab.top_keywords, lab.cluster_label
FROM (SELECT cluster_id, count(*) AS size FROM ec GROUP BY cluster_id) s
JOIN sc USING (cluster_id) JOIN tc USING (cluster_id) LEFT JOIN lab USING (cluster_id)"""


# ------------------------------------------------------ profiles (AGG7, JOI7)
def _profiles(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    labels = keyword_labels(cluster_keywords(ec))
    reps = _reps(spark, data_dir).join(labels, "cluster_id", "left")
    return profile_documents(reps)


def q_cluster_profiles(spark: SparkSession, data_dir: str) -> DataFrame:
    p = _profiles(spark, data_dir)
    return p.select("cluster_id", F.md5("profile").alias("profile_md5"), F.length("profile").alias("profile_len"),
                    "cluster_label")


def profiles_sql() -> str:
    return f"""{keywords_sql()}, {reps_sql()},
prof AS (SELECT r.cluster_id, string_agg(r.text_snippet, ' ' ORDER BY r.rank) AS profile, any_value(l.cluster_label) AS cluster_label
  FROM reps r LEFT JOIN lab l USING (cluster_id) GROUP BY r.cluster_id)"""


def oracle_cluster_profiles() -> str:
    return f"""WITH {profiles_sql()}
SELECT cluster_id, md5(profile) AS profile_md5, length(profile) AS profile_len, cluster_label FROM prof"""


# ------------------------------------------------------------ routing (ML8-9)
QKEYS = ["conv_id", "turn"]


def _routed(spark: SparkSession, data_dir: str) -> DataFrame:
    prof = _profiles(spark, data_dir)
    q = V.debriefs(spark, data_dir)
    sims = tfidf_similarities(q, prof, QKEYS)
    return top_matches(q, sims, prof, QKEYS, k=3)


def q_route_text(spark: SparkSession, data_dir: str) -> DataFrame:
    r = _routed(spark, data_dir)
    tops = F.array_join(F.transform("top_matches", lambda m: F.concat(
        m["cluster_id"].cast("string"), F.lit(":"), F.format_number(m["similarity"], 4))), ",")
    return r.select(*QKEYS, "cluster_id", "similarity", "method", tops.alias("top_matches"))


def routing_sql() -> str:
    big, toks = terms_sql("x", True)
    ptoks = toks.replace("coalesce(x, '')", "coalesce(profile, '')")
    qtoks = toks.replace("coalesce(x, '')", "coalesce(text, '')")
    return f"""{profiles_sql()}, {V.ORACLE_CTES['debriefs']},
np AS (SELECT count(*) AS p FROM prof),
pt AS (SELECT cluster_id, term, count(*) AS tf FROM (SELECT cluster_id, unnest({ptoks}) AS term FROM prof) GROUP BY ALL),
qt AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({qtoks}) AS term FROM debriefs) GROUP BY ALL),
dfp AS (SELECT term, count(*) AS dfp FROM pt GROUP BY term),
qv AS (SELECT q.conv_id, q.turn, q.term, q.tf * (ln((np.p + 2.0) / (1 + coalesce(d.dfp, 0) + 1)) + 1) AS w
  FROM qt q LEFT JOIN dfp d USING (term), np),
qn AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS qn FROM qv GROUP BY ALL),
qs AS (SELECT DISTINCT conv_id, turn FROM debriefs),
pairs AS (SELECT qs.conv_id, qs.turn, prof.cluster_id FROM qs CROSS JOIN prof),
pv AS (SELECT pr.conv_id, pr.turn, pt.cluster_id, pt.term,
    pt.tf * (ln((np.p + 2.0) / (1 + d.dfp + CASE WHEN q.term IS NOT NULL THEN 1 ELSE 0 END)) + 1) AS w
  FROM pairs pr JOIN pt ON pt.cluster_id = pr.cluster_id JOIN dfp d ON d.term = pt.term
  LEFT JOIN qt q ON q.conv_id = pr.conv_id AND q.turn = pr.turn AND q.term = pt.term, np),
pn AS (SELECT conv_id, turn, cluster_id, sqrt(sum(w * w)) AS pn FROM pv GROUP BY ALL),
qdot AS (SELECT pv.conv_id, pv.turn, pv.cluster_id, sum(pv.w * qv.w) AS dot FROM pv
  JOIN qv ON qv.conv_id = pv.conv_id AND qv.turn = pv.turn AND qv.term = pv.term GROUP BY ALL),
sims AS (SELECT pr.conv_id, pr.turn, pr.cluster_id,
    CASE WHEN coalesce(qn.qn, 0) = 0 OR coalesce(pn.pn, 0) = 0 OR qdot.dot IS NULL THEN 0.0 ELSE qdot.dot / (qn.qn * pn.pn) END AS sim
  FROM pairs pr LEFT JOIN qn USING (conv_id, turn) LEFT JOIN pn USING (conv_id, turn, cluster_id)
  LEFT JOIN qdot USING (conv_id, turn, cluster_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sim DESC, cluster_id DESC) AS r FROM sims),
routed AS (SELECT conv_id, turn, max(CASE WHEN r = 1 THEN cluster_id END) AS cluster_id,
    {S.rnd('max(CASE WHEN r = 1 THEN sim END)', 4)} AS similarity,
    string_agg(cluster_id || ':' || printf('%.4f', {S.rnd('sim', 4)}), ',' ORDER BY r) FILTER (WHERE r <= 3) AS top_matches
  FROM rk GROUP BY conv_id, turn)"""


def oracle_route_text() -> str:
    return f"""WITH {routing_sql()}
SELECT conv_id, turn, cluster_id, similarity, 'tfidf' AS method, top_matches FROM routed"""


# ------------------------------------------------------ route -> tracks (ML10)
def q_route_recommend(spark: SparkSession, data_dir: str) -> DataFrame:
    r = _routed(spark, data_dir)
    tr = cluster_tracks(r)
    j = r.join(F.broadcast(tr), "cluster_id", "left")
    j = j.withColumn("time_available_min", F.lit(5)).withColumn("setting", F.lit("break_room")) \
         .withColumn("dominant_dimension", F.lit("mind"))
    recs = j.transform(recommend(scales_col=None, keep=tuple(QKEYS))).filter(F.col("rank") == 1)
    out = j.join(recs.select(*QKEYS, "intervention_id"), QKEYS)
    return out.select(*QKEYS, "cluster_id", F.array_join("track_ids", ",").alias("track_ids"),
                      "intervention_id",
                      explanation(F.col("cluster_id"), F.col("cluster_label"), F.col("similarity"),
                                  F.col("method"), F.col("track_ids")).alias("explanation"))


def oracle_route_recommend() -> str:
    memb = " UNION ALL ".join(f"SELECT {cid} AS cluster_id, {S.q(t)} AS track_id, {i} AS track_ord"
                              for i, (t, cids, _) in enumerate(D.TRACKS) for cid in cids)
    return f"""WITH {routing_sql()},
memb AS ({memb}),
tr AS (SELECT r.conv_id, r.turn, string_agg(m.track_id, ',' ORDER BY m.track_ord) AS track_ids
  FROM routed r LEFT JOIN memb m ON m.cluster_id = r.cluster_id GROUP BY r.conv_id, r.turn),
plab AS (SELECT cluster_id, cluster_label FROM prof),
{catalog_sql()},
fit AS (SELECT v.*, v.duration_min <= 5 AND list_contains(v.settings, 'break_room') AS fits FROM variants v),
pc AS (SELECT category_id, bool_or(fits) AS available,
    arg_max(intervention_id, duration_min * 1000 - var_ord) FILTER (WHERE fits) AS best_fit,
    arg_min(intervention_id, duration_min * 1000 + var_ord) AS shortest FROM fit GROUP BY category_id),
pb AS (SELECT pc.category_id, pc.available, c.category_ord,
    CASE WHEN pc.available THEN best_fit ELSE shortest END AS intervention_id FROM pc JOIN cats c USING (category_id)),
fixed_top AS (SELECT pb.intervention_id FROM pb JOIN variants v USING (intervention_id)
  ORDER BY CASE WHEN list_contains(v.best_for, 'mind') THEN 0 ELSE 1 END, CASE WHEN pb.available THEN 0 ELSE 1 END,
  pb.category_ord LIMIT 1)
SELECT r.conv_id, r.turn, r.cluster_id, coalesce(tr.track_ids, '') AS track_ids, (SELECT intervention_id FROM fixed_top) AS intervention_id,
  'Input matched cluster ' || r.cluster_id || ' (''' || coalesce(l.cluster_label, '') || ''', similarity='
    || printf('%.2f', r.similarity) || ' via tfidf). Mapped to track(s): '
    || CASE WHEN tr.track_ids IS NULL THEN 'no tracks configured for this cluster' ELSE replace(tr.track_ids, ',', ', ') END
    || '.' AS explanation
FROM routed r LEFT JOIN tr USING (conv_id, turn) LEFT JOIN plab l ON l.cluster_id = r.cluster_id"""


# -------------------------------------------------------- cluster -> tracks
def q_cluster_tracks(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    t = cluster_tracks(ec)
    return t.select("cluster_id", F.array_join("track_ids", ",").alias("track_ids"), "first_track_id")


def oracle_cluster_tracks() -> str:
    memb = " UNION ALL ".join(f"SELECT {cid} AS cluster_id, {S.q(t)} AS track_id, {i} AS track_ord"
                              for i, (t, cids, _) in enumerate(D.TRACKS) for cid in cids)
    return f"""WITH {ec_sql()}, memb AS ({memb})
SELECT c.cluster_id, coalesce(string_agg(m.track_id, ',' ORDER BY m.track_ord), '') AS track_ids,
  arg_min(m.track_id, m.track_ord) AS first_track_id
FROM (SELECT DISTINCT cluster_id FROM ec) c LEFT JOIN memb m USING (cluster_id) GROUP BY c.cluster_id"""


# ------------------------------------------------------ k-selection sample (SMP3)
SUB_N = 200


def q_kselect_sample(spark: SparkSession, data_dir: str) -> DataFrame:
    ec = V.embedded_corpus(spark, data_dir)
    return ec.transform(hash_subsample(SUB_N, "id", 42)).select("id", "cluster_id")


def oracle_kselect_sample() -> str:
    return f"""WITH {ec_sql()}
SELECT id, cluster_id FROM ec ORDER BY {S.sample_key('id')}, id LIMIT {SUB_N}"""
