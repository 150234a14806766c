"""The operators' queries over the given tables, and their SQL twins for DuckDB.

Models are fitted on the given tables inside each query. ``QUERIES`` and ``ORACLES`` are what
the entry module adds to the library's own queries.
"""

from __future__ import annotations

import os
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import (exact_dedup, language_id, line_dedup, merkle, mixing, near_dedup, order_minhash,
                            periodic_runs, quality_classifier, quality_rules, sentencepiece_codec, toxicity, url_filter)
from wellspring.llm.common import held_out
from wellspring.sources.tables import read_table

#: Where the public vocabularies lie; a path, never a part of the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECES = "piece_bpe_32k.model"

#: Share of a text that its language must explain, for the pipeline to keep it.
MIN_LANGUAGE_SCORE = 0.3

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]

# The small labelled URL table: fixed values, label 1 means block.
_ALLOWED_HOSTS = ["thandon.example.com", "www.tionther.example.org", "blog.therin.example.net", "m.ththon.example.com",
                  "news.city-herald.example.org", "docs.openlib.example.net", "www.university.example.org",
                  "blog.garden-notes.example.com", "shop.bookstore.example.com", "wiki.history.example.org",
                  "m.weather.example.net", "www.recipes.example.com", "forum.astronomy.example.net",
                  "www.ththre.example.net", "tionsh.example.com", "blog.thering.example.org", "thonan.example.org",
                  "www.music-school.example.com", "data.statistics.example.org", "m.therha.example.com"]
_BLOCKED_HOSTS = ["www.casino-win.example.com", "m.casino-win.example.net", "casino-royal.example.org",
                  "free-bets.example.com", "blog.free-bets.example.net", "best-bets-online.example.com",
                  "ads-track.example.com", "www.ads-track.example.org", "click-ads-server.example.net",
                  "spam-farm.example.com", "blog.spam-farm.example.net", "cheap-pills.example.com",
                  "www.cheap-pills.example.org", "pills-discount.example.net", "adult-x.example.com",
                  "m.adult-x.example.net", "xxx-adult-cams.example.org", "win-lottery-now.example.com",
                  "porn-tube.example.net", "poker-slots.example.com"]
_PATHS = ["/en/12", "/fr/345.html", "/de/6789", "/es/77/", "/en/2024/05/story.html"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(f"https://{host}{_PATHS[(i + j) % len(_PATHS)]}", label)
            for label, hosts in ((0, _ALLOWED_HOSTS), (1, _BLOCKED_HOSTS)) for i, host in enumerate(hosts) for j in (0, 1)]
    return spark.createDataFrame(rows, "url string, label int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(documents(spark, sf_dir), f"{TOKENIZERS}/{PIECES}")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES, url_filter.train(labelled_urls(spark)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir).filter(~held_out(F.col("doc_id"))))
    return toxicity.score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~held_out(F.col("doc_id"))))
    return language_id.identify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir))


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; where 10 divides the id's hash, words from the a-th on repeat with a period."""
    h = id_hash(F.col("doc_id"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n, a, p = F.size("words"), F.col("a"), F.col("p")
    out = out.withColumn("a", F.when(n > 0, F.col("g") % n))
    out = out.withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))
    cycled = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return out.select("doc_id", F.when(n > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted(documents(spark, sf_dir)))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.transform(lines, lambda line: F.concat(line, F.lit("\n")))
    found = found.withColumn("r", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"),
        (-F.col("r.less")).alias("length"), F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.less") / F.col("r.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(id_hash(F.col("doc_id")) % 3 == 0, merkle.row_digest([*merkle.FIELDS[:-1], lowered]))
    proofs = merkle.manifest(documents(spark, sf_dir), carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_minhash.neighbours(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_sentencepiece, op3_url_filter, op4_line_dedup, op5_toxicity, op6_quality_rules, op7_minhash,
    op8_language_id, op9_quality_classifier, op10_mixing, op11_periodic_runs,
    op12_merkle, op13_order_minhash)}

# DuckDB twins. The mixture's twin has one Poisson part: no source's rate is over 8 in the given tables.
ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM n WINDOW w AS (PARTITION BY x ORDER BY len DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op10_mixing": """
WITH c AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c) / (SELECT sum(w) FROM c) * w / n AS rate FROM c),
u AS (SELECT d.*, r.rate, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), 1, 13) AS BIGINT)
  / 4503599627370496.0 AS u FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT * EXCLUDE (rate, u), len(list_filter(range(0, 40), lambda j: list_sum(list_transform(range(0, j + 1),
  lambda i: exp(-rate) * pow(rate, i) / gamma(i + 1))) <= u)) AS n_copies FROM u),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM k)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no, CAST(n_copies AS INTEGER) AS n_copies,
  md5('shuffle-17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy_no) AS shuffle_key FROM e""",
    "op12_merkle": r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS width, CAST(doc_id AS VARCHAR) AS id,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text],
      lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) AS f FROM documents),
l AS (SELECT * EXCLUDE (f), sha256(array_to_string(f, '')) AS leaf,
    xor(list_reduce([4294967295] || flatten(list_transform(string_split(id, ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 3 = 0 AS tamper,
    sha256(array_to_string(f[1:4], '') || translate(f[5], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lowered FROM d),
nodes AS (SELECT grp, 0 AS lvl, idx, width, leaf AS digest FROM l
  UNION ALL SELECT grp, lvl + 1, idx // 8, (width + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE width > 1
  GROUP BY grp, lvl, idx // 8, width),
subs AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS width FROM nodes WHERE width = 1),
tops AS (SELECT 0 AS lvl, idx, width, subroot AS digest FROM subs
  UNION ALL SELECT lvl + 1, idx // 8, (width + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE width > 1
  GROUP BY lvl, idx // 8, width),
every AS (SELECT grp, lvl, idx, width, digest FROM nodes UNION ALL SELECT NULL, lvl, idx, width, digest FROM tops),
sibs AS (SELECT *, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM every WHERE width > 1 WINDOW w AS (PARTITION BY grp, lvl, idx // 8 ORDER BY idx)),
walk AS (SELECT doc_id, grp, 0 AS lvl, idx, '' AS proof, CASE WHEN tamper THEN lowered ELSE leaf END AS x FROM l
  UNION ALL SELECT w.doc_id, w.grp, w.lvl + 1, w.idx // 8, w.proof || s.before || s.after, sha256(s.before || w.x || s.after)
  FROM walk w JOIN sibs s ON s.grp = w.grp AND s.lvl = w.lvl AND s.idx = w.idx),
walked AS (SELECT doc_id, grp, arg_max(proof, lvl) AS proof, arg_max(x, lvl) AS x FROM walk GROUP BY doc_id, grp),
climb AS (SELECT w.doc_id, 0 AS lvl, s.idx, w.proof, w.x FROM walked w JOIN subs s USING (grp)
  UNION ALL SELECT c.doc_id, c.lvl + 1, c.idx // 8, c.proof || s.before || s.after, sha256(s.before || c.x || s.after)
  FROM climb c JOIN sibs s ON s.grp IS NULL AND s.lvl = c.lvl AND s.idx = c.idx),
climbed AS (SELECT doc_id, arg_max(proof, lvl) AS proof, arg_max(x, lvl) AS x FROM climb GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.x AS folded_root, c.x = t.digest AS verified
FROM l JOIN subs s USING (grp) JOIN climbed c USING (doc_id) JOIN tops t ON t.width = 1""",
}
