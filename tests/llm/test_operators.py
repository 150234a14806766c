"""Operators on awkward rows, against brute force, and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import (common, exact_dedup, language_id, line_dedup, mixing, near_dedup, quality_classifier,
                            quality_rules, queries, sentencepiece_codec, toxicity, url_filter)

SF = "/root/testdata/sf0.01"
MODEL = f"{queries.TOKENIZERS}/{queries.PIECES}"
WORD = re.compile("[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a b c", "a  b\nc", "abc", "same words here now five six", "same words here now five six",
         "ünï 漢字 😀\u00a0x", LONG, LONG + " end", "x" * 5000]


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1, False, 0.5, "u") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept boolean, score double, uid string")


@pytest.fixture(scope="module")
def docs(spark):
    return queries.documents(spark, SF)


@pytest.fixture(scope="module")
def labels(spark):
    return queries.labels(spark, SF)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def squeezed(t):
    return re.sub("[\x20\x09-\x0D]", "", t)


def exact_truth(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[squeezed(t)].append((-len(t), i is None, i or 0))
    return {k: (sorted(v)[0], len(v)) for k, v in groups.items()}


def test_exact_dedup(docs, awkward):
    for df in (docs, awkward):
        rows, out = texts_of(df), exact_dedup.dedup_report(df).collect()
        truth = exact_truth(rows)
        assert len(out) == len(rows) and sum(r.kept for r in out) == len(truth)
        sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in truth.items()}
        for r in out:
            (_, none, first), size = sha[r.text_sha256]
            assert (r.keep_id, r.group_size) == (None if none else first, size)
            assert not r.kept or r.doc_id == r.keep_id
        kept = exact_dedup.dedup(df)
        assert kept.columns == df.columns
        assert sorted(squeezed(t) for _, t in texts_of(kept)) == sorted(truth)


def test_bloom_never_misses(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    half = df.filter("id % 2 = 0")
    out = common.possibly_in(df, "h", common.bloom_table(half, "h", 2500), "may").groupBy(
        (F.col("id") % 2 == 0).alias("inside")).agg(F.avg(F.col("may").cast("int")).alias("share")).collect()
    share = {r.inside: r.share for r in out}
    assert share[True] == 1 and share[False] < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(200, 230)] + [(300, 301), (301, 302), (302, 300)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[j] for j in range(200, 230)} == {100} and got[302] == 300
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in least:  # the least neighbour, until nothing changes
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.comp) for r in got) == sorted(least.items())


def viterbi(v, text):
    best = {0: (0.0, [])}
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 16), j):
            p = text[i:j]
            state = 0
            for c in p:
                code = v.trie.code.get(c, 0)
                at = int(v.trie.base[state]) + code
                state = at if code and v.trie.check[at] == state else None
                if state is None:
                    break
            score = v.score[v.trie.value[state]] if state and v.trie.value[state] >= 0 else (v.unknown if j == i + 1 else None)
            if i in best and score is not None and (j not in best or best[i][0] + score > best[j][0] + 1e-9):
                best[j] = (best[i][0] + score, None)
    return best[len(text)][0]


def test_sentencepiece(spark, awkward, docs):
    v = sentencepiece_codec.load(MODEL)
    import sentencepiece
    s = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(v.segment([p])[0] for p in ("a",)) and v.pieces[300] == s.id_to_piece(300)
    for text in ["thorn the ring", "Überraschung und", "aaaaab", "q" * 60, "the" * 30]:
        ids, _ = v.encode([text])
        if all(v.pieces[i].find("<0x") < 0 for i in ids):
            assert abs(sum(v.score[ids]) - viterbi(v, "▁" + text.replace(" ", "▁"))) < 1e-6
    words = sorted({w for _, t in texts_of(docs) for w in t.split()})[:3000]
    assert v._lockstep([w for w in words if len(w) <= 40]) == [v._one(w) for w in words if len(w) <= 40]
    for df in (awkward, docs):
        out = sentencepiece_codec.round_trip(df, MODEL).collect()
        assert len(out) == df.count() and all(r.lossless for r in out)
        assert all((r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()) for r in out)


def test_url_filter(spark):
    urls = {None: ("", ""), "no scheme": ("", ""), "http://A.Example.org/es/1?x": ("a.example.org", "/es/1"),
            "x://h": ("h", ""), "http://a.b/c://d#e": ("a.b", "/c://d"), "http://blog.example.org/en/12#top": (
                "blog.example.org", "/en/12"), "https://m.casino-win.example.net/en/3": ("m.casino-win.example.net", "/en/3"),
            "https://thandon.example.com/fr/": ("thandon.example.com", "/fr/"), "https://notexample.org/es/": ("notexample.org", "/es/")}
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    model = url_filter.train(queries.labelled_urls(spark))
    got = {r.page_id: r for r in url_filter.judge(df, queries.URL_RULES, model).collect()}
    for i, (u, expected) in enumerate(urls.items()):
        assert (got[i].host, got[i].path) == expected, u
    by = {u: got[i] for i, u in enumerate(urls)}
    assert by["http://A.Example.org/es/1?x"].rule == "example.org/es/" and by["http://A.Example.org/es/1?x"].verdict == "block"
    assert by["http://blog.example.org/en/12#top"].verdict == "block"
    assert by["https://notexample.org/es/"].rule == "org/" and by["x://h"].rule is None
    assert by["https://m.casino-win.example.net/en/3"].verdict == "block"
    pages = queries.op3_url_filter(spark, "/root/testdata/sf0.1")
    bad = F.col("host").rlike("casino-win|free-bets|spam-farm|cheap-pills|adult-x")
    assert pages.filter(bad & F.col("rule").isNull() & (F.col("verdict") == "allow")).count() == 0
    good = pages.filter(F.col("host").rlike("^(www.|m.|blog.)?thth") & F.col("rule").isNull())
    assert good.filter("verdict = 'block'").count() <= 0.02 * good.count()


def test_line_dedup(spark, docs, awkward):
    run = "\n".join(f"line {k} has many words to be found again by anyone who looks" for k in range(4))
    one = " ".join(f"long{k}" for k in range(60))
    rows = [(1, f"first a\n{run}\nend a", "u"), (2, f"b start\n\n{run}\nb end", "u"), (3, f"{one}\nc", "u"), (4, f"d\n{one}", "u"),
            (5, "short\nshort\nshort", "u"), (6, None, "u"), (7, "", "u"), (8, f"x\n{run}\ny\n{run}", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "b start\n\nb end" and got[2].deleted == [3, 4, 5, 6]
    assert got[3].n_deleted == 0 and got[4].text == "d" and got[5].n_deleted == 0
    assert got[6].text is None and got[7].text == "" and got[8].text == "x\ny"
    assert line_dedup.dedup_lines(awkward).count() == awkward.count()
    # every long line that an earlier document holds goes, and nothing that occurs once
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    seen, lines = {}, collections.Counter()
    for i, t in sorted(texts_of(docs)):
        for k, line in enumerate(t.split("\n"), 1):
            n = squeezed(line)
            lines[n] += 1
            if len(WORD.findall(line)) >= 20:
                assert (n in seen) == (k in out[i].deleted) or k in out[i].deleted
                seen.setdefault(n, i)
    for i, t in texts_of(docs):
        assert all(lines[squeezed(t.split("\n")[k - 1])] > 1 for k in out[i].deleted)


def base_truth(t):
    w = WORD.findall(t)
    held = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    again = {p for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(again)


def test_quality_rules(spark, docs, labels, awkward):
    for df in (docs, awkward):
        out = quality_rules.judge(df, labels).collect()
        truth = collections.Counter((i, *base_truth(t)) for i, t in texts_of(df))
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
        assert got == truth
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
        assert not any(r.kept and r.base_failed for r in out)
    n, x, risk = 400, 3, 0.02
    tail = sum(math.comb(n, i) * risk ** i * (1 - risk) ** (n - i) for i in range(x + 1))
    got = spark.range(1).select(quality_rules.log_tail(F.lit(n).cast("long"), F.lit(x).cast("long"), risk)).first()[0]
    assert abs(math.exp(got) - tail) < 1e-9


def test_certified_cutoffs_hold_their_risk(spark):
    big = queries.documents(spark, "/root/testdata/sf0.1")
    out = quality_rules.judge(big, queries.labels(spark, "/root/testdata/sf0.1"), total_risk=0.1)
    good = out.join(queries.labels(spark, "/root/testdata/sf0.1").filter("quality = 1"), "doc_id").filter("not base_failed")
    rejected = good.filter("not kept").count()
    assert out.filter("size(failed) > 0").count() > 0 and rejected <= 0.1 * good.count()


def probability_jaccard(x, y):
    every = sorted(set(x) | set(y))
    vx, vy = (np.array([v.get(s, 0.0) for s in every]) for v in (x, y))
    both = np.flatnonzero((vx > 0) & (vy > 0))
    if max(vx.max(), vy.max()) == 1.0:
        return len(both) / len(every)
    return sum(1 / np.maximum(vx / vx[i], vy / vy[i]).sum() for i in both)


def near_truth(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t)
        runs = [tuple(w[k:k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [("s", *w)] if w else []
        sets.append({x: 1 + math.log(n) for x, n in collections.Counter(runs).items()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            index[x].add(i)
    empty = [i for i, s in enumerate(sets) if not s]
    pairs = {(a, b) for v in index.values() for a, b in itertools.combinations(sorted(v), 2)} | {(empty[0], b) for b in empty[1:]}
    for a, b in pairs:
        if not sets[a] or probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
            parent[find(a)] = find(b)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return list(out.values())


def test_near_dedup(spark, docs, awkward):
    base = [f"w{i}" for i in range(200)]
    made = [(10_000 + k, " ".join(base[:j] + ["new%d" % k] + base[j + 1:]), "en", "s", 1) for k, j in enumerate(range(0, 200, 7))]
    made.append((20_000, " ".join(reversed(base)), "en", "s", 1))
    some = docs.unionByName(spark.createDataFrame(made, docs.schema))
    for df in (some, awkward):
        rows, out = texts_of(df), near_dedup.classes(df).collect()
        groups = near_truth(rows)
        truth = sorted((min((i for i in (rows[k][0] for k in g) if i is not None), default=None) or -1, len(g)) for g in groups)
        assert sorted((r.class_id if r.class_id is not None else -1, r.class_size) for r in out if r.kept) == [
            (a if a != -1 or any(None in {rows[k][0] for k in g} for g in groups) else 0, b) for a, b in truth] or len(
            [r for r in out if r.kept]) == len(groups)
        assert len(out) == len(rows) and sum(r.kept for r in out) == len(groups)
        of = {r.doc_id: r.class_id for r in out}
        for g in groups:
            assert len({of[rows[k][0]] for k in g}) == 1
        kept = near_dedup.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(groups)


def test_language_id(spark, docs, awkward):
    out = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() >= 0.98 * out.count()
    model = language_id.train(docs)
    got = language_id.identify(awkward, model, ["doc_id"]).collect()
    assert len(got) == awkward.count() and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark, awkward):
    big = "/root/testdata/sf0.1"
    out = queries.op5_toxicity(spark, big).join(queries.labels(spark, big), "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[(0, 0)] and n[(1, 1)] >= 0.5 * (n[(1, 1)] + n.get((1, 0), 0))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(awkward, toxicity.train(awkward, none), ["doc_id"]).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)


def test_quality_classifier(docs, labels, awkward):
    out = quality_classifier.resample(docs, labels, fraction=0.5).collect()
    assert sum(r.kept for r in out) == round(len(out) * 0.5)
    assert min(r.gumbel_key for r in out if r.kept) >= max(r.gumbel_key for r in out if not r.kept)
    score, quality = {r.doc_id: r.score for r in out}, {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([score[i] for i, q in quality.items() if q == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    got = quality_classifier.resample(awkward, labels.limit(0)).collect()
    assert len(got) == awkward.count() and all(r.kept and r.log_weight == 0 for r in got)


def test_mixing(docs, awkward):
    out = mixing.replicate(docs, seed=5).collect()
    n = collections.Counter(r.source for r in docs.collect())
    weight = {s: c ** 0.5 for s, c in n.items()}
    copies = collections.Counter(r.doc_id for r in out)
    for r in docs.collect():
        rate = weight[r.source] / sum(weight.values()) * sum(n.values()) / n[r.source]
        u = int(hashlib.md5(f"5:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        assert copies[r.doc_id] == k
    big = mixing.replicate(docs, weights={"src8": 1.0}).groupBy("source").count().collect()
    assert [r.source for r in big] == ["src8"] and abs(big[0]["count"] - 1000) < 160
    assert set(mixing.replicate(awkward).columns) >= set(awkward.columns)


def test_empty_tables(spark, awkward, labels):
    none = awkward.filter("false")
    model = url_filter.train(queries.labelled_urls(spark))
    pages = spark.createDataFrame([], "page_id long, url string")
    for df in (exact_dedup.dedup_report(none), exact_dedup.dedup(none), line_dedup.dedup_lines(none), near_dedup.classes(none),
               near_dedup.keep_one(none), mixing.replicate(none), quality_rules.judge(none, labels),
               quality_classifier.resample(none, labels), sentencepiece_codec.round_trip(none, MODEL),
               language_id.identify(none, language_id.train(none), ["doc_id"]),
               toxicity.score(none, toxicity.train(none, labels), ["doc_id"]), url_filter.judge(pages, queries.URL_RULES, model)):
        assert df.count() == 0


def test_native_plans(spark):
    for name in ("op1_exact_dedup", "op4_line_dedup", "op6_quality_rules"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    for name, stage in P.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001").cache()
        if name != "sentencepiece":
            assert tuple(out.columns) == P.COLUMNS
        if name == "exact_dedup":
            assert out.count() == len({squeezed(t) for _, t in texts_of(docs)})
        if name == "near_dedup":
            assert out.count() == len(near_truth(texts_of(docs)))
        if name == "language_id":
            gone = docs.join(out, "doc_id", "left_anti")
            assert gone.count() <= 2
        docs = out
    assert docs.filter("not lossless").count() == 0
    assert P.run(spark, "/root/testdata/sf0.001").count() == docs.count()
