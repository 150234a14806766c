"""Periodic runs, Merkle proofs and order MinHash on awkward rows and against brute force."""

import hashlib
import random
import re
import string
import zlib

import pytest

from wellspring.llm import merkle, order_minhash, periodic_runs, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(6_000))
TEXTS = [None, "", " \n\t ", "a", "a b c", "x " * 9, "a b a b a b a b a", "same here", "same here", "ünï 漢字 😀 x \x1c y",
         LONG, LONG + " z" * 40, "A" * 5000]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, runs string, steps string, "
          "_key string, _range int, digest string, edited string, kept boolean")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty and very long texts, one id on a third of all rows, repeated rows, clashing extra columns."""
    rest = ("r", "s", "k", 1, "d", "e", True)
    rows = [(i, t, "en" if i % 3 else None, "s", 1, *rest) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, *rest)] * 2 + [(6, "a hot id", "de", "s", 2, *rest)] * 12
    return spark.createDataFrame(rows, SCHEMA)


# ----------------------------------------------------------------- periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q) and not any(
                    all(w[s + k] == w[s + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randrange(60), rng.choice([1, 2, 3, 6, 30])
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            p, s = rng.randrange(1, 9), rng.randrange(n)
            for i in range(s + p, min(n, s + rng.randrange(1, 45))):
                w[i] = w[i - p]
        truth = brute_runs(w)
        assert periodic_runs.runs_of(w) == truth
        # among other texts, through the search for stretches
        assert periodic_runs.all_runs([[b"7"], [b"%d" % x for x in w], [], [b"1"] * 7])[1::2] == [truth, [(0, 7, 1)]]


def test_common_prefixes():
    rng = random.Random(6)
    w = [rng.randrange(2) for _ in range(80)]
    tree = periodic_runs.SuffixTree(w)
    lce = periodic_runs.CommonPrefix(*tree.tour(tree.children()))
    for i in range(80):
        for j in range(i):
            k = 0
            while i + k < 80 and w[i + k] == w[j + k]:
                k += 1
            assert lce.of(periodic_runs.np.array([i]), periodic_runs.np.array([j]))[0] == k


def test_find_runs_on_awkward_rows(spark, awkward):
    out = periodic_runs.find_runs(awkward, ["doc_id", "kept"]).collect()
    assert len(out) == awkward.count()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in awkward.collect()))
    truth = []
    for has, doc, text in texts:
        w = WORD.findall(text)
        runs = brute_runs(w) if len(w) < 1000 else brute_runs(w[-200:])
        runs = [(s + max(0, len(w) - 200) * (len(w) >= 1000), length, q) for s, length, q in runs]
        truth.append((doc if has else None, len(w), runs, brute_collapse(w, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out]
    assert sorted(got, key=str) == sorted(truth, key=str)
    assert periodic_runs.find_runs(awkward.limit(0)).count() == 0


def test_op11_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, SF).select("doc_id", "text").collect()}
    out = queries.op11_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        w, h = WORD.findall(docs[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            w = [w[i] if i < a else w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
        elif n > 400:
            continue  # brute force is quadratic
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(r) == (r.doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
                            sha(brute_collapse(w, runs)))
    assert sum(r.n_runs > 0 for r in out) > 80


# ----------------------------------------------------------------- Merkle proofs


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(digests):
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        groups = [digests[i:i + 8] for i in range(0, len(digests), 8)]
        for proof, a in zip(proofs, at):
            proof.append((a % 8, groups[a // 8][:a % 8] + groups[a // 8][a % 8 + 1:]))
        at, digests = [a // 8 for a in at], [sha("".join(g)) for g in groups]
    return digests[0], proofs


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, steps) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r[0]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        groups[lang].sort()
        trees.append(brute_tree([leaf for _, _, leaf, _ in groups[lang]]))
    root, tops = brute_tree([sub for sub, _ in trees])
    return [(doc, leaf, sub, root, proof + top) for lang, (sub, proofs), top in zip(langs, trees, tops)
            for (_, _, leaf, doc), proof in zip(groups[lang], proofs)]


def plain(rows):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, [(s.pos, list(s.siblings)) for s in r.steps]) for r in rows], key=str)


def test_manifest_equals_brute_force(spark, awkward):
    many = [(i, "s" if i % 2 else None, f"l{i % 11}" if i > 600 else "big", i, f"t{i}") for i in range(700)]
    fields = "doc_id long, source string, lang string, n_chars long, text string"
    for df in (awkward, spark.createDataFrame(many, fields), spark.createDataFrame(many[:1], fields)):
        rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
        out = merkle.manifest(df).withColumn("again", merkle.fold(merkle.F.col("leaf"), merkle.F.col("steps"))).collect()
        assert plain(out) == sorted(brute_manifest(rows), key=str)
        assert all(r.again == r.root for r in out)
    assert merkle.manifest(awkward.limit(0)).count() == 0


def test_op12_finds_what_was_tampered_with(spark):
    out = queries.op12_merkle(spark, SF).collect()
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).select("doc_id", "text").collect()}
    assert len(out) == len(texts)
    for r in out:
        text = texts[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None and text.translate(low) != text
        assert r.verified == (not changed) == (r.folded_root == r.root)


# ----------------------------------------------------------------- order MinHash

MASK = (1 << 64) - 1


def brute_mix(x):
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    return x ^ (x >> 32)


def brute_signature(text):
    if not text:
        return [0] * order_minhash.SKETCHES
    k, seen, numbered = min(order_minhash.K, len(text)), {}, []
    for i in range(len(text) - k + 1):
        h, gram = k, text[i:i + k]
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
        numbered.append(brute_mix((brute_mix(h) + seen.get(gram, 0) * 0x9E3779B97F4A7C15) & MASK))
        seen[gram] = seen.get(gram, 0) + 1
    out = []
    for s in range(1, order_minhash.SKETCHES + 1):
        seed, factor = ((s * 0xC2B2AE3D27D4EB4F) & MASK) >> 32, (((s * 0x9E3779B97F4A7C15) & MASK) >> 32) | 1
        least = sorted(range(len(numbered)), key=lambda i: ((((numbered[i] >> 32) ^ seed) * factor) & 0xFFFFFFFF, i))
        h = len(least[:order_minhash.PICKS])
        for i in sorted(least[:order_minhash.PICKS]):
            h = brute_mix((h * 0x9E3779B97F4A7C15 + numbered[i]) & MASK)
        out.append(h)
    return out


def brute_neighbours(rows):
    """Of (doc_id, text): the next document is the least text of the next greater id."""
    least = {}
    for doc, text in rows:
        least[doc] = min(least.get(doc, text), text)
    ids = sorted(least, key=lambda d: (d is not None, d or 0))
    after = {d: least[ids[(i + 1) % len(ids)]] for i, d in enumerate(ids)}
    known = {}
    out = []
    for doc, text in rows:
        cut = len(text) // 4
        edit = text[:len(text) - cut] + after[doc][:cut]
        a, b, c = (known.setdefault(t, brute_signature(t)) for t in (text, edit, after[doc]))
        near = [sum(x == y for x, y in zip(a, other)) / len(a) for other in (b, c)]
        out.append((doc, len(text), edit, *("".join(f"{x:016x}" for x in s) for s in (a, b)), *near))
    return sorted(out, key=str)


def test_neighbours_equal_brute_force(spark, awkward):
    for df in (awkward, awkward.filter("doc_id = 6"), awkward.filter("doc_id = 3"),
               queries.documents(spark, SF).filter("n_chars < 600")):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        got = sorted((tuple(r) for r in order_minhash.neighbours(df).collect()), key=str)
        assert got == brute_neighbours(rows)
    assert order_minhash.neighbours(awkward.limit(0)).count() == 0


def test_likeness_follows_edits():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(400))

    def like(other):
        return order_minhash.likeness(*(order_minhash.signature(order_minhash.points_of(t)) for t in (text, other)))
    shares = [like(text[:len(text) - cut] + "".join(rng.choices("xyz", k=cut))) for cut in (0, 60, 500, 1400, 2700)]
    assert shares[0] == 1 and shares == sorted(shares, reverse=True) and shares[-1] < 0.1
    half = len(text) // 2
    assert like(text[half:] + text[:half]) < 0.8  # the same k-mers in another order


def test_op13_equals_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    docs.sort()
    out = {r.doc_id: r for r in queries.op13_order_minhash(spark, SF).collect()}
    assert len(out) == len(docs)
    for i, (doc, text) in enumerate(docs):
        cut, after = len(text) // 4, docs[(i + 1) % len(docs)][1]
        assert out[doc].edited_sha256 == sha(text[:len(text) - cut] + after[:cut]) and out[doc].n_chars == len(text)
        assert out[doc].fingerprint == order_minhash.as_text(order_minhash.signature(order_minhash.points_of(text)))
