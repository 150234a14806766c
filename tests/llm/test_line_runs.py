"""Line dedup against brute force over whole runs of lines."""

import collections
import random
import re

from wellspring.llm import line_dedup

SPACE = re.compile("[\x20\x09-\x0D]+")


def truth(texts, min_words=20):
    """Deleted line numbers by text: all maximal runs that an earlier place holds, found pair by pair."""
    docs = [[(k, SPACE.sub("", x), len([w for w in SPACE.split(x) if w])) for k, x in enumerate(t.split("\n"), 1)
             if SPACE.sub("", x)] for t in texts]
    most = collections.Counter()
    for d in docs:
        for _, h, n in d:
            most[h] = max(most[h], n)
    out = [set() for _ in docs]
    for i, d in enumerate(docs):
        for j in range(i + 1):
            e = docs[j]
            for shift in range(1 if i == j else -len(d), len(e) + len(d)):
                # line p of d against line p - shift of e; in one document the other place is earlier
                run = []
                for p in range(len(d) + 1):
                    q = p - shift
                    if p < len(d) and 0 <= q < len(e) and d[p][1] == e[q][1]:
                        run.append(p)
                        continue
                    if sum(most[d[r][1]] for r in run) >= min_words:
                        out[i] |= {d[r][0] for r in run}
                    run = []
                if i == j and shift >= len(d):
                    break
    return [sorted(x) for x in out]


def deleted(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.deleted for r in sorted(line_dedup.dedup_lines(df).collect(), key=lambda r: r.doc_id)]


def test_long_runs_of_short_lines(spark):
    verse = [" ".join(f"v{k}w{j}" for j in range(4)) for k in range(13)]
    ones = [f"item{k}" for k in range(25)]
    texts = ["\n".join(["start a", *verse, "end a"]), "\n".join(["b", *verse]), "\n".join([*verse[:4], "c"]),
             "\n".join(["d", *verse[3:9], "", *ones]), "\n".join([*ones, "e"]), "\n".join(ones[:19])]
    want = truth(texts)
    assert want[1] == list(range(2, 15)) and want[2] == [] and want[3] == list(range(2, 8)) and want[4] == list(range(1, 26))
    assert deleted(spark, texts) == want


def test_random_runs(spark):
    r = random.Random(4)
    pool = [" ".join(f"p{k}{j}" for j in range(1 + k % 9)) for k in range(14)] + [" ".join(f"q{j}" for j in range(21))]
    # the same without white space, in fewer and more words
    pool += [pool[5].replace(" ", "", 2), "s p a c e d", "spaced"]
    texts = ["\n".join(r.choices(pool, k=r.randint(0, 14))) for _ in range(40)]
    texts += ["\n".join(["again"] * 45), "\n".join([*pool[:6]] * 3)]
    texts += ["\n".join(texts[k].split("\n")[1:]) for k in range(0, 40, 3)]
    want = truth(texts)
    assert sum(map(len, want)) > 100 and deleted(spark, texts) == want


def test_a_lead_line_pair_that_an_earlier_document_continues_otherwise(spark):
    a, b, x = "lead of three", "then four words more", "another line of the first"
    texts = []
    for k in range(30):
        c = " ".join(f"c{k}w{j}" for j in range(18))
        lead = [f"{a} {k}", f"{b} {k}"]
        texts += [[*lead, x], [*lead, c], ["own line", *lead, c]]
    texts = ["\n".join(t) for t in texts]
    want = truth(texts)
    assert want[2::3] == [[2, 3, 4]] * 30 and not any(want[::3]) and not any(want[1::3])
    assert deleted(spark, texts) == want
