"""Near copies that differ by a line repeated many times, against brute force over the weighted measure."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from wellspring.llm import near_dedup


def weighted(text):
    w = text.split(" ")
    return {s: 1 + math.log(n) for s, n in Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)).items()}


def brute(a, b):
    """Probability Jaccard similarity by its definition, all pairs of elements."""
    x, y = weighted(a), weighted(b)
    every = sorted(set(x) | set(y))
    vx, vy = (np.array([v.get(s, 0.0) for s in every]) for v in (x, y))
    both = np.flatnonzero((vx > 0) & (vy > 0))
    return sum(1 / np.maximum(vx / vx[i], vy / vy[i]).sum() for i in both)


def pairs(n=100):
    """Texts of 104 words, and each with a new line of some words repeated 2 to 50 times: about 0.8 similar."""
    r = random.Random(7)
    out = []
    for k in range(n):
        base = [f"a{k}x{j}" for j in range(104)] + [f"a{k}x{j}" for j in range(9)] * (k % 3)
        times = r.randint(2, 50)
        line = [f"b{k}x{j}" for j in range(max(1, round(21 / (1 + math.log(times)) + r.randint(-4, 3))))]
        out.append((" ".join(base), " ".join(base + line * times)))
    return out


def test_likeness_is_the_definition():
    r = random.Random(3)
    made = pairs(40) + [(" ".join(r.choices("abc", k=60)), " ".join(r.choices("abc", k=40))) for _ in range(40)]
    for a, b in made:
        x, y = (near_dedup._weighted(v.as_py()) for v in near_dedup._shingle_bytes([a, b])["sh"])
        assert abs(near_dedup.likeness(*x, *y) - brute(a, b)) < 1e-9
        assert abs(near_dedup.likeness(*y, *x) - brute(a, b)) < 1e-9
        # whatever the scale of the weights
        assert abs(near_dedup.likeness(x[0], 7 * x[1], *y) - brute(a, b)) < 1e-9


def test_signatures_estimate_the_weighted_similarity():
    made = pairs(300)
    got, true = [], []
    for a, b in made:
        x, y = (np.frombuffer(s.as_py(), np.uint8) for s in near_dedup.describe([a, b])["sig"])
        got.append((x == y).mean())
        true.append(brute(a, b))
    # the standard error of the mean is 0.0017; chance makes bytes equal in 1 of 256
    assert abs(np.mean(got) - np.mean(true)) < 0.01
    assert min(g for g, t in zip(got, true) if t >= 0.8) > near_dedup.LOOSE


def test_repeated_lines_lose_no_near_copy(spark):
    made = pairs()
    rows = [(2 * k + side, t) for k, ab in enumerate(made) for side, t in enumerate(ab)]
    truth = {2 * k + side: 2 * k if similar or not side else 2 * k + 1 for k, (a, b) in enumerate(made)
             for similar in [brute(a, b) >= 0.8] for side in (0, 1)}
    assert 30 <= sum(i != c for i, c in truth.items()) <= 70
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in out} == truth


def test_verified_pairs_are_named_so(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:j] + [f"new{k}"] + base[j + 1:])) for k, j in enumerate(range(0, 200, 9))]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "n_links" not in out.columns
    got = out.collect()
    assert len({r.class_id for r in got}) == 1 and all(1 <= r.n_verified < len(rows) for r in got)


def test_a_member_that_meets_many_blocks_is_told_once():
    def block(first, comp):
        return [{"key": first + k, "comp": comp, "main": comp == 0, "sig": bytes(near_dedup.SIZE)} for k in range(4)]
    x, blocks = block(0, 1), [block(10 * b, 0) for b in range(1, 21)]
    member = pa.struct([("key", pa.int64()), ("comp", pa.int64()), ("main", pa.bool_()), ("sig", pa.binary())])
    rows = [pa.RecordBatch.from_arrays([pa.array([5] * 2), pa.array([x] * 2, pa.list_(member)), pa.array(blocks[b:b + 2], pa.list_(member))],
                                       names=["bucket", "x", "y"]) for b in range(0, 20, 2)]
    told = [(r["bucket"], r["key"]) for out in near_dedup._meeting(iter(rows)) for r in out.to_pylist()]
    assert sorted(told) == [(5, k) for k in range(4)] + [(5, 10 * b + k) for b in range(1, 21) for k in range(4)]
    assert not [r for out in near_dedup._meeting(iter([])) for r in out.to_pylist()]


def test_held_members_are_told_in_parts(monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD", 3)
    member = pa.struct([("key", pa.int64()), ("comp", pa.int64()), ("main", pa.bool_()), ("sig", pa.binary())])
    sig = bytes(near_dedup.SIZE)
    x = [[{"key": k, "comp": k, "main": False, "sig": sig}] for k in range(5)]
    y = [[{"key": k + 100, "comp": 99, "main": True, "sig": sig}] for k in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5), pa.array(x, pa.list_(member)), pa.array(y, pa.list_(member))], names=["bucket", "x", "y"])
    outs = list(near_dedup._meeting(iter([batch])))
    assert len(outs) > 1 and {r["key"] for o in outs for r in o.to_pylist()} == {*range(5), *range(100, 105)}
