"""Periodic runs: maximal stretches of words that repeat with a period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical), at least ``max(LEAST, TIMES * q)`` long, that no neighbouring word extends keeping
the period.

Every run holds a Lyndon root: a factor of length ``q`` that is the longest Lyndon word from its
start, under the order of words or under its reverse. So the longest Lyndon word from each
position, under both orders, is a candidate root ``[i, j)``, and the run around it reaches from
``i`` less the common suffix of the texts before ``i`` and ``j`` to ``j`` plus the common prefix of
the suffixes at ``i`` and ``j``. Ukkonen's suffix tree of the stretch and the one of its reversal
give both: the depth of the lowest common ancestor of two leaves, found in constant time as a
minimum over the Euler tour.

Words that can't lie in a run are set aside before (``stretches``): past its first ``q`` words
each word of a run occurred at most ``q`` words earlier, and so do at least ``3 q`` words in a row. What is left
holds every run whole with its neighbours. A tree takes about a kilobyte a word, for one stretch at a time.

Defined results: NULL and empty texts have no words and no runs; a text of any length is one
value; repeated rows are judged each for itself; a row's own columns are kept as asked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wellspring.llm.common import bounded_batches, map_texts

#: A run has at least LEAST words and TIMES periods.
LEAST = 6
TIMES = 4

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


# ----------------------------------------------------------------- suffix trees


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small whole numbers, closed by a lesser one (-1).

    Leaves are numbered by their suffixes, inner nodes from ``size`` on.
    """

    def __init__(self, words: Sequence[int]):
        self.text = [*words, -1]
        self.size = len(self.text)
        self._build()

    def _build(self) -> None:
        """One pass over the words. A node is its edge's place in ``start`` and ``end``; an inner
        node's children lie in a map by their first word."""
        text, size = self.text, self.size
        root = size
        start, kids, link, end = [0] * size, [{}], [root], [0]  # leaves' starts; inner nodes from ``root`` on
        inner_start = [0]
        node, edge, length = root, 0, 0  # the active point: ``length`` words down the edge of text[edge]
        left, leaves = 0, 0  # suffixes that still wait for a branch
        for at in range(size):
            word = text[at]
            left += 1
            waits = -1  # the inner node that waits for its suffix link
            while left:
                if not length:
                    edge = at
                child = kids[node - root].get(text[edge])
                if child is None:
                    kids[node - root][word] = leaves
                    start[leaves] = at
                    leaves += 1
                    if waits >= 0:
                        link[waits - root] = node
                        waits = -1
                else:
                    if child >= root:
                        span = end[child - root] - inner_start[child - root]
                        if length >= span:  # walk down
                            edge += span
                            length -= span
                            node = child
                            continue
                        begin = inner_start[child - root]
                    else:
                        begin = start[child]
                    if text[begin + length] == word:
                        length += 1
                        if waits >= 0:
                            link[waits - root] = node
                        break
                    split = root + len(kids)
                    kids[node - root][text[edge]] = split
                    kids.append({word: leaves, text[begin + length]: child})
                    inner_start.append(begin)
                    end.append(begin + length)
                    link.append(root)
                    start[leaves] = at
                    leaves += 1
                    if child >= root:
                        inner_start[child - root] = begin + length
                    else:
                        start[child] = begin + length
                    if waits >= 0:
                        link[waits - root] = split
                    waits = split
                left -= 1
                if node == root:
                    if length:
                        length -= 1
                        edge = at - left + 1
                else:
                    node = link[node - root]
        self.kids, self.inner_start, self.end = kids, inner_start, end

    def children(self) -> list[list[tuple[int, int]]]:
        """Each inner node's ``(first word, child)`` in ascending order; the closing word comes first."""
        return [sorted(below.items()) for below in self.kids]

    def tour(self, children: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """``(order, depth)``: the suffixes as a tour through ``children`` meets them, and the depths at which it
        turned from each to the next: their common prefixes."""
        root, begin, end = self.size, self.inner_start, self.end
        order, depth = [], []
        stack = [(root, 0, 0)]  # node, its depth, the depth at which the tour turned to it
        while stack:
            node, deep, turn = stack.pop()
            if node < root:
                order.append(node)
                depth.append(turn)
                continue
            node -= root
            deep += end[node] - begin[node]
            below = children[node]
            k, last = 0, len(below)
            while k < last and below[k][1] < root:  # leaves before the first inner child need no stack
                order.append(below[k][1])
                depth.append(turn)
                turn = deep
                k += 1
            if k < last:
                stack += [(child, deep, deep) for _, child in below[:k:-1]]
                stack.append((below[k][1], deep, turn))
        return np.array(order), np.array(depth[1:], dtype=np.int32)

    def turned(self, children: list[list[tuple[int, int]]]) -> np.ndarray:
        """Ranks of the suffixes when words are ordered descending; the end of the text still comes first."""
        root, order, stack = self.size, [], [self.size]
        while stack:
            node = stack.pop()
            if node < root:
                order.append(node)
                continue
            below = children[node - root]
            if below[0][0] < 0:
                order.append(below[0][1])
                stack += [child for _, child in below[1:]]
            else:
                stack += [child for _, child in below]
        rank = np.empty(root, dtype=np.int64)
        rank[order] = np.arange(root)
        return rank


class CommonPrefix:
    """Common prefixes of suffixes in constant time: minima over ranges of a tour's turning depths."""

    def __init__(self, order: np.ndarray, depth: np.ndarray):
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [depth]
        while 2 << (len(self.table) - 1) <= len(depth):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths for pairs of different suffixes."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def longest_lyndon(rank: np.ndarray) -> np.ndarray:
    """For each position the end of the longest Lyndon word from it: the next position whose suffix is less."""
    ranks = rank.tolist()
    ends, waiting = [0] * len(ranks), []
    for j, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            ends[waiting.pop()] = j
        waiting.append(j)
    for i in waiting:
        ends[i] = len(ranks)
    return np.array(ends)


def runs_of(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of whole numbers >= 0, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    tree = SuffixTree(words)
    children = tree.children()
    prefix = CommonPrefix(*tree.tour(children))
    back = SuffixTree(words[::-1])
    suffix = CommonPrefix(*back.tour([list(below.items()) for below in back.kids]))
    found = set()
    for rank in (prefix.rank, tree.turned(children)):
        i = np.arange(n)
        j = longest_lyndon(rank[:n])
        i, j = i[j < n], j[j < n]  # a root that ends the text is the last period of its run, and an earlier one begins it
        right = prefix.of(i, j)
        # the words before i and j are the suffixes at n - i and n - j of the reversal, whose closing word is at n
        left = np.zeros(len(i), dtype=np.int64)
        has = np.flatnonzero(i > 0)
        left[has] = suffix.of(n - i[has], n - j[has])
        start, period = i - left, j - i
        length = j + right - start
        ok = length >= np.maximum(LEAST, TIMES * period)
        found.update(zip(start[ok].tolist(), length[ok].tolist(), period[ok].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


# ----------------------------------------------------------------- texts


def stretches(back: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of words that hold every run and its neighbours, over several texts at a time.

    ``back`` is how many words earlier each word occurred last (0: never), with one 0 after each
    text; ``starts`` are the texts' first places. No range reaches beyond its text.
    """
    n = len(back)
    back = np.where(back > 0, back, n + 1)
    stops = np.append(starts[1:], n) - 1
    marks = np.zeros(n + 1, dtype=np.int32)
    longest = int((stops - starts).max(initial=0))
    low, high = 1, 1  # periods low..high at a time
    while TIMES * low <= longest:
        turns = np.flatnonzero(np.diff((back <= high).view(np.int8), prepend=0))  # every text ends outside
        begin, stop = turns[::2], turns[1::2]
        ok = stop - begin >= max(LEAST - low, (TIMES - 1) * low)
        begin, stop = begin[ok], stop[ok]
        text = np.searchsorted(starts, begin, side="right") - 1
        np.add.at(marks, np.maximum(begin - high - 1, starts[text]), 1)
        np.add.at(marks, np.minimum(stop + 1, stops[text]), -1)
        low, high = high + 1, max(high + 1, high * 5 // 4)
    turns = np.flatnonzero(np.diff((np.cumsum(marks) > 0).view(np.int8), prepend=0))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def words_of(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: what ``split`` of bytes takes as words."""
    return text.encode("utf-8", "surrogatepass").split()


def all_runs(texts: Sequence[Sequence[bytes]]) -> list[list[tuple[int, int, int]]]:
    """All runs of the words of each text."""
    starts, back, at = [], [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        starts.append(at)
        for i, word in enumerate(words):
            back.append(i - seen.get(word, i))
            seen[word] = i
        back.append(0)
        at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    firsts = np.array(starts, dtype=np.int64)
    for begin, stop in stretches(np.array(back, dtype=np.int64), firsts):
        text = int(np.searchsorted(firsts, begin, side="right")) - 1
        begin, stop = begin - starts[text], stop - starts[text]
        known: dict[bytes, int] = {}
        numbers = [known.setdefault(word, len(known)) for word in texts[text][begin:stop]]
        out[text] += [(begin + start, length, period) for start, length, period in runs_of(numbers)]
    return out


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return list(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def _judge(texts: list[str]) -> dict[str, pa.Array]:
    words = [words_of(text) for text in texts]
    every = all_runs(words)
    n_words = [len(ws) for ws in words]
    found = [[{"start": s, "length": length, "period": p} for s, length, p in runs] for runs in every]
    collapsed = [b" ".join(collapse(ws, runs)).decode("utf-8", "surrogatepass") for ws, runs in zip(words, every)]
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return {"n_words": pa.array(n_words, pa.int64()), "runs": pa.array(found, run),
            "collapsed": pa.array(collapsed, pa.string())}


def find_runs(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text's
    kept words joined by one space."""
    bounded_batches(df.sparkSession)
    return map_texts(df, keep, text, _judge, SCHEMA)
