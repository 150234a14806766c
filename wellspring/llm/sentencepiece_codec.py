"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary (pieces, log scores, byte pieces) is read from a SentencePiece model file
given by path. Encoding puts the white-space marker before the text and in place of
spaces, and takes the segmentation with the largest sum of scores; a character that no
piece covers costs ``UNKNOWN`` below the lowest score and is written as its UTF-8 byte
pieces. Of equal sums the one whose last piece is longer wins, at every place. Decoding
turns byte pieces back into bytes, markers into spaces, and drops the first space, so
every text comes back as it was.

No piece has a marker after another character and none a line feed, so text falls into
stretches that can be segmented apart: exact, and each distinct stretch of a block is
segmented once. Stretches up to ``LOCKSTEP`` characters are segmented together, numpy
walking the trie for all of them at a time; longer ones one by one.

Defined results: NULL and empty texts have no pieces and decode to the empty text.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import bounded_batches, map_texts

MARK = "▁"
UNKNOWN = 10.0
LOCKSTEP = 40
#: Stretches that a worker remembers (about 15 MB); short ones come again in every block.
KNOWN = 50_000

_STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class DoubleArray:
    """A double-array trie over code points: state s goes on character c to ``base[s] + code(c)``
    if ``check`` there says s. Codes number the characters that occur, 0 being all others."""

    def __init__(self, words: dict[str, int]):
        letters = sorted({c for w in words for c in w})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        start = 1
        queue = [(0, 0, sorted(words))]
        for state, depth, below in queue:  # grows as it is read
            kids: dict[str, list[str]] = {}
            for w in below:
                if len(w) == depth:
                    self.value[state] = words[w]
                else:
                    kids.setdefault(w[depth], []).append(w)
            if not kids:
                continue
            codes = np.array(sorted(self.code[c] for c in kids))
            base = self._room(codes, start)
            self.base[state] = base
            for c, words_below in kids.items():
                at = base + self.code[c]
                self.check[at] = state
                queue.append((at, depth + 1, words_below))
            while start < len(self.check) and self.check[start] >= 0:
                start += 1
        self.pad()

    def _room(self, codes: np.ndarray, start: int, window: int = 4096) -> int:
        """The first base from ``start`` on at which all codes fall on free places."""
        while True:
            while start + window + codes[-1] >= len(self.check):
                for name, fill in (("base", 0), ("check", -1), ("value", -1)):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.full(len(old), fill, np.int32)]))
            bases = np.flatnonzero(self.check[start:start + window] < 0) + start - codes[0]
            bases = bases[bases > 0]
            for c in codes[1:]:
                bases = bases[self.check[bases + c] < 0]
            if len(bases):
                return int(bases[0])
            start += window

    def pad(self) -> None:
        """Room after the last state, so that a step needs no test for the end. Code 0 leads
        nowhere: no state is its own parent's ``base``."""
        for name, fill in (("base", 0), ("check", -1), ("value", -1)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(len(self.code) + 1, fill, np.int32)]))


class Vocabulary:
    """Pieces of a model, by what they are."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool]):
        self.pieces = pieces
        self.byte_id = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        for i, p in enumerate(pieces):
            m = None if normal[i] else _BYTE.fullmatch(p)
            if m:
                self.byte_id[int(m[1], 16)] = i
            self.bytes.append(bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() if normal[i] else b"")
        words = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any(MARK in w.lstrip(MARK) or "\n" in w for w in words):
            raise ValueError("pieces that cross a marker or a line feed can't be segmented by stretches")
        self.known: dict[str, list[int]] = {}
        self.trie = DoubleArray(words)
        self.score = np.array(scores, np.float64)
        self.unknown = float(self.score[list(words.values())].min()) - UNKNOWN

    # -- one stretch

    def _one(self, text: str) -> list[int]:
        trie, n = self.trie, len(text)
        codes = trie.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tolist()
        best, came = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value = trie.base, trie.check, trie.value
        for i in range(n):
            here, state, j, single = best[i], 0, i, False
            while j < n and codes[j]:
                at = int(base[state]) + codes[j]
                if check[at] != state:
                    break
                state, j = at, j + 1
                piece = int(value[state])
                if piece >= 0:
                    single |= j == i + 1
                    if here + self.score[piece] > best[j]:
                        best[j], came[j] = here + float(self.score[piece]), (i, piece)
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], came[i + 1] = here + self.unknown, (i, -1)
        out: list[int] = []
        while n:
            i, piece = came[n]
            out += [piece] if piece >= 0 else self.byte_id[list(text[i:n].encode("utf-8", "replace"))].tolist()[::-1]
            n = i
        return out[::-1]

    # -- many short stretches

    def _lockstep(self, texts: list[str]) -> list[list[int]]:
        trie = self.trie
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        width, rows = int(lens.max()), len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.arange(width + 1)[None, :] < lens[:, None]
        codes = np.zeros((rows, width + 1), np.int32)
        codes[inside] = trie.codes[points]
        codes = np.ascontiguousarray(codes.T)  # by place, so that a step reads one line
        best = np.full((width + 1, rows), -np.inf)
        best[0] = 0
        start = np.zeros((width + 1, rows), np.int32)
        piece = np.full((width + 1, rows), -1, np.int32)
        base, check, value, score = trie.base, trie.check, trie.value, self.score
        for i in range(width):
            row = np.flatnonzero(lens > i)
            alive, now, state, at = row, best[i, row], np.zeros(len(row), np.int32), i
            single = np.zeros(rows, bool)
            while len(alive) and at < width:
                to = base[state] + codes[at, alive]
                on = np.flatnonzero(check[to] == state)
                alive, state, now = alive[on], to[on], now[on]
                at += 1
                found = value[state]
                has = np.flatnonzero(found >= 0)
                r, found = alive[has], found[has]
                if at == i + 1:
                    single[r] = True
                total = now[has] + score[found]
                better = np.flatnonzero(total > best[at, r])
                r = r[better]
                best[at, r], start[at, r], piece[at, r] = total[better], i, found[better]
            lone = row[~single[row]]
            total = best[i, lone] + self.unknown
            better = total > best[i + 1, lone]
            r = lone[better]
            best[i + 1, r], start[i + 1, r], piece[i + 1, r] = total[better], i, -1
        start, piece = start.T, piece.T
        out = []
        for t, n, s, p in zip(texts, lens.tolist(), start.tolist(), piece.tolist()):
            ids: list[int] = []
            while n:
                i = s[n]
                ids += [p[n]] if p[n] >= 0 else self.byte_id[list(t[i:n].encode("utf-8", "replace"))].tolist()[::-1]
                n = i
            out.append(ids[::-1])
        return out

    def segment(self, stretches: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(stretches)
        short = sorted((i for i, t in enumerate(stretches) if len(t) <= LOCKSTEP), key=lambda i: len(stretches[i]))
        for k in range(0, len(short), 8192):  # of like length together
            part = short[k:k + 8192]
            for i, ids in zip(part, self._lockstep([stretches[i] for i in part])):
                out[i] = ids
        for i, t in enumerate(stretches):
            if len(t) > LOCKSTEP:
                out[i] = self._one(t)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's start."""
        parts = [_STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        number, distinct = pd.factorize(np.array(flat, dtype=object))
        distinct = list(distinct)
        new = [t for t in distinct if t not in self.known]
        made = dict(zip(new, self.segment(new)))
        ids = [self.known.get(t) or made[t] for t in distinct]
        if len(self.known) < KNOWN:  # the first ones seen are mostly the frequent ones
            self.known.update(made)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[number]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[number], n)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return pool[at], np.concatenate([[0], ends])[bounds]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(model: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; its normaliser must be the identity.

    Scores of a file made by merges are negative ranks. They become log scores by Zipf's
    law, -ln(2 + rank), the rank at most the number of pieces; scores of other files are used as they are.
    """
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model)
    n = range(s.get_piece_size())
    normal = [not (s.is_control(i) or s.is_unknown(i) or s.is_unused(i) or s.is_byte(i)) for i in n]
    scores = [s.get_score(i) for i in n]
    if all(x == int(x) <= 0 for x in scores):
        scores = [-math.log(2 + min(-x, len(scores))) for x in scores]
    return Vocabulary([s.id_to_piece(i) for i in n], scores, normal)


def encode_decode(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``token_ids``, ``n_tokens``, ``n_byte_tokens`` and ``decoded`` of every row.

    ``model`` is a path that the driver can open; the trie and the pieces (a few MB, as large
    as the vocabulary) are broadcast.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(texts: list[str]) -> dict[str, pa.Array]:
        v = shared.value
        ids, start = v.encode(texts)
        is_byte = np.isin(ids, v.byte_id)
        counts = np.concatenate([[0], np.cumsum(is_byte)])[start]
        flat = ids.tolist()
        decoded = [v.decode(flat[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
        return {"token_ids": pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids, pa.int32())),
                "n_tokens": pa.array(np.diff(start)), "n_byte_tokens": pa.array(np.diff(counts)),
                "decoded": pa.array(decoded, pa.string())}

    return map_texts(docs, keep, text, run,
                     "token_ids array<int>, n_tokens bigint, n_byte_tokens bigint, decoded string")


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, token_ids, n_tokens, n_byte_tokens, ``lossless`` (decoding gives the text back)
    and the SHA-256 of the decoded text."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = encode_decode(src.withColumn("_given", F.xxhash64(F.coalesce("text", F.lit("")))), model,
                        ["doc_id", "_given"], "text")
    return out.select("doc_id", "token_ids", "n_tokens", "n_byte_tokens",
                      (F.xxhash64("decoded") == F.col("_given")).alias("lossless"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
