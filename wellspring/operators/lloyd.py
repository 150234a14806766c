"""Lloyd's iterations of many KMeans fits in one pass over the rows (ML4).

A fit of its own reads all rows in each of its up to 300 iterations. Here one job an iteration serves all
fits that have not converged: a task multiplies a piece of rows by the centers of all fits at once. The
nearest center is the one that 64-bit arithmetic finds (ties: the first); 32-bit products only rule out the
centers that are farther by more than their rounding error. Sums, sizes and costs are 64-bit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.core.rdd import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, the unit in which rows are dealt to tasks.
BLOCK_ROWS = 2048
#: Distances that a task holds at a time.
CELLS = 1 << 20


@dataclass
class Summary:
    """``trainingCost``: sum of squared distances to the centers that the last iteration began with, as in MLlib."""

    trainingCost: float
    numIter: int


@dataclass
class Centroids:
    """A fitted KMeans: its centers and the summary of the fit."""

    centers: np.ndarray
    summary: Summary

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)


def vectors(df: DataFrame, emb_col: str) -> Column:
    """The embedding as floats, or as doubles if it is not an array of floats."""
    kind = df.schema[emb_col].dataType
    as_is = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(emb_col) if as_is else F.col(emb_col).cast("array<double>")


def matrix(rows: pa.ListArray) -> np.ndarray:
    """One row a vector. NULLs and vectors of several lengths are errors, as they are for MLlib."""
    flat = rows.flatten()
    width = len(flat) // max(len(rows), 1)
    if rows.null_count or flat.null_count or not pc.all(pc.equal(pc.list_value_length(rows), width)).as_py():
        raise ValueError("embeddings must be vectors of one length without NULLs")
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), width)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            m = matrix(batch.column(0).slice(at, BLOCK_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())],
                                             ["width", "block"])


def _unpack(dtype: str, row) -> np.ndarray:
    return np.frombuffer(row.block, dtype).reshape(-1, row.width)


def blocks(df: DataFrame, emb_col: str, rows: int) -> RDD:
    """The vectors of ``df`` (of ``rows`` rows) as blocks, dealt evenly to tasks and persisted."""
    vec = df.select(vectors(df, emb_col).alias("v"))
    dtype = "f4" if isinstance(vec.schema["v"].dataType.elementType, T.FloatType) else "f8"
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS)))
    packed = vec.mapInArrow(_pack, "width int, block binary").repartition(tasks)
    return packed.rdd.map(partial(_unpack, dtype)).persist(StorageLevel.MEMORY_AND_DISK)


class Nearest:
    """Which center of each fit is nearest; ``groups`` has the centers of fits with equally many, fit x center x dim."""

    def __init__(self, groups: Sequence[np.ndarray]):
        self.groups = groups
        self.squares = [(g * g).sum(2) for g in groups]
        sides = [np.concatenate([-2 * g, s[:, :, None]], axis=2).reshape(-1, g.shape[2] + 1)
                 for g, s in zip(groups, self.squares)]
        with np.errstate(over="ignore", invalid="ignore"):
            self.sides = np.concatenate(sides).astype("f4")
        self.rows = max(64, min(512, CELLS // len(self.sides)))
        self.kept = {}

    def space(self, what: str, n: int, dtype: str) -> np.ndarray:
        """Center x row, used again for each piece of as many rows."""
        if (what, n) not in self.kept:
            self.kept[what, n] = np.empty((len(self.sides), n), dtype)
        return self.kept[what, n]

    def masks(self, x1: np.ndarray) -> list[np.ndarray]:
        """For rows ``x1`` (64-bit, a 1 at the end) and each group: fit x center x row, true at the nearest center.
        They hold until the next call."""
        x, dim = x1[:, :-1], x1.shape[1] - 1
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        out, at = [], 0
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.matmul(self.sides, x1.astype("f4").T, out=self.space("far", len(x1), "f4"))  # |c|^2 - 2 x.c
            near = self.space("near", len(x1), "?")
            for group, squares in zip(self.groups, self.squares):
                fits, k, _ = group.shape
                d, mask = (m[at:at + fits * k].reshape(fits, k, -1) for m in (far, near))
                at += fits * k
                low = np.minimum.reduce(d, axis=1)
                reach = np.sqrt(squares.max())
                # rounding of dim + 1 products, of their sum and of the inputs, for both centers that are compared
                error = (dim + 16) * 2.0 ** -23 * (2 * reach * norm + reach * reach) + (dim + 16) * 1e-37
                np.less_equal(d, (low + error.astype("f4"))[:, None, :], out=mask)
                found = np.add.reduce(mask.view("u1"), axis=1, dtype="u1" if k < 256 else "i8")
                unsure = (found != 1) | ~np.isfinite(low)
                for fit in np.flatnonzero(unsure.any(axis=1)):
                    some = np.flatnonzero(unsure[fit])
                    exact = squares[fit][:, None] - 2 * (group[fit] @ x[some].T)
                    mask[fit][:, some] = False
                    mask[fit][exact.argmin(axis=0), some] = True
                out.append(mask)
        return out


def _shifted(block: np.ndarray, shift: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Pieces of ``block`` in 64 bits, less ``shift``, with a 1 at the end of each row."""
    for at in range(0, len(block), rows):
        x1 = np.ones((len(block[at:at + rows]), len(shift) + 1))
        np.subtract(block[at:at + rows], shift, out=x1[:, :-1])
        yield x1


def _sums(sent, part: Iterable[np.ndarray]) -> Iterator[tuple[float, list[np.ndarray]]]:
    """The sum of squares of a task's rows and, for each group, the sums and sizes of the clusters."""
    shift, groups = sent.value
    nearest = Nearest(groups)
    square, sums, piece = 0.0, np.zeros((len(nearest.sides), len(shift) + 1)), np.empty((len(nearest.sides), len(shift) + 1))
    for block in part:
        for x1 in _shifted(block, shift, nearest.rows):
            square += float(np.einsum("ij,ij->", x1[:, :-1], x1[:, :-1]))
            nearest.masks(x1)
            ones = nearest.space("ones", len(x1), "f8")
            np.copyto(ones, nearest.space("near", len(x1), "?"))
            sums += np.matmul(ones, x1, out=piece)
    ends = np.cumsum([g.shape[0] * g.shape[1] for g in groups])[:-1]
    yield square, [s.reshape(g.shape[0], g.shape[1], -1) for s, g in zip(np.split(sums, ends), groups)]


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]


def lloyd(rows: RDD, starts: Sequence[np.ndarray], max_iter: int, tol: float = 1e-4) -> list[Centroids]:
    """The fits that begin with the centers ``starts``, each until no center moves by more than ``tol``."""
    sc, parts = rows.context, rows.getNumPartitions()
    shift = starts[0].mean(axis=0)  # near the rows: squares are then small beside their rounding error
    centers = [s - shift for s in starts]
    fits = [Summary(0.0, 0) for _ in starts]
    active = range(len(starts))
    for _ in range(max_iter):
        if not active:
            break
        by_size = defaultdict(list)
        for i in active:
            by_size[len(centers[i])].append(i)
        sent = sc.broadcast((shift, [np.stack([centers[i] for i in of]) for of in by_size.values()]))
        square, sums = rows.mapPartitions(partial(_sums, sent)).treeReduce(_added, depth=1 if parts <= 32 else 2)
        sent.destroy()
        active = []
        for i, found in ((i, f) for of, group in zip(by_size.values(), sums) for i, f in zip(of, group)):
            old, total, size = centers[i], found[:, :-1], found[:, -1:]
            cost = square + float((size * old * old).sum() - 2 * (total * old).sum())
            fits[i] = Summary(max(cost, 0.0), fits[i].numIter + 1)
            centers[i] = np.where(size > 0, total / np.maximum(size, 1), old)
            if ((centers[i] - old) ** 2).sum(axis=1).max() > tol * tol:
                active.append(i)
    return [Centroids(c + shift, s) for c, s in zip(centers, fits)]


def nearest_center(vec: Column, centers: np.ndarray) -> Column:
    """The index of the center nearest to ``vec``."""
    shift = centers.mean(axis=0)

    @F.arrow_udf("int")
    def found(rows: pa.Array) -> pa.Array:
        nearest = Nearest([(centers - shift)[None]])
        ids = [nearest.masks(x1)[0][0].argmax(axis=0) for x1 in _shifted(matrix(rows), shift, nearest.rows)] if len(rows) else []
        return pa.array(np.concatenate(ids) if ids else [], pa.int32())
    return found(vec)
