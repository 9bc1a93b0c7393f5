"""Whitening: vectors centred, turned to the principal axes of their covariance, and scaled to unit variance.

Count, mean and centred scatter of a set of vectors follow from those of its parts (Chan, Golub and LeVeque), so each
partition sums its own and a tree of pairwise merges gives the whole: numbers of dimensions squared move, never rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Of n vectors: the mean is base + rest / n, with whole numbers in base, so that sums of integers are exact as long as
    those of their distances from the base stay below 2^53. scatter sums products of deviations from the mean."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray) -> Moments:
        base = np.floor(a.mean(0))
        off = a - base
        rest = off.sum(0)
        off -= rest / len(a)
        return cls(len(a), base, rest, off.T @ off)

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        if len(self.base) != len(other.base):
            raise ValueError("vectors differ in their number of dimensions")
        n, apart = self.n + other.n, other.base - self.base
        gap = apart + (other.rest / other.n - self.rest / self.n)
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n))
        rest = self.rest + other.rest + other.n * apart
        whole = np.floor(rest / n)
        return Moments(n, self.base + whole, rest - n * whole, scatter)

    @classmethod
    def none(cls) -> Moments:
        return cls(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))

    def sums(self) -> list[int]:
        return [self.n * int(b) + int(r) for b, r in zip(self.base, self.rest, strict=True)]

    def packed(self) -> bytes:
        return np.int64(self.n).tobytes() + self.base.tobytes() + self.rest.tobytes() + self.scatter.tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Moments:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        a = np.frombuffer(raw, np.float64, offset=8)
        d = int(np.sqrt(len(a) + 1)) - 1  # d + d + d * d numbers
        return cls(n, a[:d], a[d : 2 * d], a[2 * d :].reshape(d, d))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles; vectors of different length are an error."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError("vectors differ in their number of dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector isn't null and holds neither nulls nor numbers that aren't finite."""
    finite = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return rows.where(F.coalesce(F.col(vector_col).isNotNull() & finite, F.lit(False)))


def _reduced(parts: DataFrame) -> Moments:
    """The moments of all vectors from one packed state a partition, merged along a tree."""
    states = parts.rdd
    if not states.getNumPartitions():
        return Moments.none()
    return Moments.unpacked(states.map(lambda r: bytes(r[0])).treeReduce(
        lambda a, b: Moments.unpacked(a).merged(Moments.unpacked(b)).packed(), depth=3))


def moments(rows: DataFrame, vector_col: str = "embedding", turned: Whitening | None = None) -> Moments:
    """Of all vectors of rows, or of what `turned` makes of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.none()
        for b in batches:
            if b.num_rows:
                a = _matrix(b.column(0))
                state = state.merged(Moments.of(a if turned is None else turned.of(a)))
        yield pa.RecordBatch.from_arrays([pa.array([state.packed()], pa.binary())], ["state"])

    return _reduced(rows.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "state binary"))


@dataclass(frozen=True)
class Whitening:
    fitted: Moments
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def of(self, a: np.ndarray) -> np.ndarray:
        m = self.fitted
        return ((a - m.base) - m.rest / m.n) @ self.axes / np.sqrt(self.variances)


def fit(rows: DataFrame, vector_col: str = "embedding", most: int = 32) -> Whitening:
    """Up to `most` components by falling variance (divisor n), solved on the driver from dimensions squared numbers.
    Components whose variance is zero, but for rounding, can't be scaled and are left out; so no vectors, or equal ones,
    have none. Of a component's two signs, that which makes its largest entry positive is taken."""
    m = moments(rows, vector_col)
    if not m.n or not m.base.size:
        return Whitening(m, np.zeros((len(m.base), 0)), np.zeros(0), 0.0)
    v = m.scatter / m.n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > len(values) * np.finfo(float).eps * max(values[0], 0.0)
    values, axes = values[real][:most], axes[:, real][:, :most]
    if values.size:
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Whitening(m, axes, values, float(np.trace(v)))


def identity_error(rows: DataFrame, w: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, by a second pass; 0 without any."""
    if not w.variances.size:
        return 0.0
    m = moments(rows, vector_col, w)
    return float(np.abs(m.scatter / m.n - np.eye(len(w.variances))).max())


def whitened(rows: DataFrame, w: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained: a row for each row and component.

    `deviation` is the sum over dimensions of (n x - sum of x)^2, exact: entries must be whole numbers below 2^53 in size,
    and what doesn't fit a long is an error. Rows with null or non-finite vectors must be gone (`usable`); vectors of
    different length are an error. Repeated rows count and come out repeatedly, null ids stay null, other columns are left
    out. The model that every task gets has dimensions times components numbers."""
    data = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = data.schema["vec_id"].dataType.simpleString()
    k, n, explained = len(w.variances), w.fitted.n, w.variances / (w.trace or 1.0)

    def deviations(a: np.ndarray) -> np.ndarray:
        off = a - w.fitted.base
        if (a != np.floor(a)).any() or np.abs(a).max(initial=0) >= 2**53:
            raise ValueError("exact deviations need whole numbers below 2^53")
        near = n * np.abs(off).max(initial=0) + np.abs(w.fitted.rest).max(initial=0)
        whole = off.astype(np.int64), w.fitted.rest.astype(np.int64)
        if near * near * a.shape[1] < 2**62:
            return ((n * whole[0] - whole[1]) ** 2).sum(1)
        exact = ((n * whole[0].astype(object) - whole[1].astype(object)) ** 2).sum(1)
        if exact.max() >= 2**63:
            raise OverflowError("a deviation doesn't fit a long")
        return exact.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if k else 0, 2000):
                b = whole.slice(at, 2000)
                a = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(len(a)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(a))), pa.array(np.full(len(a) * k, n)),
                     pa.array(np.repeat(deviations(a), k)), pa.array(w.of(a).ravel()), pa.array(np.tile(explained, len(a)))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return data.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double")
