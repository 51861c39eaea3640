"""Embedding whitening: leading eigenpairs by spectrum slicing, projection, certificate.

Entries become integers ``x = floor(1024 c) + 100000``.  Two passes collect exact
integer sums: first the number of vectors and each dimension's sum, then all
products of centred entries (x less the integer mean; the fraction that is left
is taken off exactly at the end), so the covariance is the correctly rounded
one whatever the partitions.  Only these sums, ``d * (d + 1) / 2`` of them for d
dimensions, reach the driver.

Spectrum slicing: the inertia of ``V - s I``, read from an LDL' factorisation with
symmetric pivots of one or two rows, says how many eigenvalues exceed s.
Bisection by these counts isolates eigenvalue k; Rayleigh quotient iteration,
started by inverse iteration at the interval's middle, converges cubically, and
two counts about the result certify that it is the k-th.  Eigenvalues too close
to tell apart share an interval and get orthogonal vectors.

A third pass measures the covariance of the whitened vectors, the last one
returns the rows.  No pass shuffles vectors.

Defined cases: rows with a null vector, or a null or non-finite entry, are left
out; so are vectors of another length than most have (of equally many, the
longer), and empty ones; entries beyond +-2**40 after scaling saturate there;
null and repeated vec_ids are kept as they are; there are as many components as
dimensions, 8 at most, and none for eigenvalues of under ZERO of the covariance's
norm, which rounding blurs (one vector, or equal ones: an empty result); a deviation beyond a long is null;
no usable vectors give an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS, ZERO = 8, 1e-9
MOST = 1 << 40
_LIMB = 20
#: Vectors that are multiplied at once: products of 2 * (_LIMB + 1) bits then add up exactly in a double.
_ROWS = 1 << 10
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """Integer centre and what the mean exceeds it by, sums, and the components."""

    n: int
    centre: np.ndarray
    rest: list[int]  # n times the mean less n times the centre, exact
    values: np.ndarray
    vectors: np.ndarray  # one component per row
    trace: float

    @property
    def offset(self) -> np.ndarray:
        return np.array([r / self.n for r in self.rest])

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return (y - self.offset) @ (self.vectors.T / np.sqrt(self.values))


def _scaled(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable rows of the batch, by length: their places, and x as an integer matrix."""
    column = batch.column("embedding")
    column = column.cast(pa.large_list(pa.float64()))
    ends = np.asarray(column.offsets)
    first, sizes = ends[:-1], np.diff(ends)
    entries = np.asarray(column.values.fill_null(float("nan")))
    known = ~np.asarray(column.is_null())
    for size in np.unique(sizes[known & (sizes > 0)]):
        places = np.flatnonzero(known & (sizes == size))
        c = entries[first[places][:, None] + np.arange(size)]
        fine = np.isfinite(c).all(axis=1)
        if fine.any():
            with np.errstate(over="ignore"):
                yield places[fine], np.clip(np.floor(SCALE * c[fine]), -MOST, MOST).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for _, x in _scaled(batch):
            one = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            one[0] += len(x)
            one[1] += x.sum(axis=0)
    for size, (n, s) in found.items():
        yield pa.RecordBatch.from_pydict({"size": [size] * size, "i": np.arange(size), "n": [n] * size, "s": s})


def _products(centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products of the entries' two limbs, for pairs of dimensions."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, d, d), np.int64)
        for batch in batches:
            for _, x in _scaled(batch):
                for k in range(0, len(x) if x.shape[1] == d else 0, _ROWS):
                    y = x[k : k + _ROWS] - centre
                    high = (y + (1 << (_LIMB - 1))) >> _LIMB
                    low = (y - (high << _LIMB)).astype(float)
                    total[0] += (low.T @ low).astype(np.int64)
                    if high.any():
                        high = high.astype(float)
                        mixed = (high.T @ low).astype(np.int64)
                        total[1] += mixed + mixed.T
                        total[2] += (high.T @ high).astype(np.int64)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "low": total[0][i, j], "mixed": total[1][i, j], "high": total[2][i, j]})

    return run


def _ldl_counts(v: np.ndarray, shift: float) -> tuple[int, int]:
    """Numbers of positive and of negative eigenvalues of ``v - shift * I``: the inertia of its LDL' factor (Bunch and Parlett's pivots)."""
    a = v - shift * np.eye(len(v))
    floor = np.finfo(float).eps * max(np.abs(a).max(), np.finfo(float).tiny)
    most = (1 + np.sqrt(17)) / 8
    plus = minus = 0
    while len(a):
        k = int(np.abs(np.diag(a)).argmax())
        i, j = divmod(int(np.abs(a).argmax()), len(a))
        if abs(a[k, k]) >= most * abs(a[i, j]):
            pivot = a[k, k] if abs(a[k, k]) > floor else 0.0
            plus, minus = plus + (pivot > 0), minus + (pivot < 0)
            keep = np.delete(np.arange(len(a)), k)
            column = a[keep, k]
            a = a[np.ix_(keep, keep)]
            if pivot:
                a = a - np.outer(column, column / pivot)
        else:  # a block of two rows, one eigenvalue of each sign
            plus, minus = plus + 1, minus + 1
            keep = np.delete(np.arange(len(a)), [i, j])
            columns, block = a[np.ix_(keep, [i, j])], a[np.ix_([i, j], [i, j])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
    return plus, minus


def _refined(v: np.ndarray, low: float, high: float, found: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from ``start``, held in the interval and orthogonal to the vectors found before."""
    unit, scale = np.eye(len(v)), np.abs(v).max()

    def cleaned(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for f in found:
                x = x - (f @ x) * f
        return x / np.linalg.norm(x)

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0, 1, 4, 16, 64):  # an exact eigenvalue leaves nothing to divide by
            try:
                return np.linalg.solve(v - (shift + nudge * np.finfo(float).eps * scale) * unit, x)
            except np.linalg.LinAlgError:
                continue
        return x

    x = cleaned(start)
    for _ in range(4):  # inverse iteration: towards the only eigenvalue of the interval
        x = cleaned(solved((low + high) / 2, x))
    best = (np.inf, 0.0, x)
    for _ in range(12):
        e = float(x @ (v @ x))
        residual = float(np.linalg.norm(v @ x - e * x))
        if residual >= best[0] / 2 and best[0] < np.inf:
            break
        best = min(best, (residual, e, x), key=lambda b: b[0])
        x = cleaned(solved(min(max(e, low), high), x))
    return best[1], best[2]


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues of the symmetric ``v`` that exceed ZERO of its norm, and their unit vectors as rows."""
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    rounding = 8 * d * np.finfo(float).eps * scale
    above = lambda s: _ldl_counts(v, s)[0]
    values, vectors = [], []
    rng = np.random.default_rng(13)
    for k in range(1, min(most, d) + 1):
        low, high = ZERO * scale, scale * (1 + 1e-9)  # all eigenvalues lie below the largest row sum
        if above(low) < k:
            break
        while high - low > rounding:  # more than k - 1 exceed low, at most k - 1 exceed high
            width = high - low
            if above(high + 4 * width) == k - 1 and above(low - 4 * width) == k:
                break  # the middle is far nearer to this eigenvalue than to any other
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        e, x = _refined(v, low, high, vectors, rng.standard_normal(d))
        slack = max(rounding, 4 * float(np.linalg.norm(v @ x - e * x)))
        if not (above(e + slack) < k <= above(e - slack)):
            raise ArithmeticError(f"component {k} is not certified by the counts about {e}")
        values.append(e)
        vectors.append(x)
    return np.array(values), np.array(vectors).reshape(len(values), d)


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """The components of ``vectors(embedding)``; None if there are none."""
    rows = vectors.select("embedding")
    sums = rows.mapInArrow(_sums, "size long, i long, n long, s long").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    sizes = sums.filter("i = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0].size, sizes[0].n
    s = [int(r.s) for r in sums.filter(F.col("size") == d).orderBy("i").collect()]
    centre = [(2 * x + n) // (2 * n) for x in s]
    rest = [x - n * c for x, c in zip(s, centre, strict=True)]
    cells = rows.mapInArrow(_products(np.array(centre, np.int64)), "i long, j long, low long, mixed long, high long")
    limbs = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "mixed", "high")]
    v = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(*limbs).collect():
        gram = int(r.low) + (int(r.mixed) << _LIMB) + (int(r.high) << 2 * _LIMB)
        v[r.i, r.j] = v[r.j, r.i] = Fraction(n * gram - rest[r.i] * rest[r.j], n * n)
    values, components = leading(v, most)
    return Fit(n, np.array(centre, np.int64), rest, values, components, float(np.trace(v))) if len(values) else None


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance, as measured over all of them, minus the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _scaled(batch):
                if x.shape[1] == len(model.centre):
                    w = model.whiten(x - model.centre)
                    first += w.sum(axis=0)
                    second += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(-1, k), k), "j": np.tile(np.arange(k), k + 1), "s": np.concatenate([first, second.ravel()])})

    cells = vectors.select("embedding").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    found = {(r.i, r.j): r.s / model.n for r in cells}
    return max(abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i in range(k) for j in range(k))


def _deviations(y: np.ndarray, model: Fit) -> pa.Array:
    """Sums of squares of ``n * x - S``, exact; null beyond a long."""
    reach = float(model.n) * (float(np.abs(y).max(initial=0)) + 1)
    if y.shape[1] * reach * reach < 2.0**62:
        return pa.array(((model.n * y - np.array(model.rest, np.int64)) ** 2).sum(axis=1))
    exact = ((model.n * y.astype(object) - np.array(model.rest, object)) ** 2).sum(axis=1)
    return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``vectors(vec_id, embedding)``."""
    model = fit(vectors, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    error, k = identity_error(vectors, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _scaled(batch):
                if x.shape[1] == len(model.centre):
                    y = x - model.centre
                    each = np.repeat(np.arange(len(places)), k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "vec_id": batch.column("vec_id").take(pa.array(places[each])), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(places)),
                            "n": np.full(len(each), model.n), "deviation": _deviations(y, model).take(pa.array(each)), "whitened": model.whiten(y).ravel(),
                            "explained": np.tile(model.values / model.trace, len(places)), "identity_error": np.full(len(each), error),
                        }
                    )

    return vectors.select("vec_id", "embedding").mapInArrow(run, _OUT)
