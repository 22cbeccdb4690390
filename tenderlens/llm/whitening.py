"""Whitening of embeddings by the leading eigenvectors of their covariance.

Spark sums the vectors, sums the products of the centred vectors, and projects every row; only
sums of one number, d numbers and d x d numbers reach the driver, d being the dimension. There the
spectrum of the covariance V is sliced: the pivots of an LDLᵀ factorisation of V - s count its
eigenvalues above s (Sylvester's law of inertia), which cuts the spectrum into intervals with one
eigenvalue each; Rayleigh quotient iteration converges inside an interval, and two more counts
around every result certify its number.

An entry c is used as the integer x = floor(64 c) + 1000000; sums of x are exact at any size. A
null vector, or one with null or non-finite entries, is dropped, and so is one that is not as long
as most (of equally frequent lengths the longest counts; a missing entry is no entry). Repeated
rows and repeated or null ids are rows like others. Components whose eigenvalue is not above
rounding noise of the largest cannot be whitened and are left out, so rows without spread (one row,
equal rows, an empty table) give no result rows. An entry beyond the range of x is set to its end,
and a deviation beyond that of a long is null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Largest x; far from the end of a long, so that sums of two of them are safe.
MOST = 1 << 61
#: Rows that are worked on at a time.
BLOCK = 4096
EPS = np.finfo(float).eps

SCHEMA = """vec_id long, component int, n long, deviation long, whitened double,
    explained double, identity_error double"""


# --- rows as numpy arrays

def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector of the rows that count, vectors as doubles, all of one length."""
    rows = embeddings.select(F.col(f"`{key}`").cast("long").alias("vec_id"),
                             F.col(f"`{vector}`").cast("array<double>").alias("v"))
    # A comparison with null is null, and `forall` then is not true.
    rows = rows.filter("v is not null and size(v) > 0 and "
                       "forall(v, c -> c is not null and abs(c) < double('infinity'))")
    top = (rows.groupBy(F.size("v").alias("d")).count()
           .orderBy(F.desc("count"), F.desc("d")).first())
    return rows.filter(F.size("v") == (top["d"] if top else 0))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """x of the vectors of a batch, one row each."""
    c = np.asarray(column.flatten(), float).reshape(-1, d)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * c)
    return np.clip(x, -MOST, MOST).astype(np.int64) + SHIFT


def blocks(batches, d: int):
    """(ids, x) of at most ``BLOCK`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), integers(part.column(1), d)


def spread(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list]:
    """x - S/n as doubles, and the sum of (n x - S)^2 of each row as an exact integer."""
    far = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if 4 * far * far * len(sums) < 1 << 62:
        z = n * x - np.array(sums, np.int64)
        return z / n, (z * z).sum(1).tolist()
    z = n * x.astype(object) - np.array(sums, object)
    return (z / n).astype(float), [int(s) for s in (z * z).sum(1)]


# --- sums over all rows

def column_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of x in every dimension."""
    def run(batches):
        n, total = 0, [0] * d
        for _, x in blocks(batches, d):
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF
            total = [t + (int(h) << 32) + int(w)
                     for t, h, w in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
            "high": pa.array([t >> 32 for t in total], pa.int64()),
            "low": pa.array([t & 0xFFFFFFFF for t in total], pa.int64())})

    found = (rows.mapInArrow(run, "i int, n long, high long, low long").groupBy("i")
             .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
             .orderBy("i").collect())
    return (found[0].n, [(r.high << 32) + r.low for r in found]) if found else (0, [0] * d)


def product_sums(rows: DataFrame, values, k: int, d: int) -> np.ndarray:
    """k x k sums of products of the numbers that ``values(x)`` gives for each row.

    Each task gives one partial matrix, as rows of it; they are added up key by key.
    """
    def run(batches):
        total = np.zeros((k, k))
        for _, x in blocks(batches, d):
            y = values(x)
            total += y.T @ y
        at, other = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()),
                                          "j": pa.array(other, pa.int32()),
                                          "s": pa.array(total.ravel())})

    out = np.zeros((k, k))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j") \
            .agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = r.s
    return (out + out.T) / 2


# --- the spectrum of one symmetric matrix

def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: positive pivots of LDLᵀ of v - shift, with symmetric
    pivoting in blocks of one or two (Bunch and Kaufman's choice of pivots)."""
    a = v - shift * np.eye(len(v))
    alpha, found = (1 + 17 ** 0.5) / 8, 0
    floor = EPS * EPS * (np.abs(a).max(initial=0) or 1)
    while len(a):
        if len(a) == 1:
            return found + int(a[0, 0] > 0)
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax())
        most, width = column[r - 1], 1
        if max(abs(a[0, 0]), most) <= floor:
            found, a = found + int(a[0, 0] > 0), a[1:, 1:]
            continue
        if abs(a[0, 0]) < alpha * most:
            beside = np.abs(a[r]).copy()
            beside[r] = 0
            most_r = beside.max()
            if abs(a[0, 0]) * most_r >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * most_r:
                a = _swapped(a, 0, r)
            else:
                a, width = _swapped(a, 1, r), 2
        if width == 1:
            found += int(a[0, 0] > 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / a[0, 0])
        else:
            found += 1  # such a block has one eigenvalue of each sign
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return found


def _swapped(a: np.ndarray, i: int, j: int) -> np.ndarray:
    order = np.arange(len(a))
    order[[i, j]] = j, i
    return a[np.ix_(order, order)]


def slices(v: np.ndarray, wanted: int, narrow: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, number) from the top that hold the ``wanted`` largest eigenvalues:
    one in each, or several in one that is no wider than ``narrow``."""
    reach = np.abs(v).sum(1).max(initial=0) * (1 + 1e-12) + narrow
    todo = [(-reach, reach, len(v), 0)]
    out, have = [], 0
    while todo and have < wanted:
        low, high, below, above = todo.pop()  # numbers above low and above high
        if below - above == 0:
            continue
        if below - above == 1 or high - low <= narrow:
            out.append((low, high, below - above))
            have += below - above
            continue
        middle = (low + high) / 2
        at = min(max(count_above(v, middle), above), below)
        todo += [(low, middle, below, at), (middle, high, at, above)]
    return out


def quotient_iteration(v: np.ndarray, low: float, high: float, scale: float, found: np.ndarray,
                       seed: int) -> tuple[float, np.ndarray] | None:
    """The eigenpair inside an interval, or None if the iteration leaves it."""
    x = np.random.default_rng(seed).standard_normal(len(v))
    shift = (low + high) / 2
    for step in range(40):
        x = x - found @ (found.T @ x)
        x /= np.linalg.norm(x)
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (shift + 4 * EPS * scale) * np.eye(len(v)), x)
        if not np.isfinite(y).all():
            break
        y = y - found @ (found.T @ y)
        x = y / np.linalg.norm(y)
        value = x @ v @ x
        if np.linalg.norm(v @ x - value * x) <= 8 * EPS * scale * len(v) ** 0.5:
            return (value, x) if low <= value <= high else None
        # Two steps at the fixed shift first: they pull towards the interval's own pair.
        if step >= 1:
            shift = value
            if not low <= value <= high:
                return None
    return None


def cluster(v: np.ndarray, low: float, high: float, m: int, scale: float,
            found: np.ndarray, seed: int) -> list[tuple[float, np.ndarray]]:
    """m eigenpairs that rounding cannot tell apart, by inverse iteration on a block."""
    x = np.random.default_rng(seed).standard_normal((len(v), m))
    shifted = v - ((low + high) / 2 + 2 * EPS * scale) * np.eye(len(v))
    for _ in range(6):
        x = x - found @ (found.T @ x)
        x = np.linalg.qr(np.linalg.solve(shifted, x))[0]
    x = np.linalg.qr(x - found @ (found.T @ x))[0]
    return sorted(((float(c @ v @ c), c) for c in x.T), key=lambda p: -p[0])


def numbered(v: np.ndarray, value: float, i: int, noise: float) -> bool:
    """Whether counts around ``value`` show that it is eigenvalue i from the top, from 0 on."""
    return count_above(v, value + noise) <= i < count_above(v, value - noise)


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    Raises if counts around a result contradict its number.
    """
    scale = np.abs(v).sum(1).max(initial=0)
    if scale == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    noise = 64 * EPS * scale * len(v) ** 0.5
    values, found = [], np.zeros((len(v), 0))
    todo = slices(v, min(wanted, len(v)), noise)[::-1]
    while todo:
        low, high, m = todo.pop()
        seed = found.shape[1]
        pair = quotient_iteration(v, low, high, scale, found, seed) if m == 1 else None
        if pair and not numbered(v, pair[0], seed, noise):
            pair = None
        if pair is None and high - low > noise:
            middle = (low + high) / 2
            todo.append((middle, high, m) if count_above(v, middle) > seed else (low, middle, m))
            continue
        for value, x in ([pair] if pair else cluster(v, low, high, m, scale, found, seed)):
            values.append(value)
            found = np.column_stack([found, x])
    values, found = np.array(values[:wanted]), found[:, :wanted]
    for i, value in enumerate(values):
        if not numbered(v, value, i, noise):
            raise ArithmeticError(f"eigenvalue {i + 1} is not the one of that number")
    return values, found


# --- the operator

@dataclass(frozen=True)
class Whitening:
    """What whitens a vector, fitted on all rows; of the size of d x components numbers."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def of(self, y: np.ndarray) -> np.ndarray:
        return y @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """``rows`` as ``usable`` gives them."""
    first = rows.select(F.size("v")).first()
    d = first[0] if first else 0
    if not d:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = column_sums(rows, d)
    v = product_sums(rows, lambda x: spread(x, n, sums)[0], d, d) / n
    values, vectors = leading(v, components)
    keep = values > d * 16 * EPS * values.max(initial=0)
    return Whitening(n, sums, values[keep], vectors[:, keep], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity.

    The rows are centred before they are projected, so the projections' mean is zero.
    """
    k = len(model.values)
    if not k:
        return 0.0
    n, sums = model.n, model.sums
    found = product_sums(rows, lambda x: model.of(spread(x, n, sums)[0]), k, len(sums)) / n
    return float(np.abs(found - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, error: float = 0.0) -> DataFrame:
    """One row per vector and component."""
    k, d = len(model.values), len(model.sums)
    explained = model.values / model.trace if model.trace else model.values

    def run(batches):
        if not k:
            return
        for ids, x in blocks(batches, d):
            y, squares = spread(x, model.n, model.sums)
            squares = [s if s < 1 << 63 else None for s in squares]
            times = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(times),
                "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(len(x) * k, model.n), pa.int64()),
                "deviation": pa.array(squares, pa.int64()).take(times),
                "whitened": pa.array(model.of(y).ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(x) * k, error))})

    return rows.mapInArrow(run, SCHEMA)


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """Every usable row, whitened by a fit on all of them, with the measured error of the fit."""
    rows = usable(embeddings, key, vector)
    model = fit(rows, components)
    return whiten(rows, model, identity_error(rows, model))
