"""Embedding whitening by principal components, found by the Jacobi-Davidson method.

The covariance matrix is never formed. A product with it is one Spark job: each task multiplies its
centred rows with a block of vectors and gives one partial sum, and the sums meet by a shuffle on
the entry's number. The driver holds a few vectors of the embedding's dimension, never rows.

A subspace is searched by Rayleigh-Ritz. Leading pairs whose residual has reached double precision
are locked and projected out; for the next ones the correction equation, projected against locked
vectors and the pair's own, is solved roughly by MINRES, all of a block in step, so that one job
serves the whole block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Pairs that are corrected at once, and inner steps for each correction.
BLOCK, INNER = 8, 5
#: A residual of this many units in the last place of the greatest eigenvalue counts as zero.
ULPS = 64


def grid_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, y): whole vectors as longs floor(64 c), without the offset; and their dimension."""
    c = F.col(vector_col)
    whole = df.filter(c.isNotNull()).select(F.col(id_col).alias("id"), c.cast("array<double>").alias("v")).filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    longs = whole.select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("y"))
    longs = materialize(longs, "grid-vectors")
    most = longs.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    return longs.filter(F.size("y") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(rows: DataFrame, d: int, fold: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray | None:
    """The sum of ``fold(matrix of rows)`` over all rows; None where there are none.

    Tasks' sums are added in the order of the tasks, so that a result does not depend on timing.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fold(_matrix(batch.column("y"), d))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            task = np.full(len(flat), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["task", "entry", "value"]
            )

    parts = rows.select("y").mapInArrow(partial, f"task int, entry int, value {kind}")
    # a list has one number for each task
    listed = parts.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("task", "value"))).alias("v"))
    summed = listed.select("entry", F.aggregate("v", F.lit(0).cast(kind), lambda a, x: a + x["value"]).alias("value"))
    found = sorted(summed.collect())  # as many rows as fold's result has entries
    return np.array([value for _, value in found]) if found else None


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to ``against`` and each other; those that vanish go."""
    kept: list[np.ndarray] = []
    for column in new.T:
        basis = np.column_stack([against, *kept]) if against.size or kept else np.zeros((len(column), 0))
        size = np.linalg.norm(column)
        if size == 0 or not np.isfinite(size):
            continue
        column = column / size
        for _ in range(3):  # the second pass removes what rounding left, the third what a tiny rest magnified
            column = column - basis @ (basis.T @ column)
            rest = np.linalg.norm(column)
            if rest < 1e-10:
                break
            column = column / rest
        else:
            kept.append(column)
    return np.column_stack(kept) if kept else np.zeros((len(new), 0))


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, shifts: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Approximate solutions of P (A - shift) P t = right, a column for each shift, all in step.

    ``product`` gives A times a block, ``project`` applies each column's P. After ``steps`` products
    the residual is least over each column's Krylov space.
    """
    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.divide(v, beta, out=np.zeros_like(v), where=live)
    before, x = np.zeros_like(v), np.zeros_like(v)
    d1, d2 = np.zeros_like(v), np.zeros_like(v)
    # the last two rotations of the tridiagonal matrix, and the right side that is left
    c0, s0, c1, s1 = np.ones(len(beta)), np.zeros(len(beta)), np.ones(len(beta)), np.zeros(len(beta))
    eta, last = beta.copy(), np.zeros(len(beta))
    for _ in range(steps):
        w = project(product(v) - v * shifts)
        alpha = (v * w).sum(axis=0)
        w = w - v * alpha - before * last
        following = np.linalg.norm(w, axis=0)
        up2 = s0 * last
        up1 = c0 * c1 * last + s1 * alpha
        level = c1 * alpha - s1 * c0 * last
        radius = np.hypot(level, following)
        usable = live & (radius > 0)
        safe = np.where(usable, radius, 1.0)
        c, s = level / safe, following / safe
        direction = np.where(usable, (v - d1 * up1 - d2 * up2) / safe, 0.0)
        x = x + direction * np.where(usable, c * eta, 0.0)
        eta = -s * eta
        d2, d1 = d1, direction
        c0, s0, c1, s1 = c1, s1, c, s
        live = usable & (following > 1e-14 * np.maximum(radius, 1e-300))
        before, last = v, np.where(live, following, 0.0)
        v = np.where(live, w / np.where(live, following, 1.0), 0.0)
        if not live.any():
            break
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, inner: int = INNER, most: int | None = None, rounds: int = 500, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the ``wanted`` greatest, falling, by Jacobi-Davidson.

    ``product`` applies a symmetric matrix of order ``d`` without negative eigenvalues to a block.
    The search space has ``most`` vectors at most (three blocks over the wanted ones by default).
    """
    wanted, block = min(wanted, d), min(block, d)
    most = max(2 * block, wanted + 3 * block if most is None else most)
    locked = np.zeros((d, 0))
    space = _orthonormal(np.random.default_rng(seed).standard_normal((d, block)), locked)
    image = product(space)
    greatest = 0.0
    for _ in range(rounds):
        rayleigh = space.T @ image
        theta, turn = np.linalg.eigh((rayleigh + rayleigh.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        greatest = max([greatest, *np.abs(theta[:1])])
        rest = image - space * theta
        rest = rest - locked @ (locked.T @ rest)
        done = np.linalg.norm(rest, axis=0) <= ULPS * np.finfo(float).eps * greatest
        first = int(np.argmin(done)) if not done.all() else len(done)
        first = min(first, wanted - locked.shape[1])  # pairs are locked from the greatest on
        locked = np.column_stack([locked, space[:, :first]])
        space, image, theta, rest = space[:, first:], image[:, first:], theta[first:], rest[:, first:]
        if locked.shape[1] == wanted:
            break
        if space.shape[1] + block > most:
            space, image = space[:, : most - block], image[:, : most - block]
            theta, rest = theta[: most - block], rest[:, : most - block]
        near = min(block, space.shape[1])
        u = space[:, :near]

        def project(columns: np.ndarray, u=u) -> np.ndarray:
            columns = columns - locked @ (locked.T @ columns)
            return columns - u * (u * columns).sum(axis=0)

        new = minres(product, -rest[:, :near], theta[:near], project, inner) if near else np.zeros((d, 0))
        basis = np.column_stack([locked, space])
        new = _orthonormal(new, basis)
        if not new.shape[1] and basis.shape[1] < d:  # nothing new: search on from elsewhere
            new = _orthonormal(np.random.default_rng(seed + locked.shape[1] + 1).standard_normal((d, block)), basis)
        if not new.shape[1]:
            # the whole space is spanned, so products with fresh vectors settle what rounding has left
            image = product(space)
            continue
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    else:
        raise ArithmeticError(f"{locked.shape[1]} of {wanted} components after {rounds} rounds")
    # one Rayleigh-Ritz step with fresh products, and the order by eigenvalue
    locked = np.linalg.qr(locked)[0]
    rayleigh = locked.T @ product(locked)
    theta, turn = np.linalg.eigh((rayleigh + rayleigh.T) / 2)
    return theta[::-1], (locked @ turn)[:, ::-1]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c counts as floor(64 c) + 1000000. Rows whose vector is null, or holds a null or an
    entry that is not finite, or has another length than most vectors (of equally frequent lengths
    the greater), are left out of fit and result. Repeated rows and ids each count and are returned.
    Components beyond the rank, whose eigenvalue is zero to double precision, have a null
    ``whitened``. Without vectors, or with vectors of no entries, the result is empty. A ``deviation``
    beyond the range of longs raises OverflowError. Other columns are not read.
    """
    rows, d = grid_vectors(df, id_col, vector_col)
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    counted = _totals(rows, d, lambda y: np.append(y.sum(axis=0), len(y)), "long") if d else None
    if counted is None:
        return df.sparkSession.createDataFrame([], schema)
    sums, n = counted[:-1].astype(np.int64), int(counted[-1])
    mean = sums / n

    def product(block: np.ndarray) -> np.ndarray:
        def fold(y: np.ndarray) -> np.ndarray:
            centred = y - mean
            return centred.T @ (centred @ block)

        return _totals(rows, d, fold).reshape(d, -1) / n

    trace = float(_totals(rows, d, lambda y: ((y - mean) ** 2).sum(axis=0)).sum()) / n
    values, vectors = leading_pairs(product, d, components)
    sound = values > d * np.finfo(float).eps * max(values[0], 0.0)
    spread = np.sqrt(np.where(sound, values, 1.0))
    k = len(values)

    def projected(y: np.ndarray) -> np.ndarray:
        return (y - mean) @ vectors / spread

    middle = _totals(rows, d, lambda y: projected(y).sum(axis=0)) / n

    def squares(y: np.ndarray) -> np.ndarray:
        white = projected(y) - middle
        return white.T @ white

    apart = (_totals(rows, d, squares).reshape(k, k) / n - np.eye(k))[np.ix_(sound, sound)]
    error = float(np.abs(apart).max(initial=0.0))
    explained = values / trace if trace > 0 else np.zeros(k)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("y"), d)
            if not len(y):
                continue
            apart = n * y.astype(np.float64) - sums
            if float((apart**2).sum(axis=1).max()) > 9.2e18:
                raise OverflowError("a deviation is beyond the range of longs")
            deviation = ((n * y - sums) ** 2).sum(axis=1)
            white = pa.array(projected(y).ravel(), mask=np.tile(~sound, len(y)))
            each = pa.array(np.repeat(np.arange(len(y)), k))
            total = len(y) * k
            columns = [
                batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(np.full(total, n, np.int64)), pa.array(np.repeat(deviation, k)), white,
                pa.array(np.tile(explained, len(y))), pa.array(np.full(total, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(give, schema)
