"""Whitening of embeddings by principal components.

Entries become whole numbers, x = floor(scale * c), and a vector that occurs several times counts once in the fit. Their number n and
sums S are exact; the covariance V is gathered from x - S / n, centred before multiplying, as one partial matrix a task, added up by
cell. The driver holds V alone, a matrix of the vectors' dimension, and decomposes it: Cholesky with complete pivoting, P'VP = LL',
then one-sided Jacobi rotations of the columns of the triangular factor L until all are orthogonal. The squared norms of its columns
are the eigenvalues, the normalised columns the components (their rows put back in order). The largest pivot comes first, so L is
graded, rotations converge in a few sweeps, and small eigenvalues keep their relative accuracy.

Defined cases: a vector that is null or holds null or non-finite entries is dropped; vectors of another length than the most frequent one
(of equally frequent ones the smallest) are dropped too, and vectors without entries; components with an eigenvalue of zero, as in a
constant table, do not exist, so fewer than ``components`` may be returned; repeated rows are each transformed; an entry
beyond the range of long saturates; a deviation that long cannot hold is null; an empty table gives an empty result; other
columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, remove, stored, workspace
#: Eigenvalues below this part of the trace, times the dimension, are rounding errors of zero.
ZERO = 2.0**-50
#: Columns of the factor are orthogonal at a cosine up to this.
ORTHOGONAL = 2.0**-50


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """``id, x`` of ``id, vector``: the rows that take part, as whole numbers."""
    c = F.col("vector").cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.where(F.col("vector").isNotNull() & ~bad & (F.size("vector") > 0))
    most, least = F.lit(float(2**63 - 1024)), F.lit(float(-(2**63)))
    return kept.select("id", F.transform(c, lambda v: F.floor(F.least(most, F.greatest(least, v * scale)))).alias("x"))


def pages(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers and matrices of the column ``x``, whose lists are equally long."""
    x = batch.column("x")
    m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else ()
    for at in range(0, len(m), 4096):
        yield at, m[at : at + 4096]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the whole part of S / n is taken off exactly."""
    mid = sums // n
    return (x - mid.astype(np.int64)).astype(np.float64) - ((sums - mid * n) / n).astype(np.float64)


def added(partial: DataFrame) -> dict[int, float]:
    """The sums of the partial arrays ``p``, by place."""
    cells = partial.select(F.posexplode("p").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return {r["at"]: r["v"] for r in cells.collect()}  # a row for each cell of a matrix of the dimension


def scatter(fit: DataFrame, dim: int, n: int, sums: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the fit list, or of its projection on the columns of ``by``."""
    width = dim if by is None else by.shape[1]
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            for _, x in pages(batch):
                y = centred(x, n, sums)
                y = y if by is None else y @ by
                total += y.T @ y
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total[upper]], pa.list_(pa.float64()))], ["p"])
        give_back()

    found, out = added(fit.select("x").mapInArrow(run, "p array<double>")), np.zeros((width, width))
    out[upper] = [found[k] for k in range(len(upper[0]))]
    return (out + np.triu(out, 1).T) / n


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the order P of complete pivoting, with P'VP = LL'; L has a column for each pivot that is not zero."""
    a, order = v.copy(), np.arange(len(v))
    floor, columns = np.trace(v) * len(v) * ZERO, []
    lower = np.zeros_like(a)
    for k in range(len(a)):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= floor:
            break
        for m in (a, a.T, lower):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        lower[k, k] = math.sqrt(a[k, k])
        lower[k + 1 :, k] = a[k + 1 :, k] / lower[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k + 1 :, k])
        columns.append(k)
    return lower[:, columns], order


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` after rotations that make all pairs orthogonal; disjoint pairs are rotated together."""
    u = factor if factor.shape[1] % 2 == 0 else np.column_stack((factor, np.zeros(len(factor))))
    n = u.shape[1]
    seats = np.arange(n)
    for _ in range(60):
        worst = 0.0
        for _ in range(n - 1):
            p, q = seats[: n // 2], seats[n // 2 :][::-1]
            a, b, c = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > ORTHOGONAL * size
            worst = max(worst, float(np.max(np.abs(c[turn]) / size[turn], initial=0)))
            zeta = (b - a)[turn] / (2 * c[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            x, y = u[:, p[turn]], u[:, q[turn]]
            u[:, p[turn]], u[:, q[turn]] = cos * x - cos * t * y, cos * t * x + cos * y
            seats = np.concatenate((seats[:1], np.roll(seats[1:], 1)))
        if worst <= ORTHOGONAL * n:
            break
    return u


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are not zero, falling, and unit eigenvectors as columns."""
    factor, order = cholesky(v)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(v), 0))
    u = jacobi(factor.copy())
    norms = np.sqrt((u * u).sum(0))
    first = np.argsort(-norms, kind="stable")
    first = first[norms[first] ** 2 > np.trace(v) * len(v) * ZERO]
    vectors = np.zeros((len(v), len(first)))
    vectors[order] = u[:, first] / norms[first]
    return norms[first] ** 2, vectors


def whiten(rows: DataFrame, id_col="vec_id", vector_col="embedding", scale=256, components=4) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of each row that takes part and component."""
    spark = rows.sparkSession
    folder = workspace(spark, "whitening")
    numbers = whole(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), scale)
    lengths = numbers.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = lengths["d"] if lengths else 0
    numbers = numbers.where(F.size("x") == dim)
    fit = stored(numbers.select("x").distinct(), f"{folder}/fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in pages(batch):
                low, high = x & 0xFFFFFFFF, x >> 32  # no sum of a page leaves the range of long
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([len(x)], low.sum(0), high.sum(0)))], pa.list_(pa.int64()))], ["p"])

    parts = fit.mapInArrow(count, "p array<long>").select(F.transform("p", lambda v: v.cast("decimal(38,0)")).alias("p"))
    found = {k: int(v) for k, v in added(parts).items()}
    n = found.get(0, 0)
    sums = np.array([found[1 + k] + (found[1 + dim + k] << 32) for k in range(dim)] if n else [], dtype=object)
    v = scatter(fit, dim, n, sums) if n else np.zeros((0, 0))
    e, vectors = principal(v)
    e, vectors, trace = e[:components], vectors[:, :components], np.trace(v)
    by = vectors / np.sqrt(e)
    error = float(np.abs(scatter(fit, dim, n, sums, by) - np.eye(len(e))).max()) if len(e) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in pages(batch) if len(e) else ():
                white = centred(x, n, sums) @ by
                apart = deviations(x, n, sums)
                k, m = len(e), len(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array([v for v in apart for _ in range(k)], pa.int64()), pa.array(white.ravel()),
                    pa.array(np.tile(e / trace, m)), pa.array(np.full(m * k, error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    kind = rows.schema[id_col].dataType.simpleString()
    remove(spark, folder)
    return numbers.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum of (n x - S)^2 of each row, exactly; None beyond the range of long."""
    reach = n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(abs(int(s)) for s in sums)
    if reach * reach * x.shape[1] < 2**62:
        d = x * n - sums.astype(np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - sums
    return [v if v < 2**63 else None for v in (d * d).sum(1).tolist()]
