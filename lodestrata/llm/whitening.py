"""Embedding whitening by LOBPCG: locally optimal block preconditioned conjugate gradients, over products with the covariance that Spark computes.

The largest eigenpairs of a covariance are sought in the space of three blocks: the iterates, their
residuals, and the directions of the last step. Each turn is one job over the fit list: rows are
centred, and the products of their covariance with an orthonormal basis of the three blocks are
summed up by task, then by group of tasks. The driver solves the small problem in that basis
(Rayleigh-Ritz) and goes on until the residuals of all wanted pairs are certified small. It holds
matrices of the vectors' length by three blocks, never vectors of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise

#: Entries become whole numbers: floor(SCALE * c) + SHIFT. SCALE * c is cut off at plus and minus BOUND.
SCALE, SHIFT, BOUND = 64, 1_000_000, float(1 << 40)
#: Iterates beyond the wanted ones, turns after which their number is doubled, and the largest residual, in shares of the largest eigenvalue, that is good enough.
GUARD, PATIENCE, CERTIFIED = 8, 40, 1e-12
#: A residual that this falls under is not improved any more.
EXACT = 4e-15
#: Eigenvalues under this share of the largest are taken for zero.
ZERO = 1e-13
#: Sums of tasks are added up in so many groups of tasks before they go to the driver.
GROUPS = 32


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of `of`, an array of the numpy type kind, over the matrices x of fit's batches."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), d))
                sums = part if sums is None else sums + part
        if sums is not None:
            at = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.astype(kind).tobytes()], pa.binary())], ["at", "raw"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for raw in batch.column(1):
                part = np.frombuffer(raw.as_buffer(), kind)
                sums = part.copy() if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["raw"])

    parts = fit.select("x").mapInArrow(add, "at int, raw binary").repartition(GROUPS, "at").mapInArrow(together, "raw binary")
    return np.sum([np.frombuffer(r.raw, kind) for r in parts.collect()], axis=0)


@dataclass
class Fit:
    """n vectors with whole sums S = n * base + rest; eigenvalues and unit eigenvectors (in columns), the largest first; the trace; the worst entry of the whitened covariance less the identity."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float = 0.0
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: whole numbers first, so that nothing cancels."""
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over each row of (n * x - S)^2, exact; None where it is no long."""
        # modulo 2^64, which is right for what fits, as the estimate tells
        t = np.int64(self.n) * (x - self.base) - self.rest
        sums, about = (t * t).sum(1).tolist(), ((self.n * self.centred(x)) ** 2).sum(1)
        for i in np.flatnonzero(about > 2.0**62).tolist():
            exact = sum((self.n * (a - b) - c) ** 2 for a, b, c in zip(x[i].tolist(), self.base.tolist(), self.rest.tolist(), strict=True))
            sums[i] = exact if exact < 1 << 63 else None
        return sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The rows of x on the components whose eigenvalue is not zero, with variance 1 each."""
        some = self.nonzero()
        return self.centred(x) @ (self.vectors[:, some] / np.sqrt(self.values[some]))

    def nonzero(self) -> np.ndarray:
        return self.values > max(self.values.max(initial=0.0) * ZERO, 0.0)


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a symmetric matrix without negative ones, their unit eigenvectors, and the largest residual's norm.

    product(Q) gives the matrix times Q, for d by m orthonormal Q.
    """
    rng = np.random.default_rng(12)
    m = min(d, k + GUARD)
    basis = np.linalg.qr(rng.normal(size=(d, m)))[0]
    best, turn = np.inf, 0
    while True:
        turn += 1
        image = product(basis)
        small = basis.T @ image
        values, w = np.linalg.eigh((small + small.T) / 2)
        values, w = values[::-1][:m], w[:, ::-1][:, :m]
        x = basis @ w
        residuals = image @ w - x * values
        norms = np.sqrt((residuals * residuals).sum(0))
        error, scale = norms[:k].max(initial=0.0), max(abs(values).max(initial=0.0), np.finfo(float).tiny)
        good = error <= CERTIFIED * scale
        if error <= EXACT * scale or good and error > best / 2:
            return np.maximum(values[:k], 0.0), x[:, :k], float(error)
        best = min(best, error)
        if turn % PATIENCE == 0 and m < d:  # close eigenvalues beyond the block: a larger one tells them apart
            m = min(d, 2 * m)
            basis, best = _orthonormal(x, rng.normal(size=(d, m - x.shape[1]))), np.inf
            continue
        # what was added to the last iterates, which are the basis' first columns
        last = basis[:, m:] @ w[m:, :] if basis.shape[1] > m else np.zeros((d, 0))
        basis = _orthonormal(x, np.hstack([residuals[:, norms > 0], last]))


def _orthonormal(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The orthonormal x, and an orthonormal basis of what more adds to its space, behind it."""
    for _ in range(2):
        more = more - x @ (x.T @ more)
        sizes = np.sqrt((more * more).sum(0))
        more = more[:, sizes > 0] / sizes[sizes > 0]
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    u = u[:, s > 1e-8][:, : x.shape[0] - x.shape[1]]
    return np.linalg.qr(np.hstack([x, u]))[0] if u.shape[1] else x


def fit(vectors: DataFrame, d: int, components: int = 16) -> Fit:
    """The largest eigenpairs of the covariance (divisor n) of vectors' column x, arrays of d longs, each row counted once."""
    n = vectors.count()
    # halves, whose sums do not leave the long
    halves = _total(vectors, d, lambda x: np.concatenate([(x >> 20).sum(0), (x & 0xFFFFF).sum(0)]), "<i8")
    sums = [(int(a) << 20) + int(b) for a, b in zip(halves[:d], halves[d:], strict=True)]
    base, rest = (np.array(c, np.int64) for c in zip(*(divmod(s, n) for s in sums), strict=True))
    k = min(d, components)
    out = Fit(n, base, rest, np.zeros(k), np.eye(d)[:, :k])

    def product(basis: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = out.centred(x)
            return np.append((c.T @ (c @ basis)).ravel(), (c * c).sum())

        sums = _total(vectors, d, part, "<f8") / n
        out.trace = float(sums[-1])
        return sums[:-1].reshape(d, -1)

    out.values, out.vectors, _ = largest_pairs(product, d, k)

    def spread(x: np.ndarray) -> np.ndarray:
        y = out.whitened(x)  # centred already, as centring comes before the projection
        return (y.T @ y).ravel()

    some = int(out.nonzero().sum())
    if some:
        out.error = float(np.abs(_total(vectors, d, spread, "<f8").reshape(some, some) / n - np.eye(some)).max())
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row and component, from 1 by falling eigenvalue.

    Rows whose vector is null or empty or holds null or non-finite entries are dropped. Entries
    become x = floor(64 * c) + 1,000,000, with 64 * c cut off at plus and minus 2^40; the fit list
    is each distinct x once, n of them with sums S. deviation is the sum of (n * x - S)^2, null
    where that is no long. whitened is x - S / n on a unit eigenvector of the fit list's covariance
    (divisor n) over the root of its eigenvalue, explained the eigenvalue's share of the trace, and
    identity_error the largest entry of whitened's covariance less the identity, over the fit list.
    An eigenvalue of zero, as where there are fewer distinct vectors than components, has a null
    whitened value and explains 0. Vectors of another length are whitened among themselves, and
    those shorter than components have as many as entries. Equal rows, and rows that repeat an id
    or have none, are returned each; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = lambda c: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c * SCALE))).cast("long") + SHIFT
    rows = rows.where((F.size("vec") > 0) & F.forall("vec", finite)).select("id", F.transform("vec", whole).alias("x"))
    distinct = materialise(rows.select("x").distinct(), "fit")
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], schema)
    for (d,) in sorted(tuple(r) for r in distinct.select(F.size("x")).distinct().collect()):
        model = fit(distinct.where(F.size("x") == d), d, components)
        out = out.unionByName(rows.where(F.size("x") == d).mapInArrow(_projected(model, d), schema))
    return out.withColumnRenamed("id", id_col)


def _projected(model: Fit, d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.values)
    some = model.nonzero()
    explained = np.where(some, model.values, 0.0) / (model.trace or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), d)
            values = np.full((len(x), k), np.nan)
            values[:, some] = model.whitened(x)
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), model.n, np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(rows)),
                pa.array(values.ravel(), mask=np.tile(~some, len(x))),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows), model.error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
