"""Whitening of vectors: leading eigenvectors by Chebyshev-filtered subspace iteration (Zhou and Saad, 2007).

The covariance is met only as a product with a few columns, one distributed pass over the centred rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow, materialize, table

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this are taken as this, so that sums of products stay within what is exact.
LARGEST = 1 << 52
#: Components; columns carried besides them, at least, which widen the gap that the filter works on.
COMPONENTS, GUARD = 8, 24
#: Passes that look for the lower end of the spectrum; degree of a filter at most; rounds at most.
LANCZOS, DEGREE, ROUNDS = 8, 24, 60
#: The largest growth of a column against another in one filter, so that none drowns in another's rounding.
GROWTH = 1e10
#: A component is certified when its error is bounded by CERTIFIED, or its residual is at rounding level.
CERTIFIED, FLOOR = 1e-11, 2e-15
#: Variances under this share of the trace count as none: such a direction can't be scaled to one.
NO_VARIANCE = 1e-13
SEED = 3

Product = Callable[[np.ndarray], np.ndarray]


def chebyshev(product: Product, q: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V, small on [low, high], times each column of q: `degree` products."""
    middle, half = (low + high) / 2, (high - low) / 2
    before, now = q, (product(q) - middle * q) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (product(now) - middle * now) / half - before
    return now


def lower_end(product: Product, d: int) -> float:
    """About the smallest eigenvalue: a few Lanczos steps with full orthogonalisation, less the last residual."""
    q = np.random.default_rng(SEED).standard_normal(d)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS, d)):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, values[0] - beta[-1] * abs(vectors[-1, 0]))


def leading(product: Product, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (columns) of the d x d matrix behind `product`.

    Rounds of filter, QR and Rayleigh-Ritz go on until each component is certified: the Ritz residual over the gap
    to the next value bounds its angle (Davis and Kahan), or the residual is all rounding, as it is for equal values.
    """
    width = min(d, max(k + GUARD, 2 * k))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    low, last = (0.0 if width == d else lower_end(product, d)), np.inf
    for n in range(ROUNDS):
        vq = product(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq - q * values, axis=0)
        top = max(values[0], 0.0)
        near = np.abs(values[:, None] - values[None, :k]) + np.where(np.eye(width, k, dtype=bool), np.inf, 0)
        fine = (residual[:k] <= CERTIFIED * near.min(axis=0)) | (residual[:k] <= FLOOR * d**0.5 * top)
        worst = residual[:k].max()
        if width == d or fine.all() or (n > 2 and worst <= 1e-11 * top and worst > 0.5 * last):  # no product is better than its rounding
            return values[:k], q[:, :k]
        last = worst
        high = values[-1]
        below = min(low, high * (1 - 1e-3))
        x = (2 * top - high - below) / max(high - below, 1e-300)
        reach = np.arccosh(max(x, 1 + 1e-9))
        degree = int(np.clip(np.log(2 * GROWTH) / reach, 2, DEGREE)) if n else 6
        q = chebyshev(product, q, below, high, degree)
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
    raise ArithmeticError(f"no certificate after {ROUNDS} rounds: residuals {residual[:k]} of values {values[:k]}")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _tallied(sums: DataFrame, columns: int) -> np.ndarray:
    """Rows (j, c0, c1, ...), some from each task, summed by j and gathered: as many rows as there are dimensions."""
    rows = sums.groupBy("j").agg(*[F.sum(f"c{n}") for n in range(columns)]).collect()
    out = np.zeros((len(rows), columns))
    for j, *values in rows:
        out[j] = values
    return out


def _sums(of: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(of)), pa.int32()), *[pa.array(np.ascontiguousarray(c), pa.float64()) for c in of.T]], ["j", *[f"c{n}" for n in range(of.shape[1])]])


def _schema(columns: int) -> str:
    return "j int, " + ", ".join(f"c{n} double" for n in range(columns))


def _whitened(rows: DataFrame, width: int, n: int, total: list[int], k: int) -> DataFrame:
    """rows (vec_id, x: int64 as bytes) of one width, with their number and sums by dimension."""
    sums = np.array(total, object)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if n * int(np.abs(x).max(initial=0)) < 1 << 62 and np.abs(sums).max() < 1 << 62:
            return n * x - sums.astype(np.int64)
        return n * x.astype(object) - sums

    def centred(x: np.ndarray) -> np.ndarray:
        return deviations(x).astype(np.float64) / n

    def pass_over(columns: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of each(centred rows), a matrix of `columns` columns, divided by their number."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                if b.num_rows:
                    part = each(centred(_matrix(b.column(0), width)))
                    held = part if held is None else held + part
            if held is not None:
                yield _sums(held)

        return _tallied(rows.select("x").mapInArrow(run, _schema(columns)), columns) / n

    def product(q: np.ndarray) -> np.ndarray:
        return pass_over(q.shape[1], lambda x: x.T @ (x @ q))

    trace = float(pass_over(1, lambda x: (x * x).sum(axis=0)[:, None]).sum())
    values, vectors = leading(product, width, min(k, width)) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    some = values > NO_VARIANCE * trace
    values, scaled = values[some], vectors[:, some] / np.sqrt(values[some])
    m = len(values)
    if not m:
        return None
    moments = pass_over(m + 1, lambda x: (w := x @ scaled).T @ np.column_stack([w, np.ones(len(w))]))
    mean = moments[:, m]
    error = float(np.abs(moments[:, :m] - np.outer(mean, mean) - np.eye(m)).max())
    explained = (values / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), width)
                off = deviations(x)
                white = (off.astype(np.float64) / n) @ scaled
                whole = int(np.abs(off).max()) ** 2 * width < 1 << 62
                squares = ((off * off) if whole else (off.astype(object) ** 2)).sum(axis=1).tolist()
                squares = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
                rows_, size = b.num_rows, b.num_rows * m
                at = pa.array(np.repeat(np.arange(rows_), m))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1), rows_), pa.int32()), pa.array(np.full(size, n), pa.int64()), squares.take(at), pa.array(white.ravel(), pa.float64()), pa.array(np.tile(explained, rows_), pa.float64()), pa.array(np.full(size, error), pa.float64())], RESULT)

    return map_arrow(rows.select("vec_id", "x"), project, SCHEMA)


RESULT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's coordinates along the k leading components of all, scaled to variance one.

    Returns a row for each vector and component: vec_id, component (from 1), n (vectors), deviation (sum over
    dimensions of (n x - S) squared, null where it exceeds a long), whitened, explained (share of the trace) and
    identity_error (largest entry of the whitened vectors' covariance less the identity). A vector that is null or
    empty, or has a null or non-finite entry, takes no part; entries beyond 2 ** 52 once scaled count as that. Rows
    with a null id and repeated rows take part like others. Vectors of each length are a table of their own, with
    components of their own. Directions without variance give no rows, so a single vector gives none, nor does an
    empty table. Other columns are neither read nor returned.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    rows = df.filter(v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(1)
                sizes = lists.value_lengths().to_numpy()
                x = np.clip(np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST).astype(np.int64) + SHIFT
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array([x[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.binary())], ["vec_id", "w", "x"])

    held = materialize(map_arrow(rows, scaled, "vec_id long, w int, x binary"), "whitening")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and exact sums of each length and dimension within a task."""
        found: dict[int, list] = {}
        for b in batches:
            for width in np.unique(widths := b.column(0).to_numpy()).tolist():
                x = _matrix(b.column(1).filter(pa.array(widths == width)), width)
                got = found.setdefault(width, [0, np.zeros(width, object)])
                got[0] += len(x)
                got[1] = got[1] + (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0)
        out = [(w, j, n, str(s)) for w, (n, sums) in found.items() for j, s in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["w", "j", "n", "s"])

    tallies = map_arrow(held.select("w", "x"), totals, "w int, j int, n long, s string").groupBy("w", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_width: dict[int, dict[int, tuple[int, int]]] = {}
    for r in tallies.collect():  # a row for each dimension
        by_width.setdefault(r["w"], {})[r["j"]] = (r["n"], int(r["s"]))
    parts = []
    for width, found in sorted(by_width.items()):
        part = _whitened(held.filter(F.col("w") == width), width, found[0][0], [found[j][1] for j in range(width)], k)
        if part is not None:
            parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
