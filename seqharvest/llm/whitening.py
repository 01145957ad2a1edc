"""Embedding whitening: two passes of exact sums and centred products, one eigendecomposition.

Vectors become whole numbers, x = floor(scale * c).  The fit list holds each
distinct x once.  A first pass over it adds the numbers exactly: their sums give the mean.  A second
pass centres the vectors and adds their outer products, a matrix product a batch; both
merge by treeAggregate, whose parts have the size of the sums, never of the data.  The
driver decomposes the symmetric covariance, and a broadcast projection whitens every row.

Defined results: rows go whose vector is null, has another length than ``dimensions`` (the most frequent
length if not given, the larger of equally frequent ones), or holds a null, a non-finite entry or one whose x is no 64-bit number.  Components
whose eigenvalue is zero to double precision aren't returned; so equal vectors, a single
one, or an empty table give no rows.  Repeated rows are returned as often as they occur; their vector is fitted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from ..storage import steps, written
from .common import ship

SCALE, COMPONENTS = 256, 4
#: Rows multiplied at once.
ROWS = 2_048


def whole_numbers(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have a sound vector, and their x, a row each."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    at = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at, pa.int64())).flatten().cast(pa.float64())
    c = flat.to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * c)
        sound = (np.isfinite(x) & (x >= -(2.0**63)) & (x < 2.0**63)).all(1)
    return at[sound], x[sound].astype(np.int64)


def _most(x: np.ndarray) -> int:
    """The largest size of an entry, as a Python number."""
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def added(x: np.ndarray) -> np.ndarray:
    """Exact column sums, as Python numbers."""
    return x.sum(0).astype(object) if _most(x) * max(1, len(x)) < 2**63 else x.astype(object).sum(0)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers if they suffice, else Python numbers."""
    if n * _most(x) + max(map(abs, sums.tolist()), default=0) < 2**63:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squared(d: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the rows."""
    if d.dtype != object and _most(d) ** 2 * d.shape[1] >= 2**63:
        d = d.astype(object)
    return (d * d).sum(1)


@dataclass
class Fit:
    n: int
    sums: np.ndarray  # S, exact
    values: np.ndarray  # eigenvalues, falling, of the components
    axes: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.sums).astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def common_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of a vector; 0 if there is none."""
    sizes = df.select(F.size(vector).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return sizes[0]["d"] if sizes else 0


def fit_list(df: DataFrame, vector: str, dimensions: int, scale: int) -> DataFrame:
    """Each distinct x once, as bytes of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dimensions, scale)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["x"])

    return df.select(vector).mapInArrow(run, "x binary").distinct()


def _matrix(column: pa.Array, dimensions: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(column), ROWS):
        yield np.frombuffer(b"".join(column.slice(lo, ROWS).to_pylist()), "<i8").reshape(-1, dimensions)


def _merged(parts: DataFrame, depth: int = 2) -> tuple[int, np.ndarray | None]:
    """Rows (n, part) of a sum each, merged by treeAggregate."""

    def add(a, b):
        return b if a[1] is None else a if b[1] is None else (a[0] + b[0], a[1] + b[1])

    import pickle

    def read(total, row):
        return add(total, (row["n"], pickle.loads(row["part"])))

    return parts.rdd.treeAggregate((0, None), read, add, depth)


def _sums(fitted: DataFrame, dimensions: int) -> tuple[int, np.ndarray | None]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        n, total = 0, np.zeros(dimensions, object)
        for batch in batches:
            for x in _matrix(batch.column(0), dimensions):
                n, total = n + len(x), total + added(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["n", "part"])

    return _merged(fitted.mapInArrow(run, "n long, part binary"))


def _products(fitted: DataFrame, dimensions: int, rows_of) -> np.ndarray:
    """Sum of the outer products of rows_of(x), for all x of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total, n = None, 0
        for batch in batches:
            for x in _matrix(batch.column(0), dimensions):
                c = rows_of(x)
                total, n = c.T @ c if total is None else total + c.T @ c, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["n", "part"])

    return _merged(fitted.mapInArrow(run, "n long, part binary"))[1]


def fit(df: DataFrame, *, vector: str = "embedding", dimensions: int | None = None, scale: int = SCALE, components: int = COMPONENTS) -> tuple[Fit | None, int]:
    """(the fit, or None if no component has a positive eigenvalue, and the number of dimensions)."""
    dimensions = common_length(df, vector) if dimensions is None else dimensions
    if not dimensions:
        return None, 0
    with steps(df.sparkSession):
        fitted = written(fit_list(df, vector, dimensions, scale), "fit-list")
        n, sums = _sums(fitted, dimensions)
        if not n:
            return None, dimensions
        v = _products(fitted, dimensions, lambda x: centred(x, n, sums).astype(np.float64) / n) / n
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        real = values > values[0] * dimensions * np.finfo(np.float64).eps if values[0] > 0 else np.zeros(len(values), bool)
        if not real.any():
            return None, dimensions
        found = Fit(n, sums, values[real], np.ascontiguousarray(axes[:, real]), float(np.trace(v)), 0.0)
        project = _projection(df, found)
        white = _products(fitted, dimensions, project) / n
        found.identity_error = float(np.abs(white - np.eye(len(white))).max())
        return found, dimensions


def _projection(df: DataFrame, found: Fit):
    """found.project with its arrays broadcast; their size is that of a few vectors."""
    sent = df.sparkSession.sparkContext.broadcast((found.n, found.sums, found.values, found.axes))

    def project(x: np.ndarray) -> np.ndarray:
        n, sums, values, axes = sent.value
        return (centred(x, n, sums).astype(np.float64) / n) @ axes / np.sqrt(values)

    return project


def whiten(df: DataFrame, *, keep: list[str], vector: str = "embedding", dimensions: int | None = None, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """The ``keep`` columns of every sound row with component (from 1), n, deviation (decimal: the exact sum of (n * x - S)^2), whitened, explained, identity_error."""
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    if clash := {k.lower() for k in keep} & {*names}:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    kinds = (IntegerType(), LongType(), DecimalType(38, 0), DoubleType(), DoubleType(), DoubleType())
    schema = StructType([*(df.schema[k] for k in keep), *(StructField(n, t) for n, t in zip(names, kinds, strict=True))])
    found, dimensions = fit(df, vector=vector, dimensions=dimensions, scale=scale, components=components)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    project, n, sums, error = _projection(df, found), found.n, found.sums, found.identity_error
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            rows, x = whole_numbers(batch.column(batch.num_columns - 1), dimensions, scale)
            for lo in range(0, len(rows), ROWS):
                part = x[lo : lo + ROWS]
                y, d = project(part), squared(centred(part, n, sums))
                k, m = y.shape[1], len(part)
                deviation = pa.array([Decimal(int(v)) for v in d], pa.decimal128(38, 0))
                at = pa.array(np.repeat(rows[lo : lo + ROWS], k), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(at) for i in range(batch.num_columns - 1)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        deviation.take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(y.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[*keep, *names],
                )

    return df.select(*keep, F.col(vector).alias("sound_vector")).mapInArrow(run, schema)


ship(__name__)
