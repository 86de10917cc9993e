"""Whitening of vectors by Chebyshev-filtered subspace iteration over distributed passes of the centred covariance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memspark.llm.rows import written

#: Directions that are iterated for each wanted component: the more, the fewer passes.
BLOCK = 4
#: Products with the covariance in one filter; the filter is applied until the components are certified.
DEGREE = 8
#: A component is certified if its direction is off by no more than this (its residual over its distance to the next
#: eigenvalue), or if its residual is down to rounding: this share of the largest eigenvalue, for each root of a dimension.
ANGLE, ROUNDING = 1e-11, 4e-15
#: Filters after which an uncertified result is an error. One filter damps all but close eigenvalues by orders of magnitude.
FILTERS = 400
#: Components below this share of the largest are rounding, not spread.
SPREAD = 1e-12
#: Scaled components are cut to this size: an integer of 64 bits holds them.
LARGEST = float(1 << 62)


def usable(vectors: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(__key, x): integer vectors floor(``scale`` * c) + ``shift`` of rows with a vector of finite components."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(key).alias("__key"), c.alias("c")).filter(F.size("c") > 0).filter(F.coalesce(finite, F.lit(False)))
    bounded = lambda v: F.greatest(F.least(v * float(scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.select("__key", F.transform("c", lambda v: F.floor(bounded(v)).cast("long") + F.lit(shift).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


class Table:
    """Integer vectors of one length in the shared folder, with what their covariance needs: n, sums, passes over them."""

    def __init__(self, rows: DataFrame, dims: int):
        self.dims, self.schema = dims, rows.schema["__key"].dataType

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, most, total = 0, 0, [0] * dims
            for batch in batches:
                x = _matrix(batch.column(0), dims)
                if not len(x):
                    continue
                n += len(x)
                here = max(abs(int(x.max())), abs(int(x.min())))
                most = max(most, here)
                own = x.sum(axis=0) if here * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, own, strict=True)]
            if n:
                columns = [pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * dims, pa.int64()), pa.array([most] * dims, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "total", "n", "most"])

        parts = rows.select("x").mapInArrow(add, "i int, total decimal(38,0), n long, most long")
        # One row for each dimension.
        sums = parts.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("i").collect()
        self.n = int(sums[0]["n"])
        self.sums = [int(r["total"]) for r in sums]
        narrow = max(r["most"] for r in sums) < 1 << 31
        self.kind = np.dtype("<i4" if narrow else "<i8")
        kind = self.kind

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.ascontiguousarray(_matrix(batch.column(1), dims).astype(kind))
                at = np.arange(len(x) + 1, dtype=np.int64) * (dims * kind.itemsize)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary())], names=["__key", "x"])

        schema = T.StructType([T.StructField("__key", self.schema), T.StructField("x", T.BinaryType())])
        self.rows = written(rows.select("__key", "x").mapInArrow(pack, schema), "whitening")

    def unpack(self, column: pa.Array) -> np.ndarray:
        column = column.cast(pa.large_binary())
        raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) else np.zeros(0, dtype=np.uint8)
        width = self.dims * self.kind.itemsize
        first = int(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset]) if len(column) else 0
        return raw[first : first + len(column) * width].view(self.kind).reshape(len(column), self.dims)

    def scaled(self, column: pa.Array) -> np.ndarray:
        """n * x - S for each row: exact; 64-bit integers, or Python's where those could overflow."""
        x = self.unpack(column)
        most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        if self.n * most + max(abs(s) for s in self.sums) < 1 << 62:
            return x.astype(np.int64) * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, column: pa.Array) -> np.ndarray:
        """x - S / n, rounded once."""
        return self.scaled(column).astype(np.float64) / self.n

    def summed(self, part, height: int, width: int) -> np.ndarray:
        """The sum of ``part(centred rows)``, a matrix of ``height`` by ``width``, over all rows, divided by n.

        Each task adds up its own; Spark adds the tasks' matrices by row, first in each executor.
        """
        table = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    own = part(table.centred(batch.column(0)))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], names=["i", *(f"y{j}" for j in range(width))])

        kind = ", ".join(f"y{j} double" for j in range(width))
        parts = table_rows(self.rows).mapInArrow(run, f"i int, {kind}")
        made = np.zeros((height, width))
        for r in parts.groupBy("i").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).collect():  # one row for each of ``height``
            made[r["i"]] = r[1:]
        return made / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times ``q``: one pass that adds up X'(XQ)."""
        return self.summed(lambda x: x.T @ (x @ q), *q.shape)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


def table_rows(rows: DataFrame) -> DataFrame:
    return rows.select("x")


def principal(times, dims: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Eigenvalues, unit eigenvectors as columns, residuals) of the ``k`` largest of a covariance known by ``times``.

    A block of random directions goes through a Chebyshev polynomial that stays small on [0, a], a being the block's
    smallest Ritz value, and grows beyond: what isn't wanted is damped. QR and Rayleigh-Ritz follow. The product that
    Rayleigh-Ritz needs is the next filter's first. It ends when all wanted pairs are certified by their residuals.
    """
    k = min(k, dims)
    width = min(dims, BLOCK * k)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    last = np.inf
    for _ in range(FILTERS):
        vq = times(q)
        h = q.T @ vq
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residual = np.linalg.norm(vq - q * theta, axis=0)
        top = theta[0]
        if top <= 0:
            break
        gaps = np.abs(theta[:, None] - theta[None, :]) + np.where(np.eye(width, dtype=bool), np.inf, 0.0)
        gap = np.minimum(gaps.min(axis=1) if width > 1 else top, theta)
        floor = ROUNDING * np.sqrt(dims) * top
        sure = residual[:k] <= np.maximum(ANGLE * gap[:k], floor)
        worst = float(residual[:k].max())
        if width == dims or sure.all() or (worst <= 1e4 * floor and worst > last / 2):  # the last: no longer falls, down to rounding
            break
        last = worst
        q = _filtered(times, q, vq, max(float(theta[-1]), 1e-9 * top), top)
    else:
        raise RuntimeError(f"not certified after {FILTERS} filters: residuals {residual[:k]}")
    return theta[:k], q[:, :k], residual[:k]


def _filtered(times, q: np.ndarray, vq: np.ndarray, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of ``DEGREE`` for [0, ``cut``], scaled to 1 at ``top``, applied to ``q``; orthonormal."""
    centre = radius = cut / 2
    sigma = first = radius / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / radius)
    for _ in range(DEGREE - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * new / radius) - (sigma * new) * before
        sigma = new
    return np.linalg.qr(now)[0]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Per row and component up to ``k``: ``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    Components become integers x = floor(``scale`` * c) + ``shift``. Components are the unit eigenvectors of the covariance
    of all rows (divisor n, centred first), by falling eigenvalue; each one's largest entry is positive. deviation is the
    sum of (n * x - S)^2, exact, a decimal of 38 digits (null beyond); whitened the row's projection over the root of the
    eigenvalue, explained the eigenvalue's share, identity_error how far the covariance of all whitened rows is from the
    identity.

    Vectors go once, as bytes, to the shared folder; each pass reads them there and shuffles one small matrix a task. The
    driver holds matrices of (dimensions) x (4 ``k``) numbers and no vector.

    Rows whose vector is null or empty or holds a null or non-finite component take no part, nor do vectors of another
    length than the most frequent one (of equally frequent ones the longest). Components of a size over 2^62 / ``scale``
    are cut to it. Directions without spread are no components: one row, or equal rows only, or an empty table, give an
    empty table. Null keys and repeated rows are rows like any other; other columns are not looked at.
    """
    rows = usable(vectors, key, vector, scale, shift)
    lengths = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).head(1)
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    empty = vectors.sparkSession.createDataFrame([], schema)
    if not lengths:
        return empty
    dims = int(lengths[0]["dims"])
    table = Table(rows.filter(F.size("x") == dims), dims)
    values, axes, _ = principal(table.times, dims, k)
    real = values > SPREAD * values[0] if values[0] > 0 else np.zeros(len(values), dtype=bool)
    if not real.any():
        return empty
    values, axes = values[real], axes[:, real]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(len(values))] < 0, -1.0, 1.0)
    trace = float(table.summed(lambda x: (x * x).sum(axis=0)[:, None], dims, 1).sum())
    project = axes / np.sqrt(values)
    m = len(values)
    mean = table.summed(lambda x: (x @ project).sum(axis=0)[:, None], m, 1)[:, 0]

    def outer(x: np.ndarray) -> np.ndarray:
        z = x @ project - mean
        return z.T @ z

    error = float(np.abs(table.summed(outer, m, m) - np.eye(m)).max())
    explained = values / trace
    n, types = table.n, [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            scaled = table.scaled(batch.column(1))
            z = (scaled.astype(np.float64) / n) @ project
            rows_of = np.repeat(np.arange(size), m)
            columns = [
                batch.column(0).take(pa.array(rows_of)),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)),
                pa.array(np.full(size * m, n, dtype=np.int64)),
                _squares(scaled).take(pa.array(rows_of)),
                pa.array(z.reshape(-1)),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * m, error)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return table.rows.select("__key", "x").mapInArrow(run, schema)


def _squares(scaled: np.ndarray) -> pa.Array:
    """The sum of squares of each row as a decimal of 38 digits, null where it has more."""
    most = float(np.abs(scaled.astype(np.float64)).max(initial=0))
    if scaled.dtype != object and most * most * scaled.shape[1] < 2.0**62:
        return pa.array((scaled * scaled).sum(axis=1)).cast(pa.decimal128(38, 0))
    whole = [sum(int(v) ** 2 for v in row) for row in scaled]
    return pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0))
