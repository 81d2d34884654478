"""Embedding whitening: distributed centred covariance, leading eigenvectors, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import small_batches
from rowloom.session import stage

#: Steps per unit of an entry.
STEPS = 256
COMPONENTS = 4
#: Eigenvalues closer than this share of the largest are one cluster, whose vectors are kept apart.
CLUSTER = 1e-3
#: An eigenvalue below this share of the trace, times the dimension, counts as 0.
NOTHING = 1e-15
EPS = float(np.finfo(float).eps)

VECTORS = "vec_id long, dims int, x binary"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(x: np.ndarray) -> bytes:
    """The steps of a vector in the fewest of 2, 4 or 8 bytes each that hold them all; equal vectors have equal bytes."""
    most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind[-1].encode() + x.astype(kind).tobytes()


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for kind in {r[:1] for r in rows}:
        at = [i for i, r in enumerate(rows) if r[:1] == kind]
        data = b"".join(rows[i][1:] for i in at)
        out[at] = np.frombuffer(data, f"<i{kind.decode()}").reshape(len(at), dims)
    return out


def stepped(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dims, x: each vector without a null or non-finite entry as whole steps, floor(256 * entry).

    Steps beyond a 64-bit number stay at its bounds.
    """
    small_batches(rows.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            entries = flat.to_numpy(zero_copy_only=False)
            bad = np.r_[0, np.cumsum(~np.isfinite(entries))]
            fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(lists.is_valid())
            with np.errstate(invalid="ignore", over="ignore"):
                steps = np.floor(entries * STEPS)
                x = np.where(steps >= 2.0**63, np.int64(2**63 - 1), np.where(steps < -(2.0**63), np.int64(-(2**63)), steps.astype(np.int64)))
            at = np.flatnonzero(fine)
            own = [packed(x[offsets[i] : offsets[i + 1]]) for i in at]
            dims = (offsets[1:] - offsets[:-1])[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(dims), pa.array(own, pa.binary())], ["vec_id", "dims", "x"])

    return rows.select(F.col(id_column).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(step, VECTORS)


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sum per dimension. One row per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dims)
            n += len(x)
            # Two halves: neither sum can run over.
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(add, "dim long, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect()
    sums = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(dims)]


@dataclass
class Centre:
    """The mean of ``n`` vectors as exact sums, and entries around it."""

    n: int
    sums: list[int] = field(repr=False)

    def small(self, x: np.ndarray) -> bool:
        """Whether n * x - sum and the sum of its squares fit 64 bits."""
        most = max(int(x.max()), -int(x.min())) if x.size else 0
        reach = self.n * most + max(map(abs, self.sums), default=0)
        return len(self.sums) * reach**2 < 1 << 63

    def fits(self, x: np.ndarray) -> bool:
        most = max(int(x.max()), -int(x.min())) if x.size else 0
        return self.n * most + max(map(abs, self.sums), default=0) < 1 << 63

    def away(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean."""
        if self.fits(x):
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return ((self.n * x.astype(object) - np.array(self.sums, object)) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exactly; null where it does not fit a 64-bit number."""
        if self.small(x):
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        wide = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in wide]


def covariance(fit: DataFrame, dims: int, centre: Centre) -> np.ndarray:
    """Covariance of the vectors around the centre, divisor n.

    Each task adds up the products of its own rows and hands on one row per dimension; rows of one dimension are
    added up in one place, so a group has one row per task. dims rows of dims numbers reach the driver.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((dims, dims)), False
        for batch in batches:
            away = centre.away(unpacked(batch.column(0).to_pylist(), dims))
            total += away.T @ away
            some = some or len(away) > 0
        if some:
            part = TaskContext.get().partitionId()
            rows = [row.astype("<f8").tobytes() for row in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, part)), pa.array(rows, pa.binary())], ["dim", "part", "products"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = np.sum([np.frombuffer(p, "<f8") for p in rows["products"]], axis=0)
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "products": [total.astype("<f8").tobytes()]})

    parts = fit.select("x").mapInArrow(multiply, "dim long, part long, products binary")
    summed = parts.groupBy("dim").applyInPandas(add, "dim long, products binary").collect()
    out = np.zeros((dims, dims))
    for row in summed:
        out[row["dim"]] = np.frombuffer(row["products"], "<f8")
    out /= max(1, centre.n)
    return (out + out.T) / 2


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of T and the reflectors (rows) of H1 H2 ..., where the matrix is H1 H2 ... T ... H2 H1 (Householder)."""
    a, n = matrix.astype(float).copy(), len(matrix)
    reflectors = np.zeros((max(0, n - 2), n))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale == 0 or np.abs(v[1:]).max() <= EPS * EPS * scale:
            continue
        v /= scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflectors[k, k + 1 :] = v
        w = reflectors[k]
        p = a @ w
        q = p - (w @ p) * w
        a -= 2 * (np.outer(w, q) + np.outer(q, w))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_count(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x."""
    tiny = np.finfo(float).tiny / EPS
    below, q = np.zeros(len(x), np.int64), np.ones(len(x))
    square = np.r_[0.0, off**2]
    for d, s in zip(diag, square):
        q = d - x - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: each bisected by Sturm counts until the bounds meet."""
    n = len(diag)
    reach = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    spread = max(float(np.abs(diag).max() + reach.max()), np.finfo(float).tiny)
    low, high = np.full(k, float((diag - reach).min()) - EPS * spread), np.full(k, float((diag + reach).max()) + EPS * spread)
    nth = n - 1 - np.arange(k)
    for _ in range(1100):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= EPS * EPS * spread)).all():
            break
        above = sturm_count(diag, off, middle) <= nth
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def solve_tridiagonal(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; a pivot of 0 is taken for a tiny one."""
    n = len(diag)
    least = EPS * max(float(np.abs(diag).max()), float(np.abs(off).max()) if n > 1 else 0.0, 1e-200)
    u, v, w, y = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        below, d, e = float(off[i]), u[i + 1], v[i + 1]
        if abs(below) > abs(u[i]):
            u[i], below = below, u[i]
            v[i], d = d, v[i]
            w[i], e = e, 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(u[i]) < least:
            u[i] = least
        f = below / u[i]
        u[i + 1], v[i + 1], y[i + 1] = d - f * v[i], e - f * w[i], y[i + 1] - f * y[i]
    if abs(u[-1]) < least:
        u[-1] = least
    for i in range(n - 1, -1, -1):
        rest = (v[i] * y[i + 1] if i + 1 < n else 0.0) + (w[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (y[i] - rest) / u[i]
        if abs(y[i]) > 1e250:  # only the direction counts
            y = [t * 1e-200 for t in y]
    return np.array(y)


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration; within a cluster each is kept orthogonal to those before."""
    n, norm = len(diag), float(np.abs(diag).max() + (np.abs(off).max() if len(off) else 0.0))
    rng, out = np.random.default_rng(11), []
    for k, value in enumerate(values):
        cluster = [out[j] for j in range(k) if abs(values[j] - value) <= CLUSTER * max(abs(float(values[0])), np.finfo(float).tiny)]
        y = rng.normal(size=n)
        for _ in range(6):
            for _ in range(2):
                for other in cluster:
                    y -= (other @ y) * other
            if not np.linalg.norm(y):
                y = rng.normal(size=n)
                continue
            y = solve_tridiagonal(diag, off, float(value) + k * EPS * norm, y / np.linalg.norm(y))
        for _ in range(2):
            for other in cluster:
                y -= (other @ y) * other
            y /= np.linalg.norm(y)
        out.append(y)
    return np.array(out).reshape(len(values), n)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    diag, off, reflectors = tridiagonal(matrix)
    values = leading_eigenvalues(diag, off, k)
    vectors = leading_vectors(diag, off, values)
    for w in reflectors[::-1]:
        vectors -= 2 * np.outer(vectors @ w, w)
    for i in range(k):
        for j in range(i):
            vectors[i] -= (vectors[j] @ vectors[i]) * vectors[j]
        vectors[i] /= np.linalg.norm(vectors[i])
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)])
    return values, vectors * signs[:, None]


@dataclass
class Whitening:
    dims: int
    centre: Centre
    values: np.ndarray
    #: Unit eigenvectors as rows.
    vectors: np.ndarray = field(repr=False)
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt of each eigenvalue; NaN where there is no variance."""
        there = self.values > NOTHING * self.dims * self.trace
        return np.where(there, 1 / np.sqrt(np.where(there, self.values, 1.0)), np.nan)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.away(x) @ self.vectors.T * self.scale


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity, over components with variance."""
    there = np.isfinite(model.scale)
    k, dims = int(there.sum()), model.dims
    if not k:
        return 0.0
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = shared.value.apply(unpacked(batch.column(0).to_pylist(), dims))[:, there]
            sums += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.r_[sums, products.ravel()])], ["cell", "value"])

    rows = fit.select("x").mapInArrow(multiply, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = np.array([r["value"] for r in sorted(rows, key=lambda r: r["cell"])]) / model.centre.n
    mean, products = cells[:k], cells[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (see ``stepped``); None without vectors.

    The dimension is the length that most vectors have, of equally many the greater one.
    """
    lengths = vectors.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths or not lengths[0]["dims"]:
        return None
    dims = lengths[0]["dims"]
    fit = stage(vectors.filter(F.col("dims") == dims).select("x").distinct(), "fit")
    centre = Centre(*totals(fit, dims))
    matrix = covariance(fit, dims, centre)
    values, rows = leading_components(matrix, min(components, dims))
    model = Whitening(dims, centre, values, rows, float(np.trace(matrix)))
    model.identity_error = _identity_error(fit, model)
    return model


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per kept row of ``rows`` and leading component.

    Entries become whole steps floor(256 * entry). The covariance is that of the distinct step vectors around their mean, so
    copies, however many, weigh nothing more. whitened is the projection on the component divided by its standard deviation; null where the
    component has no variance. Vectors that are null, hold a null or non-finite entry, or have another length than most are
    left out; an empty table gives no rows; repeated rows and rows without an id are whitened like any other. Other columns are not
    read. deviation is null where it does not fit a 64-bit number. What the driver holds is bounded by the square of the dimension.
    """
    spark = rows.sparkSession
    vectors = stage(stepped(rows, id_column, vector), "steps")
    model = fit_whitening(vectors, components)
    if model is None:
        return spark.createDataFrame([], WHITENED)
    k, dims = len(model.values), model.dims
    shared = spark.sparkContext.broadcast(model)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(1).to_pylist(), dims)
            told, n = shared.value, len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            deviation = pa.array(told.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            whitened = pa.array(told.apply(x).ravel(), from_pandas=True)
            number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))
            constant = lambda v, t: pa.array(np.full(n * k, v), t)
            columns = [ids, number, constant(told.centre.n, pa.int64()), deviation, whitened, pa.array(np.tile(explained, n)), constant(told.identity_error, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WHITENED.split(", ")])

    return vectors.filter(F.col("dims") == dims).select("vec_id", "x").mapInArrow(project, WHITENED)
