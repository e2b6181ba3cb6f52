"""Embedding whitening: one-sided Jacobi over the triangle of a blockwise TSQR.

An entry c of a vector becomes the whole number x = floor(64 c) + 1,000,000.  Per-dimension
sums are exact.  Each task centres its rows exactly (n x - S as whole numbers, then over
n) and folds them, block by block, into a triangle R by QR; triangles meet FAN at a
time until one is left, so no task holds more than FAN of them or one block.  R has the
centred rows' singular values and right singular vectors.  Plane rotations then make R's
columns orthogonal; the accumulated rotations are the components, the columns' lengths the
standard deviations times sqrt(n).  No covariance is formed on the way, so small
deviations keep their digits.

Rows whose vector is null, or holds null or non-finite entries, are dropped.  A shorter
vector than the longest counts as if zeros followed; an empty one is all zeros.  Entries
beyond +-2^62 / 64 count as that.  Repeated rows, and rows that repeat a vec_id or
have none, are rows of their own.  A component without variance (deviation under
RANK times the largest: fewer different vectors than dimensions) is listed with a null
``whitened`` and takes no part in ``identity_error``; ``explained`` is null if nothing
varies.  ``deviation`` is null where it exceeds a long.  Other columns are ignored,
whatever their names; an empty table, or one whose vectors are all empty, gives an empty
result.

The driver holds one triangle and the components: dimensions squared, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import save

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**62
#: Matrices that one task merges into one.
FAN = 32
#: Matrix entries of a block; a block has as many rows as columns at least.
BLOCK = 1 << 19
RANK = 1e-12
SWEEPS = 60
_MATRIX = "node long, n long, data array<double>"


@dataclass(frozen=True)
class Whitening:
    """``sums`` of x - OFFSET, exact, by dimension; ``components`` as rows, by falling
    ``variance``; ``total`` is the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variance: np.ndarray
    total: float

    @property
    def explained(self) -> list[float | None]:
        return [float(v / self.total) if self.total > 0 else None for v in self.variance]

    @property
    def varies(self) -> np.ndarray:
        return np.sqrt(self.variance) > RANK * np.sqrt(self.variance.max(initial=0.0))


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, y): the rows that remain, y = x - OFFSET as array<long>."""
    entries = F.col(column).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST)))
    return vectors.where(F.col(column).isNotNull() & fine).select("vec_id", F.transform(entries, scaled).alias("y"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as longs, zeros after the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(column), width).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _largest(y: np.ndarray) -> int:
    return max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))


def sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums by dimension, added up by tasks first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for batch in batches:
            y = _matrix(batch.column("y"))
            safe = _largest(y) * max(len(y), 1) < 2**62
            got = [int(v) for v in (y if safe else y.astype(object)).sum(0)] if len(y) else []
            total += [0] * (len(got) - len(total))
            total = [a + (got[i] if i < len(got) else 0) for i, a in enumerate(total)]
            n += len(y)
        values = pa.array([list(map(str, total))], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), values], ["n", "sums"])

    parts = save(rows.select("y").mapInArrow(partial, "n long, sums array<string>"), "whiten-sums")
    n = parts.agg(F.sum("n")).first()[0] or 0
    by = parts.select(F.posexplode("sums").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    return int(n), tuple(int(r["s"]) for r in by.orderBy("dim").collect())


def scaled_deviations(y: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """n x - S, exact: longs, or Python's whole numbers where those don't hold them."""
    bound = n * _largest(y) + max((abs(int(t)) for t in totals), default=0)
    return n * y - totals.astype(np.int64) if bound < 2**63 else n * y.astype(object) - totals


def squared(d: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; None where a long can't hold it."""
    if d.dtype != object and _largest(d) ** 2 * max(d.shape[1], 1) < 2**63:
        return (d * d).sum(1).tolist()
    whole = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 2**63 else None for v in whole]


def _fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Triangle of r's rows and ``rows``."""
    stacked = rows if r is None else np.vstack([r, rows])
    return np.linalg.qr(stacked, mode="r") if len(stacked) > stacked.shape[1] else stacked


def _merge_triangles(width: int):
    def merge(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        out = None
        for _, flat in parts:
            out = _fold(out, flat.reshape(-1, width))
        return sum(n for n, _ in parts), out

    return merge


def _merge_moments(width: int):
    """Means and centred products of two lots of rows make those of both."""

    def merge(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        n, mean, m = 0, np.zeros(width), np.zeros((width, width))
        for k, flat in parts:
            if k:
                other, apart = flat[:width], flat[:width] - mean
                m += flat[width:].reshape(width, width) + np.outer(apart, apart) * (n * k / (n + k))
                mean = mean + apart * (k / (n + k))
                n += k
        return n, np.concatenate([mean, m.ravel()])

    return merge


def reduced(parts: DataFrame, merge, name: str) -> tuple[int, np.ndarray]:
    """One of the matrices ``parts`` (node, n, data), merged FAN at a time in tasks."""
    parts = save(parts, name)
    count = parts.count()

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        n, data = merge([(int(k), np.asarray(d, float)) for k, d in zip(rows["n"], rows["data"], strict=True)])
        return pd.DataFrame({"node": [int(rows["node"].iloc[0]) // FAN], "n": [n], "data": [data.ravel().tolist()]})

    while count > 1:
        parts = parts.groupBy(F.expr(f"node div {FAN}").alias("group")).applyInPandas(level, _MATRIX)
        parts = save(parts, name)
        count = parts.count()
    row = parts.first()
    return row["n"], np.asarray(row["data"], float)


def triangle(rows: DataFrame, n: int, totals: tuple[int, ...]) -> np.ndarray:
    """R of the centred rows."""
    width, exact = len(totals), np.array(totals, object)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, count, step = None, 0, max(width, BLOCK // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                y = _matrix(batch.column("y").slice(at, step), width)
                r = _fold(r, (scaled_deviations(y, n, exact) / n).astype(float))
                count += len(y)
        if count:
            data = pa.array([r.ravel().tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), data], ["n", "data"])

    return reduced(_numbered(rows.select("y").mapInArrow(partial, "n long, data array<double>")), _merge_triangles(width), "whiten-triangles")[1].reshape(-1, width)


def _numbered(parts: DataFrame) -> DataFrame:
    """One row a task, numbered by the task."""
    return parts.select(F.spark_partition_id().cast("long").alias("node"), "n", "data")


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of d columns once, in rounds of pairs that share none."""
    size = d + d % 2
    ring, out = list(range(size)), []
    for _ in range(size - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: size // 2], ring[: size // 2 - 1 : -1], strict=True)]
        pairs = [p for p in pairs if p[1] < d]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): plane rotations make the columns of r orthogonal; r @
    rotations has orthogonal columns of those lengths, the longest first.  A round's
    rotations touch different columns and are applied together."""
    d = r.shape[1]
    a = np.array(r, float)
    v = np.eye(d)
    scale = np.abs(a).max(initial=0.0)
    if scale == 0 or d == 0:
        return np.zeros(d), v
    a /= scale
    nothing = np.finfo(float).eps ** 2 * (a * a).sum()  # columns this short are zero
    plan = _rounds(d)
    for _ in range(SWEEPS):
        turned = False
        for p, q in plan:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            live = (np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)) & (np.minimum(alpha, beta) > nothing)
            if not live.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[live], q[live], alpha[live], beta[live], gamma[live]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0)) * scale
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def fit(rows: DataFrame, components: int = 32) -> Whitening:
    """Of all ``rows`` (whole_numbers()).  Each component's largest entry is positive."""
    n, totals = sums(rows)
    if not n or not totals:
        return Whitening(n, totals, np.zeros((0, 0)), np.zeros(0), 0.0)
    lengths, rotations = jacobi(triangle(rows, n, totals))
    top = rotations.T[:components]
    signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])
    return Whitening(n, totals, top * signs[:, None], (lengths[:components] ** 2) / n, float((lengths**2).sum() / n))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): an array of a value for each component, null
    for one without variance."""
    n, width, exact = model.n, len(model.sums), np.array(model.sums, object)
    varies = model.varies
    ratio = np.where(varies, 1 / np.sqrt(np.where(varies, model.variance, 1.0)), np.nan)
    turn, step = model.components.T, max(width, BLOCK // max(width, 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                d = scaled_deviations(_matrix(part.column("y"), width), n, exact)
                white = ((d / n).astype(float) @ turn) * ratio
                flat = pa.array(white.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(squared(d), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "whitened"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "y").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of ``white`` minus the identity, over
    the components that vary; None if none does."""
    varies = np.flatnonzero(model.varies)
    width, merge = len(varies), _merge_moments(len(varies))
    if not width:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, state = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("whitened")
            w = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, varies]
            mean = w.mean(0)
            own = (len(w), np.concatenate([mean, ((w - mean).T @ (w - mean)).ravel()]))
            n, state = merge([(n, state), own] if n else [own])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([state.tolist()], pa.list_(pa.float64()))], ["n", "data"])

    n, flat = reduced(_numbered(white.select("whitened").mapInArrow(partial, "n long, data array<double>")), merge, "whiten-moments")
    return float(np.abs(flat[width:].reshape(width, width) / n - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = 32, column: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    rows = whole_numbers(vectors, column)
    model = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(model.variance):
        return vectors.sparkSession.createDataFrame([], schema)
    white = save(transform(rows, model), "whitened")
    error = identity_error(white, model)
    explained = F.array(*(F.lit(e).cast("double") for e in model.explained))
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
