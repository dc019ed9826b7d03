"""Whitening of embeddings: Welford updates in tasks, merged partials, and a symmetric QR eigen-solve.

Every task takes its vectors one by one into a count, a mean and a matrix of
squared deviations (a rank-one update each). Partials of two tasks are merged
by the parallel update formula, in a tree of tasks, and the driver gets one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, read_table

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Partials merged by one task.
FAN_IN = 32
#: Beyond this an entry's long is no longer exact as a double.
_MOST = float(1 << 52) / SCALE
_PARTIAL = "part long, n long, total array<long>, mean array<double>, spread array<double>"


def quantized(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is usable, entries as longs.

    Left out are vectors that are null or empty, hold null or non-finite
    entries or such of over 2**52 / 64, and those of another length than most
    vectors have (of equally frequent lengths the greatest counts).
    """
    entry = lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long")
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= _MOST)
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter("v is not null and size(v) > 0").filter(F.forall("v", sound))
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return kept.filter(F.size("v") == (lengths["d"] if lengths else 0)).select("vec_id", F.transform("v", entry).alias("x"))


class Moments:
    """Count, exact sums, mean and squared deviations of vectors."""

    def __init__(self, d: int):
        self.n, self.total = 0, np.zeros(d, np.int64)
        self.mean, self.spread = np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one vector: a rank-one term of its distances to the old and to the new mean."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        # (x - old mean) and (x - new mean) are in proportion, so the term is symmetric
        self.spread += np.multiply.outer(before, before * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> None:
        """The parallel update formula for two disjoint sets of vectors."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.spread += other.spread + np.multiply.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.total += other.total
        self.n = n

    def row(self, part: int) -> pa.RecordBatch:
        cells = [[part], [self.n], [self.total], [self.mean], [self.spread.reshape(-1)]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "n", "total", "mean", "spread"])

    @staticmethod
    def of(n: int, total: list[int], mean: list[float], spread: list[float]) -> Moments:
        out = Moments(len(mean))
        out.n, out.total, out.mean = n, np.array(total, np.int64), np.array(mean)
        out.spread = np.array(spread).reshape(len(mean), -1)
        return out


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def moments(vectors: DataFrame, column: str = "x", fan_in: int = FAN_IN) -> Moments | None:
    """The moments of all rows of ``vectors``, of equal lengths; None if there are none.

    A task streams its rows and gives one partial. Partials are merged by
    ``fan_in`` in tasks until so few are left, whatever the number of tasks.
    Means of longs are kept as distances from OFFSET, so that they lose no digits.
    """
    whole = dict(vectors.dtypes)[column] == "array<bigint>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), np.int64 if whole else np.float64)
            held = held or Moments(x.shape[1])
            if whole:
                held.total += x.sum(0)
            for row in (x - (OFFSET if whole else 0)).astype(np.float64):
                held.add(row)
        if held:
            yield held.row(0)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for b in batches:
            for r in b.to_pylist():
                one = Moments.of(r["n"], r["total"], r["mean"], r["spread"])
                if r["part"] in held:
                    held[r["part"]].merge(one)
                else:
                    held[r["part"]] = one
        for part, one in held.items():
            yield one.row(part)

    schema = _PARTIAL
    parts = vectors.select(column).mapInArrow(partial, schema)
    count = vectors.rdd.getNumPartitions()
    parts = parts.withColumn("part", F.spark_partition_id().cast("long"))
    while count > fan_in:
        count = -(-count // fan_in)
        parts = materialize(parts.withColumn("part", F.pmod("part", F.lit(count))).repartition(count, "part").sortWithinPartitions("part", "n", "mean").mapInArrow(merged, schema), "moments")
    rows = sorted(parts.collect(), key=lambda r: (r["part"], r["n"], r["mean"]))  # at most fan_in, or one for each part
    if not rows:
        return None
    out, *rest = [Moments.of(r["n"], r["total"], r["mean"], r["spread"]) for r in rows]
    for one in rest:
        out.merge(one)
    return out


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns, by tridiagonal form and shifted QR.

    Householder reflections make the matrix tridiagonal; QR steps with
    Wilkinson's shift, as Givens rotations which chase the bulge, then make its
    off-diagonal vanish, from the last row on. All of it in doubles.
    """
    t, n = np.array(a, np.float64), len(a)
    v = np.eye(n)
    for k in range(n - 2):
        x = t[k + 1 :, k].copy()
        norm = np.sqrt(x @ x)
        if not norm or not np.abs(x[1:]).any():
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.sqrt(x @ x)
        t[k + 1 :, :] -= 2 * np.multiply.outer(x, x @ t[k + 1 :, :])
        t[:, k + 1 :] -= 2 * np.multiply.outer(t[:, k + 1 :] @ x, x)
        v[:, k + 1 :] -= 2 * np.multiply.outer(v[:, k + 1 :] @ x, x)
    d, e = np.diag(t).copy(), np.append(np.diag(t, -1), 0.0).copy()
    tiny = np.finfo(float).eps
    high = n - 1
    steps = 0
    while high > 0:
        for k in range(high):
            if abs(e[k]) <= tiny * (abs(d[k]) + abs(d[k + 1])):
                e[k] = 0.0
        if not e[high - 1]:
            high -= 1
            steps = 0
            continue
        low = high - 1
        while low > 0 and e[low - 1]:
            low -= 1
        steps += 1
        if steps > sweeps:
            raise ArithmeticError("eigenvalues have not settled")
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half or 1.0))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, q, o = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * q, s * s * p - 2 * c * s * o + c * c * q
            e[k] = c * s * (q - p) + (c * c - s * s) * o
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            v[:, k], v[:, k + 1] = c * v[:, k] + s * v[:, k + 1], c * v[:, k + 1] - s * v[:, k]
    order = np.argsort(-d, kind="stable")
    return d[order], v[:, order]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector: vec_id, component, n, deviation, whitened, explained, identity_error.

    The covariance is that of the distinct vectors of :func:`quantized`. Of
    ``components``, those are given whose eigenvalue is above the rounding of
    the greatest; a table whose distinct vectors span less, or fewer than two of
    them, gives fewer rows or none. ``deviation`` is exact; one beyond a long is
    null. Repeated rows and null ids are rows like others, extra columns are
    ignored, an empty table gives an empty result. A frequent vector is merged
    in its tasks before vectors are dealt by value.
    """
    spark = rows.sparkSession
    usable = quantized(rows, id_col, vector_col)
    distinct = materialize(usable.select("x").distinct(), "distinct-vectors")
    fitted = moments(distinct)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return spark.createDataFrame([], schema)
    n, total = fitted.n, fitted.total
    values, vectors = eigen(fitted.spread / n)
    held = int((values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0.0)).sum())
    if not held:
        return spark.createDataFrame([], schema)
    explained = values[:held] / fitted.spread.trace() * n
    whole = total // n
    rest = (total - whole * n) / n  # the mean is whole + rest, with no digit lost
    to = vectors[:, :held] / np.sqrt(values[:held])

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - whole).astype(np.float64) - rest) @ to

    def fit_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = projected(_matrix(b.column(0), np.int64))
                ends = pa.array(np.arange(0, w.size + 1, held, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], ["w"])

    again = moments(distinct.mapInArrow(fit_list, "w array<double>"), "w")
    error = float(np.abs(again.spread / n - np.eye(held)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), np.int64)
            w = projected(x)
            # n * x - total is n * (x - whole) less the rest of the division, which keeps it small
            far = np.abs(x - whole).max() * float(n) + n
            if far * far * x.shape[1] < 2.0**62:
                off = n * (x - whole) - (total - whole * n)
                dev = pa.array((off * off).sum(1))
            else:
                offs = n * (x - whole).astype(object) - (total - whole * n).astype(object)
                dev = pa.array([v if v < 1 << 63 else None for v in (offs * offs).sum(1)], pa.int64())
            m = b.num_rows
            at = pa.array(np.repeat(np.arange(m), held))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), m)), pa.array(np.full(m * held, n)), dev.take(at),
                    pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * held, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def op12_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened coordinates of all embeddings."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
