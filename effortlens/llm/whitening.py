"""Whitening of embeddings by singular values of their centred rows.

Rows are reduced block by block to a triangular matrix R with the same covariance,
in the tasks and then over ever fewer groups of tasks; no product of columns
is formed. The singular values and right singular vectors of R
(`bidiagonal`) give the directions, which whiten all rows in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.arrays import utf8
from effortlens.llm.bidiagonal import leading
from effortlens.session import materialise

COMPONENTS = 16
# Steps of the grid on which entries lie, and its offset.
STEPS, OFFSET = 64, 1_000_000
# Entries beyond this many steps count as this many.
_FURTHEST = 1 << 62
# Rows of one QR factorisation.
BLOCK_ROWS = 4_096
# Groups of tasks whose matrices are reduced together, step by step.
_LEVELS = (1_024, 32, 1)


@dataclass
class Whitening:
    """n fitted vectors, their sum per dimension, and for each component its direction (a column), variance and share of all variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def grid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): every entry c of `embedding` as the long floor(64 * c) + 1000000.

    Rows whose vector is null or holds null or non-finite entries are left out,
    and so are those of another length than most rows have (of lengths
    equally frequent, the least counts). Entries of 2^56 and more in size, whose steps a
    long cannot hold, count as 2^56.
    """
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    valid = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & ~odd)
    sizes = valid.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    length = sizes["size"] if sizes else 0
    steps = lambda c: F.floor(F.greatest(F.least(c.cast("double") * STEPS, F.lit(float(_FURTHEST))), F.lit(-float(_FURTHEST))))
    return valid.where(F.size("embedding") == length).select("vec_id", F.transform("embedding", lambda c: steps(c) + F.lit(OFFSET).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as long where that fits, else as Python integers."""
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base)]
    if max(map(abs, base)) < 1 << 61 and (not x.size or np.abs(x).max() < 1 << 61):
        near = x - np.array(base, np.int64)
        if not x.size or int(np.abs(near).max()) * n < 1 << 61:
            return near * n - np.array(rest, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return (_differences(x, n, sums) / n).astype(float)


def _deviations(differences: np.ndarray) -> list[int | None]:
    """Sum of squares of every row, exactly; None where a long cannot hold it."""
    if differences.dtype != object and (not differences.size or int(np.abs(differences).max()) <= math.isqrt(((1 << 63) - 1) // differences.shape[1])):
        return (differences * differences).sum(axis=1).tolist()
    totals = (differences.astype(object) ** 2).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in totals]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangles(column: pa.Array, d: int) -> np.ndarray:
    """Stored matrices, one below the other."""
    return np.frombuffer(utf8(column)[0].tobytes()).reshape(-1, d)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            # Halves of 32 bits cannot overflow in a batch.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            totals = [t + (h << 32) + w for t, h, w in zip(totals, high, low)]
        columns = [pa.array([*range(d), d], pa.int32()), pa.array([*map(str, totals), str(n)])]
        yield pa.RecordBatch.from_arrays(columns, ["dimension", "total"])

    parts = rows.select("x").mapInArrow(run, "dimension int, total string")
    found = dict(parts.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())  # d + 1 rows
    return int(found.get(d, 0)), [int(found.get(i, 0)) for i in range(d)]


def _reduced(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows: blocks in a task, tasks in groups, groups in one."""
    d = len(sums)

    def row(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["part", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for first in range(0, len(x), BLOCK_ROWS):
                r = _triangle(np.concatenate((r, _centred(x[first : first + BLOCK_ROWS], n, sums))))
        if len(r):
            yield row(TaskContext.get().partitionId(), r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = np.zeros((0, d)), 0
        for batch in batches:
            for i in range(len(batch)):
                r = _triangle(np.concatenate((r, _triangles(batch.column("r").slice(i, 1), d))))
                part = batch.column("part")[i].as_py()
        yield row(part, r)

    out = rows.select("x").mapInArrow(run, "part int, r binary")
    for groups in _LEVELS:
        out = out.withColumn("part", F.pmod("part", F.lit(groups)))
        out = out.groupBy("part").applyInArrow(_merged(merge), "part int, r binary")
    whole = out.toArrow()  # one matrix of as many rows as dimensions
    return _triangles(whole.column("r"), d) if len(whole) else np.zeros((0, d))


def _merged(merge):
    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(merge(iter(group.to_batches())))

    return run


def fit(grid: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """Fit on each distinct vector of `grid` (vec_id, x) once: the whitening, and the table of those vectors.

    Equal vectors are collapsed in every task before they are shuffled. There are as
    many components as variances above rounding error, at most `components`;
    without rows, or with equal ones only, there are none. The driver holds one
    matrix of the vectors' length squared.
    """
    rows = materialise(grid.select("x").distinct(), "whitening-fit")
    first = rows.first()
    d = len(first["x"]) if first else 0
    if not d:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0)), rows
    n, sums = _sums(rows, d)
    r = _reduced(rows, n, sums)
    square = np.zeros((d, d))
    square[: len(r)] = r
    squares, directions = leading(square, components)
    scale = float(np.abs(r).max())
    total = float(((r / scale) ** 2).sum()) * scale**2 if scale else 0.0
    return Whitening(n, sums, directions, squares / n, squares / total if total else squares), rows


def whiten(grid: DataFrame, own: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) for every row of `grid`.

    `deviation` is the exact sum over dimensions of (n * x - S)^2, null where
    a long cannot hold it; `whitened` one number per component. Null ids are
    kept, repeated rows give repeated results.
    """
    d = len(own.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differences = _differences(_matrix(batch.column("x"), d), own.n, own.sums)
            values = (differences / own.n).astype(float) @ own.directions / np.sqrt(own.variances)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * values.shape[1]
            columns = [batch.column("vec_id"), pa.array(_deviations(differences), pa.int64()), pa.ListArray.from_arrays(offsets, values.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    shape = "vec_id long, deviation long, whitened array<double>"
    if not len(own.variances):
        return grid.sparkSession.createDataFrame([], shape)
    return grid.mapInArrow(run, shape)


def identity_error(rows: DataFrame, own: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened `rows` (the table that was fitted) minus the identity."""
    d, k = len(own.sums), len(own.variances)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            values = _centred(_matrix(batch.column("x"), d), own.n, own.sums) @ own.directions / np.sqrt(own.variances)
            total += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["cell", "value"])

    cells = rows.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value")).collect()  # k * k rows
    found = np.zeros(k * k)
    for cell, value in cells:
        found[cell] = value / own.n
    return float(np.abs(found.reshape(k, k) - np.eye(k)).max())


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of `vectors` (vec_id, embedding, any others).

    One row per row that `grid_vectors` keeps and component, from 1 by falling
    variance; `explained` is the component's share of all variance.
    """
    grid = grid_vectors(vectors)
    own, rows = fit(grid, components)
    error = identity_error(rows, own)
    shares = F.array(*[F.lit(float(x)) for x in own.explained]) if len(own.explained) else F.array().cast("array<double>")
    each = whiten(grid, own).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(own.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
