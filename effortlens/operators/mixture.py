"""Gaussian mixtures per file extension: fitting, parameters as a table, posteriors as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from effortlens.functions.numbers import argmax
from effortlens.operators.statistics import ranges, scaled_name, unscaled
from effortlens.schema import FEATURES, MIXTURE
from effortlens.session import few_at_once, materialise, settle

# Fixed values.
CLUSTERS = 5
SEED = 42
MAX_ITERATIONS = 100
TOLERANCE = 1e-3
COVARIANCE_FLOOR = 1e-6

# Extensions whose sums, some hundred numbers each, are collected at once.
AT_ONCE = 1000

# Rows of an extension that its starting centres are found on, at about.
START_ROWS = 20_000

# Rows of one extension that a pass takes as one array.
BLOCK_ROWS = 8_192

# Models whose parameters travel with one function, about a kilobyte each.
MODELS_AT_ONCE = 10_000

def vector_of(frame: DataFrame, columns: list[str], name: str = "vector") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(frame)


def _packed_root(covariance: np.ndarray) -> tuple[list[float], float]:
    """Lower triangle, row by row, of the root of the precision matrix, and the log determinant."""
    factor = np.linalg.cholesky(covariance)
    root = np.linalg.inv(factor)
    log_det = 2.0 * float(np.log(np.diag(factor)).sum())
    return [float(v) for v in root[np.tril_indices(covariance.shape[0])]], log_det


@dataclass(frozen=True)
class Component:
    """One cluster of one extension."""

    weight: float
    mean: np.ndarray
    covariance: np.ndarray

    def row(self) -> tuple:
        root, log_det = _packed_root(self.covariance)
        flat = [float(v) for v in self.covariance.ravel()]
        return float(self.weight), [float(v) for v in self.mean], flat, root, log_det


def _blocks(training: DataFrame) -> DataFrame:
    """(file_ext, cells): the scaled rows of one extension, up to `BLOCK_ROWS` a block, as doubles feature by feature.

    A pass over blocks hands Python whole arrays: no row is converted, and none is grouped, once per iteration.
    """
    names = [scaled_name(f) for f in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def flushed(ext: str) -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(held.pop(ext), axis=1)
            del sizes[ext]
            for first in range(0, whole.shape[1], BLOCK_ROWS):
                cells = np.ascontiguousarray(whole[:, first : first + BLOCK_ROWS]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ext]), pa.array([cells], pa.binary())], ["file_ext", "cells"])

        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            exts = batch.column("file_ext").dictionary_encode()
            codes = exts.indices.to_numpy()
            for code, ext in enumerate(exts.dictionary.to_pylist()):
                part = x if len(exts.dictionary) == 1 else x[:, codes == code]
                held.setdefault(ext, []).append(part)
                sizes[ext] = sizes.get(ext, 0) + part.shape[1]
                if sizes[ext] >= BLOCK_ROWS:
                    yield from flushed(ext)
            if sum(sizes.values()) >= 8 * BLOCK_ROWS:
                for ext in list(held):
                    yield from flushed(ext)
        for ext in list(held):
            yield from flushed(ext)

    rows = training.where(F.col("file_ext").isNotNull()).select("file_ext", *[F.col(n).cast("double").alias(n) for n in names])
    return rows.mapInArrow(run, "file_ext string, cells binary")


def _sums(blocks: DataFrame, shares_of: Callable) -> dict[str, np.ndarray]:
    """Per extension the sums that the next parameters need.

    `shares_of(ext, x)` gives, for a block of rows, one a column, the share of each cluster in
    each row and the log likelihood of each row. A task adds up its own blocks
    and hands on some hundred numbers per extension; a grouped sum joins them.
    """
    size = len(FEATURES)
    upper = np.triu_indices(size)
    # Where the product of two features stands among those of `upper`.
    square = np.zeros((size, size), int)
    square[upper] = square.T[upper] = range(len(upper[0]))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for ext, cells in zip(batch.column("file_ext").to_pylist(), batch.column("cells")):
                x = np.frombuffer(cells.as_buffer()).reshape(size, -1)
                shares, log_likelihood = shares_of(ext, x)
                seconds = shares @ (x[upper[0]] * x[upper[1]]).T
                sums = np.concatenate(
                    [
                        [x.shape[1], log_likelihood.sum()],
                        shares.sum(axis=1),
                        (shares @ x.T).ravel(),
                        seconds[:, square].ravel(),
                    ]
                )
                total[ext] = total[ext] + sums if ext in total else sums
        for ext, sums in total.items():
            columns = [pa.array([ext] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["file_ext", "position", "value"])

    cells = (
        blocks.mapInArrow(partial, "file_ext string, position int, value double")
        .groupBy("file_ext", "position")
        .agg(F.sum("value").alias("value"))
    )
    result: dict[str, dict[int, float]] = {}
    for cell in cells.collect():  # some hundred numbers per model
        result.setdefault(cell.file_ext, {})[cell.position] = cell.value
    return {ext: np.array([v for _, v in sorted(at.items())]) for ext, at in result.items()}


def _components(sums: np.ndarray, k: int, floor: float) -> list[Component]:
    """New parameters from the sums of one extension; clusters nobody belongs to vanish."""
    size = len(FEATURES)
    n_rows, weights = sums[0], sums[2 : 2 + k]
    firsts = sums[2 + k : 2 + k + k * size].reshape(k, size)
    seconds = sums[2 + k + k * size :].reshape(k, size, size)
    found = []
    for weight, first, second in zip(weights, firsts, seconds):
        if weight > 10 * np.finfo(float).eps:
            mean = first / weight
            covariance = second / weight - np.outer(mean, mean) + floor * np.eye(size)
            found.append(Component(weight / n_rows, mean, covariance))
    return found


def _slices(by_extension: dict) -> list[dict]:
    items = sorted(by_extension.items())
    return [dict(items[i : i + AT_ONCE]) for i in range(0, len(items), AT_ONCE)]


def _nearest_centre(centres: dict[str, np.ndarray], k: int) -> Callable:
    def shares_of(ext, x):
        distance = ((x[None, :, :] - centres[ext][:, :, None]) ** 2).sum(axis=1)
        return (distance.argmin(axis=0) == np.arange(k)[:, None]).astype(float), np.zeros(x.shape[1])

    return shares_of


def _posterior(state: dict[str, list[Component]], k: int) -> Callable:
    """Posteriors under the present parameters; a vanished cluster has share 0."""
    terms = {}
    for ext, parts in state.items():
        roots = np.array([np.linalg.inv(np.linalg.cholesky(p.covariance)) for p in parts])
        means = np.array([p.mean for p in parts])
        log_root = np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
        constants = np.log([p.weight for p in parts]) + log_root - 0.5 * len(FEATURES) * math.log(2 * math.pi)
        terms[ext] = roots.reshape(-1, len(FEATURES)), np.einsum("cij,cj->ci", roots, means).reshape(-1, 1), constants[:, None]

    def shares_of(ext, x):
        roots, moved, constants = terms[ext]
        away = roots @ x - moved
        away *= away
        logs = constants - 0.5 * away.reshape(len(constants), -1, x.shape[1]).sum(axis=1)
        top = logs.max(axis=0)
        likelihood = np.exp(logs - top)
        total = likelihood.sum(axis=0)
        shares = np.zeros((k, x.shape[1]))
        shares[: len(constants)] = likelihood / total
        return shares, top + np.log(total)

    return shares_of


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """k-means with spread-out starting points; fewer different rows than k repeat centres."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        away = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).min(axis=1)
        share = away / away.sum() if away.sum() > 0 else np.full(len(x), 1 / len(x))
        centres = np.vstack((centres, x[rng.choice(len(x), p=share)]))
    for _ in range(rounds):
        label = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def _start(training: DataFrame, k: int, seed: int, max_rows: int = START_ROWS) -> dict[str, np.ndarray]:
    """Centres of a k-means clustering of each extension, all in one job, on about `max_rows` rows of each.

    The rows are those with the least hash. The centres are a start only; every
    iteration that follows is over all rows.
    """
    names = [scaled_name(f) for f in FEATURES]

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        x = rows.sort_values(["hash", *names], kind="stable")[names].to_numpy(dtype=float)
        found = _centres(x, k, np.random.default_rng(seed))
        return pd.DataFrame({"file_ext": rows["file_ext"].iloc[0], "centres": [found.ravel().tolist()]})

    sizes = training.groupBy("file_ext").agg(F.count("*").alias("n_rows"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("hash"), *map(F.col, names)), F.lit(1_000_000))
    sample = training.select("file_ext", "hash", *names).join(sizes, "file_ext").where(
        F.col("n_rows") * bucket < F.lit(max_rows * 1_000_000)
    )
    found = sample.drop("n_rows").groupBy("file_ext").applyInPandas(cluster, "file_ext string, centres array<double>")
    return {row.file_ext: np.array(row.centres).reshape(k, -1) for row in found.toLocalIterator()}


def fit_mixtures(
    training: DataFrame,
    k: int = CLUSTERS,
    seed: int = SEED,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    floor: float = COVARIANCE_FLOOR,
) -> DataFrame:
    """Fit a full-covariance mixture of k clusters per extension; returns the parameter table.

    Spark ML's own mixture has neither a k-means start nor a floor under the
    covariances. On feature rows, of which many are alike, its clusters shrink
    to single points, so each iteration here is one grouped sum over the rows
    of all extensions. Only some hundred numbers per extension reach the
    driver, `AT_ONCE` extensions at a time. An extension whose mean log
    likelihood moved by less than `tolerance` is left out of the next pass. The
    scaled columns are kept in blocks in memory and on disk for the passes; what an
    executor loses is read again from the training table.
    """
    needed = _blocks(training).persist(StorageLevel.MEMORY_AND_DISK)
    state: dict[str, list[Component]] = {}
    try:
        start = _start(training, k, seed)
        needed.count()  # rows become blocks many at once, blocks are taken few at once
        with few_at_once(training.sparkSession):
            for centres in _slices(start):
                rows = needed.where(F.col("file_ext").isin(list(centres))) if len(centres) < len(start) else needed
                for ext, sums in _sums(rows, _nearest_centre(centres, k)).items():
                    state[ext] = _components(sums, k, floor)
            bounds = dict.fromkeys(state, -math.inf)
            moving = sorted(state)
            for _ in range(max_iterations):
                for parts in _slices({e: state[e] for e in moving}):
                    rows = needed.where(F.col("file_ext").isin(list(parts)))
                    for ext, sums in _sums(rows, _posterior(parts, k)).items():
                        state[ext] = _components(sums, k, floor)
                        bound = sums[1] / sums[0]
                        if abs(bound - bounds[ext]) < tolerance:
                            moving.remove(ext)
                        bounds[ext] = bound
                if not moving:
                    break
    finally:
        needed.unpersist()
    rows = [(ext, c, *part.row()) for ext, parts in state.items() for c, part in enumerate(parts)]
    return training.sparkSession.createDataFrame(rows, MIXTURE)


def moment_mixture(scaled: DataFrame) -> DataFrame:
    """Mixture parameters of rows whose `cluster_id` is given: one aggregation, diagonal covariance."""
    names = [scaled_name(f) for f in FEATURES]
    variances = [F.var_pop(n) + COVARIANCE_FLOOR for n in names]
    size = len(names)
    grouped = scaled.groupBy("file_ext", F.col("cluster_id").alias("cluster")).agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.avg(n) for n in names]).alias("mean"),
        F.array(*variances).alias("variance"),
    )
    root = F.array(
        *[
            1.0 / F.sqrt(F.col("variance")[i]) if i == j else F.lit(0.0)
            for i in range(size)
            for j in range(i + 1)
        ]
    )
    log_det = F.aggregate("variance", F.lit(0.0), lambda total, v: total + F.log(v))
    covariance = F.array(
        *[F.col("variance")[i] if i == j else F.lit(0.0) for i in range(size) for j in range(size)]
    )
    known, _ = settle(grouped, "clusters")
    totals = known.groupBy("file_ext").agg(F.sum("n_rows").alias("n_ext"))
    parameters = known.join(totals, "file_ext").select(
        "file_ext",
        "cluster",
        (F.col("n_rows") / F.col("n_ext")).alias("weight"),
        "mean",
        covariance.alias("covariance"),
        root.alias("precision_root"),
        log_det.alias("log_det"),
    )
    return settle(parameters, "mixture")[0]


def centroids(mixture: DataFrame, fitted: DataFrame) -> DataFrame:
    """Centroids in real units with their sum, one row per extension and cluster."""
    real = [
        unscaled(F.col("mean")[i], F.col(f"{f}_min"), F.col(f"{f}_max")).alias(f)
        for i, f in enumerate(FEATURES)
    ]
    return mixture.join(fitted, "file_ext").select("file_ext", "cluster", *real).withColumn(
        "Sum_centroids", sum((F.col(f) for f in FEATURES), F.lit(0.0))
    )


def _posterior_terms(rows: list[Row]) -> dict[str, tuple]:
    """Per extension the arrays the posterior needs."""
    size = len(FEATURES)
    parts: dict[str, list] = {}
    for row in rows:
        parts.setdefault(row.file_ext, []).append(row)
    terms = {}
    for ext, rows in parts.items():
        roots = np.zeros((len(rows), size, size))
        for root, row in zip(roots, rows):
            root[np.tril_indices(size)] = row.precision_root
        moved = np.array([root @ np.array(row["mean"]) for root, row in zip(roots, rows)])
        constants = np.array(
            [math.log(r.weight) - 0.5 * (size * math.log(2 * math.pi) + r.log_det) for r in rows]
        )
        low = np.array([rows[0][f"{f}_min"] for f in FEATURES])
        width = np.array([rows[0][f"{f}_max"] for f in FEATURES]) - low
        clusters = [row.cluster for row in rows]
        terms[ext] = clusters, roots, moved, constants, low, np.where(width == 0, 1.0, width)
    return terms


def _posterior_of(terms: dict[str, tuple], k: int) -> Callable:
    """A vectorised function from (extension, raw features) to k posteriors."""

    def posterior(ext: pd.Series, features: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        values = features.to_numpy(dtype=float)
        result = np.full((len(values), k), np.nan)
        for name, at in ext.groupby(ext, sort=False).indices.items():
            if name not in terms:
                continue
            clusters, roots, moved, constants, low, width = terms[name]
            scaled = (values[at] - low) / width
            away = np.einsum("nj,cij->nci", scaled, roots, optimize=True) - moved
            logs = constants - 0.5 * (away**2).sum(axis=2)
            shares = np.exp(logs - logs.max(axis=1, keepdims=True))
            filled = np.zeros((len(at), k))
            filled[:, clusters] = shares / shares.sum(axis=1, keepdims=True)
            result[at] = filled
        return pd.DataFrame(result, columns=[f"p{c}" for c in range(k)])

    return F.pandas_udf(posterior, ", ".join(f"p{c} double" for c in range(k)))


def with_posteriors(
    frame: DataFrame, mixture: DataFrame, fitted: DataFrame, k: int = CLUSTERS
) -> DataFrame:
    """Add `posteriors`, an array of k probabilities, null where there is no model.

    All extensions are done in one pass without a shuffle: the parameters, some
    hundred numbers per model, travel with the function. (As column expressions
    the 135 products per row make one generated method that is too large for
    the JIT compiler; measured, that is three to eight times slower.) Should
    there be more than `MODELS_AT_ONCE` models, the extensions are taken in
    slices by hash, each with its own models.
    """
    models = mixture.join(fitted, "file_ext")
    ext = F.coalesce("file_ext", F.lit(""))
    rows = models.limit(MODELS_AT_ONCE * k + 1).collect()
    if len(rows) <= MODELS_AT_ONCE * k:
        return _add_posteriors(frame, rows, k)
    models = materialise(models, "models")
    slices = math.ceil(models.count() / (MODELS_AT_ONCE * k)) + 1
    parts = []
    for number in range(slices):
        mine = F.pmod(F.xxhash64(ext), F.lit(slices)) == number
        parts.append(_add_posteriors(frame.where(mine), models.where(mine).collect(), k))
    return reduce(DataFrame.unionByName, parts)


def _add_posteriors(frame: DataFrame, models: list[Row], k: int) -> DataFrame:
    posterior = _posterior_of(_posterior_terms(models), k)
    found = frame.withColumn("_found", posterior(F.coalesce("file_ext", F.lit("")), F.struct(*FEATURES)))
    shares = F.array(*[F.col(f"_found.p{c}") for c in range(k)])
    return found.withColumn("posteriors", F.when(F.col("_found.p0").isNotNull(), shares)).drop("_found")


def assign_clusters(
    frame: DataFrame, mixture: DataFrame, fitted: DataFrame | None = None, k: int = CLUSTERS
) -> DataFrame:
    """Add the posteriors and the most probable `cluster`.

    `frame` holds raw features; `fitted` are the ranges to scale with, by
    default those of `frame` itself.
    """
    low_high = settle(ranges(frame), "ranges")[0] if fitted is None else fitted
    return with_posteriors(frame, mixture, low_high, k).select(
        *frame.columns, "posteriors", argmax(F.col("posteriors")).alias("cluster")
    )


def drop_unclustered(frame: DataFrame, column: str = "cluster") -> DataFrame:
    """Rows that did get a cluster."""
    return frame.dropna(subset=[column])


def cluster_sizes(frame: DataFrame, column: str = "cluster") -> DataFrame:
    return frame.groupBy(column).agg(F.count("*").alias("n_rows"))


def covariance_table(scaled: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Population covariance and correlation of every feature pair per group, in long form.

    One aggregation gives all pairs; only the few result rows are unpivoted.
    """
    pairs = [(i, j) for i in range(len(features)) for j in range(len(features))]
    sums = [
        F.covar_pop(features[i], features[j]).alias(f"v_{i}_{j}") for i, j in pairs if i <= j
    ]

    def at(i: int, j: int) -> Column:
        return F.col(f"v_{min(i, j)}_{max(i, j)}")

    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                at(i, j).alias("covariance"),
                F.try_divide(at(i, j), F.sqrt(at(i, i) * at(j, j))).alias("correlation"),
            )
            for i, j in pairs
        ]
    )
    return scaled.groupBy(*by).agg(*sums).select(*by, F.inline(cells))


def model_covariances(mixture: DataFrame) -> DataFrame:
    """Covariances of a mixture, one row per extension, cluster and cell."""
    size = len(FEATURES)
    return mixture.select(
        "file_ext", "cluster", F.posexplode("covariance").alias("cell", "covariance")
    ).select(
        "file_ext",
        "cluster",
        F.floor(F.col("cell") / size).cast("int").alias("i"),
        (F.col("cell") % size).alias("j"),
        "covariance",
    )
