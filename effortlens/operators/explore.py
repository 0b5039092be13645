"""Exploration: k-means, principal components, silhouettes, column statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.operators.mixture import vector_of
from effortlens.operators.statistics import standardise
from effortlens.session import few_at_once

# Fixed values.
SWEEP = (2, 3, 4, 5, 6, 8)
SWEEP_SEED = 10
SWEEP_ITERATIONS = 50
CLUSTERS = 5
COMPONENTS = 6
# Centres that move less than this have settled, as in Spark's estimator.
STAY = 1e-4
# Rows that a pass takes as one array.
BLOCK_ROWS = 8_192

# Names of the ways to start.
INIT_MODES = {"k-means++": "k-means||", "random": "random"}


def spread_array(frame: DataFrame, array: str, size: int, prefix: str = "x") -> DataFrame:
    """One double column per position of an array column."""
    cells = [F.col(array)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)]
    return frame.select(*(c for c in frame.columns if c != array), *cells)


def normalise_rows(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale each row to unit length; a row of zeros stays as it is."""
    length = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    return (
        frame.withColumn("_length", length)
        .withColumns({f: F.coalesce(F.try_divide(F.col(f), F.col("_length")), F.col(f)) for f in features})
        .drop("_length")
    )


def describe(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per column: rows, least, greatest, mean, variance (n-1), skewness, excess kurtosis."""
    rows = []
    for f in features:
        rows += [
            F.struct(
                F.lit(f).alias("feature"),
                F.count(f).alias("n"),
                F.min(f).alias("minimum"),
                F.max(f).alias("maximum"),
                F.avg(f).alias("mean"),
                F.var_samp(f).alias("variance"),
                F.skewness(f).alias("skewness"),
                F.kurtosis(f).alias("kurtosis"),
            )
        ]
    return frame.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def fit_kmeans(
    frame: DataFrame,
    features: Sequence[str],
    k: int = CLUSTERS,
    init: str = "k-means++",
    max_iterations: int = 20,
    seed: int = SWEEP_SEED,
) -> KMeansModel:
    estimator = KMeans(
        k=k, initMode=INIT_MODES[init], maxIter=max_iterations, seed=seed, featuresCol="vector"
    )
    return estimator.fit(vector_of(frame, list(features)).select("vector"))


def kmeans(frame: DataFrame, features: Sequence[str], **options) -> tuple[DataFrame, KMeansModel]:
    """The rows with their `cluster`, and the model with its centres."""
    model = fit_kmeans(frame, features, **options)
    labelled = model.setPredictionCol("cluster").transform(vector_of(frame, list(features)))
    return labelled.drop("vector"), model


def centres_table(model: KMeansModel, frame: DataFrame) -> DataFrame:
    rows = [(c, i, float(v)) for c, centre in enumerate(model.clusterCenters()) for i, v in enumerate(centre)]
    return frame.sparkSession.createDataFrame(rows, "cluster int, i int, value double")


def pca(
    frame: DataFrame, features: Sequence[str], k: int = COMPONENTS, scale: bool = True
) -> tuple[DataFrame, PCAModel]:
    """Rows with component scores `pc0`.. and the fitted model; columns are standardised first."""
    ready = standardise(frame, features) if scale else frame
    vectors = vector_of(ready, list(features))
    model = PCA(k=k, inputCol="vector", outputCol="scores").fit(vectors)
    scores = vector_to_array("scores")
    rest = [c for c in frame.columns if c not in features]
    found = model.transform(vectors).select(*rest, *(scores[i].alias(f"pc{i}") for i in range(k)))
    return found, model


def explained_variance(model: PCAModel, frame: DataFrame) -> DataFrame:
    """Share of the variance per component, and the running sum."""
    shares = [float(v) for v in model.explainedVariance]
    rows = [(i, share, math.fsum(shares[: i + 1])) for i, share in enumerate(shares)]
    return frame.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def silhouette_samples(frame: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Silhouette of every row with squared Euclidean distance, as `silhouette`.

    The mean squared distance to a cluster follows from the cluster's size, sum
    and sum of squares, so one pre-aggregating pass and one scan are enough
    however many rows there are. Clusters are few; their moments travel with
    the vectorised function of the second pass.
    """
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    clusters = (
        frame.groupBy(label)
        .agg(F.count("*").alias("n"), F.sum(norm).alias("norms"), *[F.sum(f).alias(f) for f in features])
        .collect()  # one row per cluster
    )
    labels = np.array([c[label] for c in clusters])
    sizes = np.array([float(c["n"]) for c in clusters])
    norms = np.array([c["norms"] for c in clusters])
    sums = np.array([[c[f] for f in features] for c in clusters])

    def silhouette(own: pd.Series, values: pd.DataFrame) -> pd.Series:
        import numpy as np
        import pandas as pd

        x = values.to_numpy(dtype=float)
        total = (x**2).sum(axis=1)[:, None] * sizes - 2 * x @ sums.T + norms
        mine = own.to_numpy()[:, None] == labels
        # A row has no distance to itself, so its own cluster counts one row less.
        mean = np.maximum(total, 0) / np.where(mine, np.maximum(sizes - 1, 1), sizes)
        a = np.where(mine, mean, 0).sum(axis=1)
        b = np.where(mine, np.inf, mean).min(axis=1)
        larger = np.maximum(a, b)
        found = np.divide(b - a, larger, out=np.zeros(len(x)), where=larger > 0)
        alone = np.where(mine, sizes, 0).sum(axis=1) <= 1
        return pd.Series(np.where(alone, 0.0, found))

    score = F.pandas_udf(silhouette, "double")
    return frame.withColumn("silhouette", score(F.col(label), F.struct(*features)))


def silhouette_mean(frame: DataFrame, features: Sequence[str], label: str = "cluster") -> float:
    """Mean silhouette with squared Euclidean distance, by Spark's own evaluator."""
    evaluator = ClusteringEvaluator(featuresCol="vector", predictionCol=label)
    return evaluator.evaluate(vector_of(frame, list(features)))


def _row_blocks(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cells): the features of up to `BLOCK_ROWS` rows a block, as doubles feature by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features]))
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield from flushed(held)
                held, n = [], 0
        if n:
            yield from flushed(held)

    def flushed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate(held, axis=1)
        for first in range(0, whole.shape[1], BLOCK_ROWS):
            cells = np.ascontiguousarray(whole[:, first : first + BLOCK_ROWS]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([cells], pa.binary())], ["cells"])

    return frame.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(run, "cells binary")


def _block_sums(blocks: DataFrame, n_features: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`of_block` gives an array of numbers for a block of rows, one a column; here it is summed over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cells in batch.column("cells"):
                sums = of_block(np.frombuffer(cells.as_buffer()).reshape(n_features, -1))
                total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["position", "value"])

    cells = blocks.mapInArrow(run, "position int, value double").groupBy("position").agg(F.sum("value").alias("value"))
    return np.array([c["value"] for c in sorted(cells.collect(), key=lambda c: c["position"])])  # some numbers per cluster


def _nearest(x: np.ndarray, sets: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """For every set of centres the number of that nearest to each row of the block; of equal ones the first.

    By one product, with an origin among the centres, so that digits are not lost to a common offset.
    """
    centres = np.concatenate(sets)
    origin = centres.mean(axis=0)
    centres = centres - origin
    away = (centres * centres).sum(axis=1)[:, None] / 2 - centres @ (x - origin[:, None])
    first = 0
    for own in sets:
        yield away[first : first + len(own)].argmin(axis=0)
        first += len(own)


def _members(nearest: np.ndarray, k: int) -> np.ndarray:
    return nearest == np.arange(k)[:, None]


def _moved(blocks: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Every set of centres after one step of Lloyd's: the means of the rows nearest to each; one without rows stays."""
    size = next(iter(centres.values())).shape[1]
    sets = list(centres.values())

    def of_block(x: np.ndarray) -> np.ndarray:
        found = []
        for own, nearest in zip(sets, _nearest(x, sets)):
            mine = _members(nearest, len(own)).astype(float)
            found += [mine.sum(axis=1), (mine @ x.T).ravel()]
        return np.concatenate(found)

    sums, at, moved = _block_sums(blocks, size, of_block), 0, {}
    for k, own in centres.items():
        n, totals = sums[at : at + len(own)], sums[at + len(own) : at + len(own) * (1 + size)].reshape(len(own), size)
        moved[k] = np.where(n[:, None] > 0, totals / np.maximum(n, 1)[:, None], own)
        at += len(own) * (1 + size)
    return moved


def _lloyd(blocks: DataFrame, centres: dict[int, np.ndarray], max_iterations: int) -> dict[int, np.ndarray]:
    """Lloyd's steps for all sets of centres at once, a pass over the rows each; a set whose centres all stay is left out of the next pass."""
    found, moving = dict(centres), dict(centres)
    for _ in range(max_iterations):
        if not moving:
            break
        after = _moved(blocks, moving)
        found.update(after)
        moving = {k: c for k, c in after.items() if (((c - moving[k]) ** 2).sum(axis=1) > STAY**2).any()}
    return found


def _silhouettes(blocks: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette with squared Euclidean distance of every set of centres, its rows labelled by the nearest.

    As `silhouette_samples`, for all sets in two passes: sums per cluster, then the rows.
    """
    sets = list(centres.values())
    size = sets[0].shape[1]

    def sums_of(x: np.ndarray) -> np.ndarray:
        norms, found = (x * x).sum(axis=0), []
        for own, nearest in zip(sets, _nearest(x, sets)):
            mine = _members(nearest, len(own)).astype(float)
            found += [mine.sum(axis=1), mine @ norms, (mine @ x.T).ravel()]
        return np.concatenate(found)

    sums, at, known = _block_sums(blocks, size, sums_of), 0, []
    for own in sets:
        n, norms, totals = np.split(sums[at : at + len(own) * (2 + size)], [len(own), 2 * len(own)])
        kept = n > 0  # a cluster without rows is none
        known.append((own, kept, n, norms, totals.reshape(len(own), size)))
        at += len(own) * (2 + size)

    def scores_of(x: np.ndarray) -> np.ndarray:
        norm, found = (x * x).sum(axis=0), [x.shape[1]]
        for (own, kept, n, norms, totals), label in zip(known, _nearest(x, sets)):
            mine = _members(label, len(own))[kept]
            sizes = n[kept, None]
            total = np.maximum(norm * sizes - 2 * (totals[kept] @ x) + norms[kept, None], 0)
            mean = total / np.where(mine, np.maximum(sizes - 1, 1), sizes)
            a, b = np.where(mine, mean, 0).sum(axis=0), np.where(mine, np.inf, mean).min(axis=0)
            larger = np.maximum(a, b)
            score = np.divide(b - a, larger, out=np.zeros(x.shape[1]), where=larger > 0)
            found.append(score[n[label] > 1].sum())
        return np.array(found, float)

    if any(kept.sum() < 2 for _, kept, *_ in known):
        raise ValueError("a silhouette needs two clusters or more")
    n_rows, *scores = _block_sums(blocks, size, scores_of)
    return {k: float(s / n_rows) for k, s in zip(centres, scores)}


def _starts(frame: DataFrame, features: Sequence[str], ks: Sequence[int]) -> dict[int, np.ndarray]:
    """The centres that Spark's estimator starts from at random, for each k: different ones of k rows drawn with its seed.

    Drawn as the estimator draws them, from the rows as they are read; the estimator itself first keeps all rows as objects in memory.
    """
    context = frame.sparkSession.sparkContext
    rows = frame.select(F.array(*[F.col(f).cast("double") for f in features]).alias("cells"))._jdf.rdd()
    found = {}
    for k in dict.fromkeys(ks):
        seed = context._jvm.org.apache.spark.util.random.XORShiftRandom(SWEEP_SEED).nextInt()
        drawn = [list(row.getSeq(0).mkString(" ").split(" ")) for row in rows.takeSample(False, k, seed)]
        found[k] = np.array([[float(v) for v in row] for row in dict.fromkeys(map(tuple, drawn))])
    return found


def silhouette_sweep(frame: DataFrame, features: Sequence[str], ks: Sequence[int] = SWEEP) -> DataFrame:
    """Mean silhouette of a k-means clustering for each k.

    The starting centres are those of Spark's estimator. The steps of all k are taken together:
    one pass over blocks of rows, kept in memory and on disk, per step.
    """
    blocks = _row_blocks(frame, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks.count()  # rows become blocks many at once, blocks are taken few at once
        starts = _starts(frame, features, ks)
        with few_at_once(frame.sparkSession):
            found = _silhouettes(blocks, _lloyd(blocks, starts, SWEEP_ITERATIONS))
    finally:
        blocks.unpersist()
    return frame.sparkSession.createDataFrame([(k, found[k]) for k in ks], "k int, silhouette double")
