"""Silhouettes with plain Euclidean distance.

Unlike squared distances, true ones do not follow from a cluster's sums: every scored row
is compared with all rows. The scored rows travel to the tasks in blocks of
bounded size, each task adds up their distances per cluster, and the sums meet by row
and cluster. All rows, or a bounded number picked by hash, are scored; either way
each silhouette is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.session import materialise

# Rows that are compared with all rows in one pass.
BLOCK_ROWS = 2_048
# Rows that a mean is taken over, unless told otherwise.
SAMPLE_ROWS = 4_096
# Rows of the table whose distances to all points of a pass a task holds at once.
_AT_ONCE = 512
# Squared distances under this share of the squared lengths are worked out from differences: products would lose their digits.
_CLOSE = 1e-4
# Close pairs whose differences are held at once.
_PAIRS_AT_ONCE = 4_096
# Standard errors to either side that hold the true mean in 95 of 100 cases.
_SURE = 1.96


def _distances(part: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of every row of `part` to every point, by products; those of close pairs by differences."""
    lengths = np.einsum("ij,ij->i", part, part)[:, None] + np.einsum("ij,ij->i", points, points)[None, :]
    squares = lengths - 2 * (part @ points.T)
    close = np.nonzero(~(squares >= _CLOSE * lengths))
    for first in range(0, len(close[0]), _PAIRS_AT_ONCE):
        a, b = (c[first : first + _PAIRS_AT_ONCE] for c in close)
        away = part[a] - points[b]
        squares[a, b] = np.einsum("ij,ij->i", away, away)
    return np.sqrt(squares)


def _distance_sums(rows: DataFrame, points: np.ndarray, ids: np.ndarray, features: Sequence[str]) -> DataFrame:
    """(_row, _label, distance): sums of the distances of every point to all rows, per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            labels = np.array(batch.column("_label").to_pylist())
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
            for label in np.unique(labels).tolist():
                own = x[labels == label]
                total = sums.setdefault(label, np.zeros(len(points)))
                for first in range(0, len(own), _AT_ONCE):
                    total += _distances(own[first : first + _AT_ONCE], points).sum(axis=0)
        for label, total in sums.items():
            columns = [pa.array(ids), pa.array([label] * len(ids)).cast(pa.int64()), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_label", "distance"])

    parts = rows.select("_label", *features).mapInArrow(run, "_row long, _label long, distance double")
    return parts.groupBy("_row", "_label").agg(F.sum("distance").alias("distance"))


def _numbered(frame: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    rows = frame.where(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("_row"), F.col(label).cast("long").alias("_label"), F.struct(*frame.columns).alias("_given"), *numbers
    )
    return materialise(rows, "silhouette-rows")


def euclidean_silhouettes(
    frame: DataFrame, features: Sequence[str], label: str = "cluster", sample_rows: int | None = None
) -> DataFrame:
    """The rows of `frame` with their `silhouette`, exact for every row that is returned.

    That are all rows with a label, or about `sample_rows` of them, picked by a hash of
    their values. Labels are whole numbers; a row alone in its cluster has 0, and so
    has every row if there is one cluster only. Null features count as 0. The work is the number of
    scored rows times that of all rows, `BLOCK_ROWS` scored rows a pass.
    """
    rows = _numbered(frame, features, label)
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # one row per cluster
    n = sum(sizes.values())
    by_hash = F.pmod(F.xxhash64(*features, "_row"), F.lit(1 << 40))
    chosen = rows if sample_rows is None or n <= sample_rows else rows.where(by_hash * n < F.lit(sample_rows * (1 << 40)).cast("double"))
    blocks = max(1, math.ceil(min(n, sample_rows or n) / BLOCK_ROWS))
    at = F.pmod(F.xxhash64("_row"), F.lit(blocks))
    sums = None
    for block in range(blocks):
        points = chosen.where(at == block).select("_row", *features).toArrow()  # about BLOCK_ROWS rows
        if not len(points):
            continue
        x = np.stack([points.column(f).to_numpy() for f in features], axis=1)
        found = materialise(_distance_sums(rows, x, points.column("_row").to_numpy(), features), "silhouette-sums")
        sums = found if sums is None else sums.unionByName(found)
    if sums is None:
        return frame.limit(0).withColumn("silhouette", F.lit(0.0))
    count = F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[F.col("_label")]
    own = F.col("_label") == F.col("_own")
    scored = (
        sums.join(chosen.select("_row", F.col("_label").alias("_own")), "_row")
        .groupBy("_row")
        .agg(
            F.max(F.when(own & (count > 1), F.col("distance") / (count - 1))).alias("a"),
            F.min(F.when(~own, F.col("distance") / count)).alias("b"),
        )
    )
    larger = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (larger == 0), 0.0).otherwise((F.col("b") - F.col("a")) / larger)
    given: list[Column] = [F.col("_given")[c].alias(c) for c in frame.columns]
    return chosen.join(scored.select("_row", value.alias("silhouette")), "_row").select(*given, "silhouette")


def euclidean_mean(frame: DataFrame, features: Sequence[str], label: str = "cluster", sample_rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """One row (n_rows, n_scored, silhouette, error): the mean silhouette, and how far off it may be.

    `error` bounds the difference to the mean over all rows in 95 of 100 cases, by the
    spread of the scored rows; it is 0 where all rows are scored.
    """
    n_rows = frame.where(F.col(label).isNotNull()).count()
    scored = euclidean_silhouettes(frame, features, label, sample_rows)
    found = scored.agg(F.count("*").alias("n_scored"), F.avg("silhouette").alias("silhouette"), F.stddev_samp("silhouette").alias("spread"))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("n_scored") / F.lit(max(n_rows, 1))))
    error = _SURE * F.coalesce("spread", F.lit(0.0)) / F.sqrt(F.greatest(F.col("n_scored"), F.lit(1))) * rest
    return found.select(F.lit(n_rows).cast("long").alias("n_rows"), "n_scored", "silhouette", error.alias("error"))
