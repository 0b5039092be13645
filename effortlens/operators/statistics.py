"""Statistics per file extension: outliers, scaling, training gates.

Every operator here makes one pre-aggregating pass over the six features, whose
few resulting rows meet the mods again through `join_lookup`. The mods themselves are never shuffled by extension, so an
extension with a third of all rows does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.functions.numbers import ratio_or_zero
from effortlens.operators.features import feature_frame
from effortlens.operators.joins import join_lookup
from effortlens.schema import FEATURES
from effortlens.session import materialise

# Fixed values.
OUTLIER_Z = 3.0
MIN_TRAINING_ROWS = 50

# Below this a standard deviation is rounding dust of a constant column.
ZERO_SD = 1e-12


def moments(frame: DataFrame, by: Sequence[str] = ("file_ext",), features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and population standard deviation of every feature."""
    aggregates = [F.count("*").alias("n_rows")]
    for f in features:
        aggregates += [F.avg(f).alias(f"{f}_avg"), F.stddev_pop(f).alias(f"{f}_sd")]
    return frame.groupBy(*by).agg(*aggregates)


def ranges(frame: DataFrame, by: Sequence[str] = ("file_ext",), features: Sequence[str] = FEATURES) -> DataFrame:
    """Least and greatest value of every feature."""
    aggregates = []
    for f in features:
        aggregates += [F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max")]
    return frame.groupBy(*by).agg(*aggregates)


def _standard_score(f: str) -> Column:
    sd = F.when(F.col(f"{f}_sd") >= ZERO_SD, F.col(f"{f}_sd"))
    return F.try_divide(F.col(f) - F.col(f"{f}_avg"), sd)


def flag_inliers(frame: DataFrame, z: float = OUTLIER_Z, features: Sequence[str] = FEATURES) -> DataFrame:
    """Add `is_inlier`: every feature lies within `z` standard deviations of its extension.

    A feature that is constant within an extension has no standard score, which
    makes every row of that extension an outlier.
    """
    stats = moments(frame, features=features).drop("n_rows")
    inside = F.lit(True)
    for f in features:
        inside = inside & F.coalesce(F.abs(_standard_score(f)) < z, F.lit(False))
    return join_lookup(frame, stats, ["file_ext"]).select(*frame.columns, inside.alias("is_inlier"))


def split_outliers(frame: DataFrame, z: float = OUTLIER_Z) -> tuple[DataFrame, DataFrame]:
    """The inliers and the outliers; each row is in exactly one of the two."""
    flagged = flag_inliers(frame, z)
    return (
        flagged.where("is_inlier").drop("is_inlier"),
        flagged.where(~F.col("is_inlier")).drop("is_inlier"),
    )


def scaled_name(feature: str) -> str:
    return feature.replace("feature_", "scaled_", 1)


def scale_minmax(frame: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Add each feature scaled to 0..1 within its extension; a constant feature becomes 0.

    `fitted` takes ranges of other rows (`ranges`) in place of those of `frame`.
    """
    stats = ranges(frame) if fitted is None else fitted
    scaled = [
        ratio_or_zero(F.col(f) - F.col(f"{f}_min"), F.col(f"{f}_max") - F.col(f"{f}_min")).alias(
            scaled_name(f)
        )
        for f in FEATURES
    ]
    return join_lookup(frame, stats, ["file_ext"]).select(*frame.columns, *scaled)


def unscaled(value: Column, low: Column, high: Column) -> Column:
    """Undo the scaling; a constant feature counts as one unit wide."""
    return value * F.when(high == low, 1.0).otherwise(high - low) + low


def standardise(frame: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Replace each feature by its standard score (population deviation); constants become 0."""
    if by:
        joined = join_lookup(frame, moments(frame, by, features).drop("n_rows"), list(by))
    else:
        stats = moments(frame, (), features).drop("n_rows").first().asDict()
        joined = frame.withColumns({name: F.lit(value) for name, value in stats.items()})
    scores = {f: F.coalesce(_standard_score(f), F.lit(0.0)) for f in features}
    return joined.withColumns(scores).select(frame.columns)


def first_supported(frame: DataFrame) -> Column:
    """Whether the first row of a group is of a supported language.

    "First" is the least (hash, file name, flag), so the answer does not depend
    on how the rows are spread over files.
    """
    names = ("hash", "file_name", "file_name_encrypted", "language_supported")
    return F.min_by("language_supported", F.struct(*[c for c in names if c in frame.columns]))


def extension_summary(frame: DataFrame, z: float = OUTLIER_Z) -> DataFrame:
    """Per extension: rows, inliers, outliers, and whether its first row is of a supported language."""
    return (
        flag_inliers(frame, z)
        .groupBy("file_ext")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if("is_inlier").alias("n_inliers"),
            F.count_if(~F.col("is_inlier")).alias("n_outliers"),
            first_supported(frame).alias("supported"),
        )
    )


def trainable_extensions(
    frame: DataFrame, min_rows: int = MIN_TRAINING_ROWS, z: float = OUTLIER_Z
) -> DataFrame:
    """Extensions a model may be trained on."""
    return extension_summary(frame, z).where(
        (F.col("n_rows") >= min_rows) & F.col("supported") & (F.col("n_inliers") >= 1)
    )


def at_least(frame: DataFrame, min_rows: int) -> DataFrame:
    """Rows of the extensions that have at least `min_rows` rows."""
    counts = frame.groupBy("file_ext").agg(F.count("*").alias("n_rows"))
    return join_lookup(frame, counts, ["file_ext"]).where(F.col("n_rows") >= min_rows).drop("n_rows")


def training_set(featured: DataFrame, min_rows: int = MIN_TRAINING_ROWS, z: float = OUTLIER_Z) -> DataFrame:
    """Scaled inliers of all trainable extensions, written per extension.

    Missing feature values count as 0, as everywhere, before any statistic.
    The mods are read once: their features are written, and moments, ranges of the inliers
    and the inliers themselves come from that table. The inliers are shuffled once, before they are
    scaled, and written per extension, since model fits read them many times, each only the files of its own extension.
    """
    keys = ["file_ext", "hash", "Author", "language_supported", "file_name", "file_name_encrypted"]
    frame = feature_frame(featured, *[c for c in keys if c in featured.columns])
    frame = materialise(frame, "features", compression="zstd")
    stats = (
        frame.groupBy("file_ext")
        .agg(
            F.count("*").alias("n_rows"),
            first_supported(frame).alias("supported"),
            *[e for f in FEATURES for e in (F.avg(f).alias(f"{f}_avg"), F.stddev_pop(f).alias(f"{f}_sd"))],
        )
        .where((F.col("n_rows") >= min_rows) & F.col("supported"))
    )
    inside = F.lit(True)
    for f in FEATURES:
        inside = inside & F.coalesce(F.abs(_standard_score(f)) < z, F.lit(False))
    inliers = join_lookup(frame, stats, ["file_ext"]).where(inside).select(frame.columns)
    spread = inliers.hint("rebalance", "file_ext")
    return materialise(scale_minmax(spread, ranges(inliers)), "training", by="file_ext", spread=True, compression="zstd")
