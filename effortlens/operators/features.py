"""Effort features of one mod: pure column expressions, one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.functions.numbers import feature_number
from effortlens.schema import FEATURES

# Exponents of the effort model.
TOTAL_POWER = 0.7
ADD_DELETE_POWER = 1.3
EDITED_POWER = 1.1
SIZE_POWER = 0.5
DMM_SIZE_POWER = 0.3


def _effort(count: Column, power: float, size: Column, size_power: float) -> Column:
    return F.pow(count, F.lit(power)) * F.pow(size, F.lit(size_power))


def add_features(mods: DataFrame) -> DataFrame:
    """Add the two counts and the six features to every mod."""
    changed = F.col("total_changed")
    moved, edited = F.col("n_functions_add_del"), F.col("number_functions_edited")
    spread = _effort(moved, ADD_DELETE_POWER, changed, DMM_SIZE_POWER) + _effort(
        edited, EDITED_POWER, changed, DMM_SIZE_POWER
    )
    return mods.withColumns(
        {
            # In 64 bits, so that no sum of two counts overflows.
            "total_changed": F.col("number_lines_added").cast("long") + F.col("number_lines_removed"),
            "n_functions_add_del": F.abs(
                F.col("number_functions_before").cast("long") - F.col("number_functions_after")
            ),
        }
    ).withColumns(
        {
            "feature_total_changed": F.pow(changed, F.lit(TOTAL_POWER)),
            "feature_add_del_functions": _effort(moved, ADD_DELETE_POWER, changed, SIZE_POWER),
            "feature_changed_functions": _effort(edited, EDITED_POWER, changed, SIZE_POWER),
            "feature_dmm_unit_complexity": F.col("dmm_unit_complexity") * spread,
            "feature_dmm_size": F.col("dmm_unit_size") * spread,
            "feature_dmm_unit_interfacing": F.col("dmm_unit_interfacing") * spread,
        }
    )


def feature_frame(featured: DataFrame, *keys: str) -> DataFrame:
    """Keep `keys` and the six features, missing feature values as 0."""
    return featured.select(*keys, *(feature_number(F.col(f)).alias(f) for f in FEATURES))


def training_frame(featured: DataFrame) -> DataFrame:
    """The columns model training needs, for all extensions at once."""
    return feature_frame(featured, "file_ext", "hash", "Author", "language_supported")


def scoring_frame(featured: DataFrame) -> DataFrame:
    """All columns of the mods, missing feature values as 0."""
    return featured.withColumns({f: feature_number(F.col(f)) for f in FEATURES})
