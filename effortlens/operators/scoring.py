"""Scores: the value of a mod's cluster times the probability of that cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.operators.joins import join_lookup
from effortlens.operators.mixture import CLUSTERS, centroids, with_posteriors
from effortlens.operators.statistics import at_least, ranges
from effortlens.schema import NO_MODEL
from effortlens.session import settle


def score_mods(
    frame: DataFrame,
    mixture: DataFrame,
    fitted: DataFrame | None = None,
    k: int = CLUSTERS,
    min_rows: int = 0,
) -> DataFrame:
    """Score every mod in one plan for all extensions.

    `frame` holds the raw features and `cluster_id`, the cluster predicted by
    the classifier. The probability is the mixture's posterior of that cluster.
    Features are scaled with the ranges of the scored rows themselves; `fitted`
    takes the ranges of the training rows instead. Rows whose extension has no
    model get zeros. `min_rows` drops extensions with fewer rows.
    """
    if min_rows:
        frame = at_least(frame, min_rows)
    low_high = settle(ranges(frame), "ranges")[0] if fitted is None else fitted
    values = centroids(mixture, low_high).select(
        "file_ext", F.col("cluster").alias("cluster_id"), F.col("Sum_centroids").alias("sum_centroid")
    )
    scored = join_lookup(with_posteriors(frame, mixture, low_high, k), values, ["file_ext", "cluster_id"])
    cluster = F.col("cluster_id")
    has_model = cluster.isNotNull() & F.col("posteriors").isNotNull()
    probability = F.when(has_model, F.try_element_at("posteriors", cluster + 1))
    return scored.select(
        *(c for c in frame.columns if c != "cluster_id"),
        F.when(has_model, cluster.cast("string")).otherwise(NO_MODEL).alias("predicted_cluster"),
        F.coalesce(probability, F.lit(0.0)).alias("probablities"),
        F.when(has_model, F.coalesce("sum_centroid", F.lit(0.0))).otherwise(0.0).alias("sum_centroid"),
    ).withColumn("mod_score", F.col("sum_centroid") * F.col("probablities"))
