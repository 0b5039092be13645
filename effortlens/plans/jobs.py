"""The batch jobs: keep a store, label, train models, score a table, score a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.functions.text import base_name
from effortlens.operators.blame import label_bugs
from effortlens.operators.classifier import (
    BOOST_DEPTH,
    BOOST_ROUNDS,
    fit_classifiers,
    predict_clusters,
    settled_models,
)
from effortlens.operators.commits import dates_in_gmt, newest_first
from effortlens.operators.features import add_features, scoring_frame
from effortlens.operators.mixture import (
    CLUSTERS,
    MAX_ITERATIONS,
    assign_clusters,
    drop_unclustered,
    fit_mixtures,
)
from effortlens.operators.scoring import score_mods
from effortlens.operators.statistics import ranges, training_set
from effortlens.schema import FEATURES
from effortlens.session import materialise, run_folder
from effortlens.sources.csv import read_mods_csv, read_mods_many, write_csv
from effortlens.sources.models import load_classifiers, load_mixture, load_training_ranges, save_models
from effortlens.sources.store import ModStore

FORMATS = ("csv", "parquet")


def read_mods(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    return spark.read.parquet(path) if form == "parquet" else read_mods_csv(spark, path)


def write_mods(mods: DataFrame, path: str, form: str = "csv", compression: str | None = None) -> None:
    """`compression` is that of the form: plain for CSV, snappy for Parquet by default."""
    if form == "parquet":
        mods.write.parquet(path, compression=compression)
    else:
        write_csv(mods, path, compression=compression or "none")


def refresh(store: ModStore, mods: DataFrame, blame: DataFrame | None = None) -> None:
    """Add the mods that the store does not hold yet; create it if there is none."""
    if store.exists():
        store.refresh(mods, blame)
    else:
        store.create(mods.dropDuplicates(), blame)


def label(store: ModStore) -> DataFrame:
    """All mods of a store, each once, labelled by its blame rows, the newest commits first."""
    return newest_first(label_bugs(store.mods(), store.blame()))


def training_rows(mods: DataFrame) -> DataFrame:
    """The scaled inliers that models are trained on."""
    return training_set(add_features(mods))


def labelled_rows(training: DataFrame, mixture: DataFrame, low_high: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """The rows that classifiers learn from: raw features and the mixture's cluster."""
    raw = training.select("file_ext", "hash", *FEATURES)
    return drop_unclustered(assign_clusters(raw, mixture, low_high, k)).drop("posteriors")


def fit_all(mods: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixture parameters, training ranges and classifiers for every trainable extension."""
    return fit_training(training_rows(mods), **options)


def fit_training(
    training: DataFrame,
    k: int = CLUSTERS,
    kind: str = "boosted",
    rounds: int = BOOST_ROUNDS,
    depth: int = BOOST_DEPTH,
    max_iterations: int = MAX_ITERATIONS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for the training rows of mods."""
    low_high = materialise(ranges(training), "ranges")
    mixture = materialise(fit_mixtures(training, k, max_iterations=max_iterations), "mixture")
    labelled = materialise(labelled_rows(training, mixture, low_high, k), "clustered", compression="zstd")
    fitted = fit_classifiers(labelled, kind, rounds=rounds, depth=depth)
    return mixture, low_high, settled_models(fitted)


def train(mods: DataFrame, root: str, **options) -> None:
    """Fit all models and save them under `root`."""
    with run_folder(mods.sparkSession, "train"):
        save_models(mods.sparkSession, root, *fit_all(mods, **options))


def score(mods: DataFrame, root: str, scaler: str = "target", min_rows: int = 0) -> DataFrame:
    """Score mods, clear or anonymised, with the models under `root`.

    `scaler="target"` takes the feature ranges of the scored rows,
    `"training"` those the models were trained with.
    """
    spark = mods.sparkSession
    frame = predict_clusters(scoring_frame(add_features(mods)), load_classifiers(spark, root))
    fitted = load_training_ranges(spark, root) if scaler == "training" else None
    return score_mods(frame, load_mixture(spark, root), fitted, min_rows=min_rows)


def rewrite_in_gmt(spark: SparkSession, paths: list[str], target: str) -> None:
    """Write every mod file again with both dates in GMT, a folder per file of origin.

    The folder is named by the file and a digest of its full path, so files of
    one name in two folders stay apart.
    """
    mods = dates_in_gmt(read_mods_many(spark, paths))
    origin = F.concat_ws("-", base_name(F.col("origin")), F.substring(F.sha2("origin", 256), 1, 8))
    write_csv(mods.withColumn("origin", origin), target, by="origin")


def score_file(
    spark: SparkSession, source: str, target: str, root: str, form: str = "csv", compression: str | None = None, **options
) -> None:
    """Anonymised mods in, scored mods out, all extensions in one result, compressed as told."""
    with run_folder(spark, "score"):
        write_mods(score(read_mods(spark, source, form), root, **options), target, form, compression)
