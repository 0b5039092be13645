"""Time the headline operators: one JSON line with seconds per query.

The mod table is derived from the given tables and written once, untimed; each
operator then runs over all of it. A query is run twice to warm up and its
median of three runs is reported; model fits are run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from effortlens.operators import (
    blame,
    commits,
    features,
    mixture,
    privacy,
    refresh,
    report,
    scoring,
    statistics as stats,
)
from effortlens.operators.joins import join_lookup
from effortlens.plans import fixtures, jobs
from effortlens.schema import FEATURES
from effortlens.session import fresh_path, materialise, spark_session
from effortlens.sources import csv as csv_files
from effortlens.streaming import rollup

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
STREAM_FILES = 20
WARM_UPS = 2

# The given tables are single files; the mod table is stored as several, as any large table is.
FILES = 2 * int(CPUS)


def run(frame) -> None:
    """Compute every row and column, keep none."""
    frame.write.format("noop").mode("overwrite").save()


def timed(query) -> float:
    start = time.perf_counter()
    query()
    return time.perf_counter() - start


def median(query) -> float:
    for _ in range(WARM_UPS):
        timed(query)
    return statistics.median(timed(query) for _ in range(3))


def main() -> None:
    spark = spark_session(
        "bench",
        spark__master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    mods = materialise(fixtures.mods_with_ext(spark, SF_DIR).repartition(FILES), "bench-mods")
    diffs = materialise(fixtures.mods_with_diff(spark, SF_DIR).repartition(FILES), "bench-diffs")
    history = materialise(fixtures.line_history(spark, SF_DIR).repartition(FILES), "bench-history")
    featured = features.scoring_frame(features.add_features(mods))
    given = featured.withColumn("cluster_id", F.floor((F.col("number_lines_added") - 1) / 10).cast("int"))
    model = mixture.moment_mixture(stats.scale_minmax(given)).where(F.col("file_ext") != "md")
    scored = materialise(scoring.score_mods(given, model), "bench-scored")
    training = stats.training_set(featured)
    java = training.where(F.col("file_ext") == "java")

    stream_files = fresh_path(spark, "bench-stream")
    rows = scored.select("Email", "committed_date", "file_ext", "language_supported", "mod_score")
    csv_files.write_csv(rows.repartition(STREAM_FILES), stream_files)

    def hide_and_restore() -> None:
        hidden, emails = privacy.anonymise(mods)
        run(privacy.de_anonymise(hidden, materialise(emails, "emails")))

    def label() -> None:
        pairs = materialise(blame.blame_pairs(diffs, history), "pairs")
        run(blame.label_bugs(mods, pairs))

    def roll_up_stream() -> None:
        target, state = fresh_path(spark, "rollup"), fresh_path(spark, "state")
        stream = rollup.read_scored_stream(spark, stream_files, maxFilesPerTrigger=STREAM_FILES)
        rollup.start_rollup(stream, target, state).awaitTermination()
        run(rollup.read_rollup(spark, target))

    seconds = {
        "features": median(lambda: run(features.add_features(mods).agg(*[F.sum(f) for f in FEATURES], F.count("*")))),
        "outlier_split": median(lambda: run(stats.flag_inliers(featured))),
        "minmax_scale": median(lambda: run(stats.scale_minmax(featured))),
        "score_fixed_model": median(lambda: run(scoring.score_mods(given, model))),
        "score_cube": median(lambda: run(report.score_cube(scored))),
        "month_series": median(lambda: run(report.month_series(scored, "py", (1996, 6), (1997, 5)))),
        "anonymise_restore": median(hide_and_restore),
        "blame_label": median(label),
        "stream_rollup": median(roll_up_stream),
        "newest_first": median(lambda: run(commits.newest_first(mods))),
        "refresh_unseen": median(lambda: run(refresh.unseen(mods, mods))),
        "mixture_fit": timed(lambda: mixture.fit_mixtures(java).collect()),
    }
    # The jobs as users run them: every extension, default rounds and depth.
    models = fresh_path(spark, "bench-models")
    seconds["train_job"] = timed(lambda: jobs.train(mods, models))
    seconds["score_job"] = timed(lambda: run(jobs.score(mods, models)))
    seconds["lookup_dealt"] = timed(lambda: run(join_lookup(mods, mods.groupBy("hash").agg(F.max("tokens").alias("most")), ["hash"], max_rows=10_000)))
    seconds = {name: round(value, 3) for name, value in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline operators",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
