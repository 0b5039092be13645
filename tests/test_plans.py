"""The plans the operators are meant to have."""

import os
import re

import pytest

from effortlens.operators import blame as bl
from effortlens.operators import features as ft
from effortlens.operators import mixture as mx
from effortlens.operators import privacy as pv
from effortlens.operators import report as rp
from effortlens.operators import scoring as sc
from effortlens.operators import statistics as st
from effortlens.plans import fixtures
from effortlens.session import materialise, run_folder, shared_dir


@pytest.fixture(scope="module")
def mods(spark):
    return materialise(fixtures.mods_with_ext(spark, "/root/testdata/sf0.001"), "mods")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(frame):
    """Exchanges that are not broadcasts."""
    return len(re.findall(r"\bExchange\b", plan(frame)))


def featured(mods):
    return ft.scoring_frame(ft.add_features(mods)).selectExpr(
        "*", "cast(floor((number_lines_added - 1) / 10) as int) as cluster_id"
    )


def test_nothing_is_shuffled_by_extension(mods):
    frame = featured(mods)
    assert shuffles(frame) == 0
    assert shuffles(st.flag_inliers(frame)) == 0
    assert shuffles(st.scale_minmax(frame)) == 0
    model = mx.moment_mixture(st.scale_minmax(frame))
    scored = sc.score_mods(frame, model)
    assert shuffles(scored) == 0
    assert plan(scored).count("ArrowEvalPython") == 1


def test_statistics_are_added_up_before_the_shuffle(mods):
    text = plan(st.moments(featured(mods)))
    assert text.count("HashAggregate") == 2 and "partial_avg" in text and shuffles(st.moments(featured(mods))) == 1


def test_hiding_needs_no_shuffle_and_restoring_no_shuffle_of_the_mods(mods):
    hidden, emails = pv.anonymise(mods)
    assert shuffles(hidden) == 0
    assert shuffles(pv.de_anonymise(hidden, emails)) == 0


def test_month_series_reads_what_it_needs_and_shuffles_once(mods):
    scored = ft.add_features(mods).withColumnRenamed("feature_total_changed", "mod_score")
    series = rp.month_series(scored, "py", (1996, 1), (1996, 12))
    assert shuffles(series) == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan(series)).group(1)
    assert "message" not in schema and "file_name" not in schema


def test_extension_filter_reaches_the_scan(mods):
    text = plan(ft.add_features(mods).where("file_ext = 'py'"))
    assert "EqualTo(file_ext,py)" in text


def test_copies_collapse_before_the_shuffle(mods):
    text = plan(bl.label_bugs(mods, bl_rows(mods)))
    first_scan = text.index("FileScan")
    before = text[:first_scan]
    assert before.rindex("HashAggregate") > before.rindex("Exchange")


def bl_rows(mods):
    return mods.selectExpr("hash as orig_hash", "hash as blame_hash", "file_new_path as file")


def test_blame_shuffles(spark, sf_dir):
    """With broadcasts off; the line history is shuffled once, the labels need no shuffle of their own."""
    at = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(at)
    spark.conf.set(at, "-1")
    try:
        history = materialise(fixtures.line_history(spark, sf_dir), "history")
        diffs = materialise(fixtures.mods_with_diff(spark, sf_dir), "diffs")
        pairs = bl.blame_pairs(diffs, history)
        assert shuffles(pairs) <= 6
        assert shuffles(bl.label_bugs(diffs, materialise(pairs, "pairs"))) <= 2
    finally:
        spark.conf.set(at, before)


def test_a_job_leaves_no_intermediate_tables(spark, sf_dir, tmp_path):
    before = set(os.listdir(shared_dir(spark)))
    with run_folder(spark, "job"):
        materialise(spark.range(5), "x")
        with run_folder(spark, "inner"):
            assert materialise(spark.range(7), "y").count() == 7
        assert len(set(os.listdir(shared_dir(spark))) - before) == 1
    assert set(os.listdir(shared_dir(spark))) == before


def test_model_rows_are_read_per_extension(mods):
    training = st.training_set(featured(mods))
    text = plan(training.where("file_ext = 'py'").select("scaled_total_changed"))
    assert "PartitionFilters: [isnotnull(file_ext" in text
    assert "ReadSchema: struct<scaled_total_changed:double>" in text
