"""Cases that once went wrong: missing values in training, renames, undated rows, mixed headers, column order."""

import pytest
from pyspark.sql import functions as F

from effortlens.operators import blame as bl
from effortlens.operators import features as ft
from effortlens.operators import privacy, refresh, report
from effortlens.plans import fixtures, jobs
from effortlens.sources import csv as files
from effortlens.sources import store as stores
from effortlens.streaming import rollup

MOD = "hash string, committed_date string, file_change_type_name string, file_old_path string, file_new_path string"


def test_mods_without_dmm_values_are_trained_on(spark, sf_dir):
    mods = fixtures.mods_with_ext(spark, sf_dir)
    missing = mods.where("dmm_unit_size is null")
    rows = jobs.training_rows(mods)
    assert rows.join(missing.select("hash").distinct(), "hash", "left_semi").count() > 0
    filled = mods.fillna(0.0, ["dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing"])
    assert rows.count() == jobs.training_rows(filled).count()


def test_a_renamed_path_is_gone_until_it_comes_back(spark):
    def alive(*rows):
        return {r.path for r in bl.surviving_paths(spark.createDataFrame(list(rows), MOD)).collect()}

    add = ("1", "2020-01-01 00:00:00+00:00", "ADD", None, "a.py")
    rename = ("2", "2020-01-02 00:00:00+00:00", "RENAME", "a.py", "b.py")
    delete = ("3", "2020-01-03 00:00:00+00:00", "DELETE", "b.py", None)
    again = ("4", "2020-01-04 00:00:00+00:00", "ADD", None, "a.py")
    assert alive(add) == {"a.py"}
    assert alive(add, rename) == {"b.py"}
    assert alive(rename, delete, add) == set()
    assert alive(again, delete, rename, add) == {"a.py"}
    assert alive(("2", "2020-01-02 00:00:00+00:00", "MODIFY", "a.py", "a.py"), add) == {"a.py"}


def test_undated_mods_are_added_once(spark):
    schema = MOD + ", n int"
    rows = [("1", None, "ADD", None, "a", 1), ("2", "2020-01-01 00:00:00+00:00", "ADD", None, "b", 1)]
    store = refresh.with_commit_time(spark.createDataFrame(rows, schema))
    assert refresh.unseen(store, spark.createDataFrame(rows, schema)).count() == 0
    assert refresh.unseen(store, spark.createDataFrame(rows[:1], schema)).count() == 0
    new = [("3", None, "ADD", None, "a", 1), rows[0]]
    assert [r.hash for r in refresh.unseen(store, spark.createDataFrame(new, schema)).collect()] == ["3"]


def test_a_folder_with_two_headers_is_refused_and_read_by_name_file_by_file(spark, tmp_path):
    folder = tmp_path / "mods"
    folder.mkdir()
    (folder / "a.csv").write_text("hash,file_ext\nh1,py\n")
    (folder / "b.csv").write_text("file_ext,hash\njs,h2\n")
    with pytest.raises(Exception, match="header"):
        files.read_mods_csv(spark, str(folder)).collect()
    found = files.read_mods_many(spark, [str(folder / "a.csv"), str(folder / "b.csv")])
    assert {(r.hash, r.file_ext) for r in found.collect()} == {("h1", "py"), ("h2", "js")}


def test_the_stream_sums_restored_files_of_any_column_order(spark, sf_dir, tmp_path):
    scored = fixtures.features(spark, sf_dir).withColumn("mod_score", F.col("feature_total_changed"))
    hidden, emails = privacy.anonymise(scored)
    restored = privacy.de_anonymise(hidden, emails)
    files.write_csv(restored, str(tmp_path / "in"))
    stream = rollup.read_scored_stream(spark, str(tmp_path / "in"))
    rollup.start_rollup(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = rollup.read_rollup(spark, str(tmp_path / "out"))
    wanted = report.score_cube(scored)
    assert found.count() == wanted.count() > 3000
    total = lambda df: df.agg(F.sum("score")).first()[0]
    assert total(found) == pytest.approx(total(wanted))


def test_a_stream_without_a_needed_column_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Email,mod_score\nx,1\n")
    with pytest.raises(ValueError, match="committed_date"):
        rollup.read_scored_stream(spark, str(tmp_path / "in"))


def test_extensions_that_look_like_numbers_stay_text(spark, tmp_path):
    frame = spark.createDataFrame([("007", 1.0), ("7", 2.0)], "file_ext string, mod_score double")
    stores.save_scores(frame, str(tmp_path / "scores"))
    assert {r.file_ext for r in stores.load_scores(spark, str(tmp_path / "scores")).collect()} == {"007", "7"}


def test_files_of_one_name_stay_apart(spark, tmp_path):
    paths = []
    for folder in "ab":
        (tmp_path / folder).mkdir()
        path = tmp_path / folder / "mods.csv"
        path.write_text(f"hash,authored_date,committed_date\n{folder},2020-01-01 00:00:00+01:00,2020-01-01 00:00:00+01:00\n")
        paths.append(str(path))
    jobs.rewrite_in_gmt(spark, paths, str(tmp_path / "gmt"))
    assert len([p for p in (tmp_path / "gmt").iterdir() if p.name.startswith("origin=")]) == 2


def test_counts_beyond_32_bits(spark):
    row = [(2**31 - 1, 2**31 - 1, 0, 0, 1, 1.0, 1.0, 1.0)]
    names = "number_lines_added int, number_lines_removed int, number_functions_before int, number_functions_after int, number_functions_edited int"
    frame = spark.createDataFrame(row, names + ", dmm_unit_size double, dmm_unit_complexity double, dmm_unit_interfacing double")
    assert ft.add_features(frame).first().total_changed == 2**32 - 2


def test_a_store_is_created_refreshed_and_labelled(spark, sf_dir, tmp_path):
    mods = fixtures.mods_with_ext(spark, sf_dir)
    store = stores.ModStore(spark, str(tmp_path), "Demo")
    assert not store.exists()
    jobs.refresh(store, mods.where("committed_date < '1998'"))
    assert {r["type"] for r in jobs.label(store).select("type").distinct().collect()} == {"Clean"}
    jobs.refresh(store, mods, fixtures.blame(spark, sf_dir))
    found = jobs.label(store)
    assert found.count() == mods.select(*[c for c in found.columns if c in mods.columns and c != "file_ext"]).distinct().count()
    assert {r["type"] for r in found.select("type").distinct().collect()} == {"Buggy", "Clean"}
