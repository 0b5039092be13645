"""What a refresh of a mod store shuffles of a row, and that the rows are right for it."""

import glob

from pyspark.sql import functions as F

from effortlens.operators import refresh as rf
from effortlens.sources import store as stores

MOD = "hash string, committed_date string, file_old_path string, file_new_path string, message string, before int, after int"


def _rows(spark, month, *names, message="m", before=1, after=None):
    return spark.createDataFrame([(n, month and f"{month}-05 10:00:00+00:00", None, f"{n}.py", message, before, after) for n in names], MOD)


def _stored(store):
    return sorted((r["hash"], r["committed_month"] or "", r["before"] or 0, r["after"] or 0) for r in store.mods().collect())


def _spied(monkeypatch, module):
    seen, whole = [], module.rows_at
    monkeypatch.setattr(module, "rows_at", lambda rows, places, files: seen.append(len(files)) or whole(rows, places, files))
    return seen


def test_only_files_with_known_or_repeated_mods_are_shuffled(spark, tmp_path, monkeypatch):
    store, seen = stores.ModStore(spark, str(tmp_path), "Demo"), _spied(monkeypatch, stores)
    first = _rows(spark, "2020-01", "a", "b").unionByName(_rows(spark, None, "u")).unionByName(_rows(spark, "2020-02", "c"))
    store.create(first.repartition(3))
    assert _stored(store) == [("a", "2020-01", 1, 0), ("b", "2020-01", 1, 0), ("c", "2020-02", 1, 0), ("u", "", 1, 0)]
    assert max(len(glob.glob(f"{m}/*.parquet")) for m in glob.glob(f"{store.path}/committed_month=*")) == 1
    store.refresh(_rows(spark, "2020-03", *"defgh").repartition(2))
    store.refresh(_rows(spark, "2020-01", "a").coalesce(1))
    assert seen == [] and store.mods().count() == 9
    again = _rows(spark, "2020-04", "x", "x", "y").unionByName(_rows(spark, "2020-01", "b", "z")).unionByName(_rows(spark, None, "u", "v"))
    store.refresh(again.coalesce(1))
    assert seen == [3]
    added = [("v", "", 1, 0), ("x", "2020-04", 1, 0), ("y", "2020-04", 1, 0), ("z", "2020-01", 1, 0)]
    assert [r for r in _stored(store) if r[0] in "uvxyzb"] == [("b", "2020-01", 1, 0), ("u", "", 1, 0), *added]


def test_rows_of_one_hash_that_differ_are_both_kept(spark, tmp_path):
    store = stores.ModStore(spark, str(tmp_path), "Demo")
    store.create(_rows(spark, "2020-01", "a"))
    shifted = _rows(spark, "2020-02", "b", before=1, after=None).unionByName(_rows(spark, "2020-02", "b", before=None, after=1))
    assert shifted.select(F.xxhash64(*shifted.columns)).distinct().count() == 1
    store.refresh(shifted.unionByName(shifted).coalesce(1))
    assert _stored(store) == [("a", "2020-01", 1, 0), ("b", "2020-02", 0, 1), ("b", "2020-02", 1, 0)]


def test_a_mod_stored_under_another_month_is_seen(spark):
    store = rf.with_commit_time(_rows(spark, "2020-02", "a"))
    new = _rows(spark, "2020-01", "b").unionByName(_rows(spark, "2020-03", "a", "c"))
    found = [sorted(r["hash"] for r in way(store, rf.with_commit_time(new)).collect()) for way in (rf.unseen, rf.unseen_by_month)]
    assert found == [["b", "c"], ["b", "c"]]
