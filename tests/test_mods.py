import hashlib

import pytest
from pyspark.sql import functions as F

from effortlens.operators import blame as bl
from effortlens.operators import commits as cm
from effortlens.operators import privacy as pv
from effortlens.operators import refresh as rf
from effortlens.plans import fixtures
from effortlens.schema import COMMIT

MOD = (
    "hash string, message string, committed_date string, number_of_mod_files int, file_name string, "
    "file_change_type_name string, file_old_path string, file_new_path string, number_lines_added int"
)


def mod(hash="c1", message="Fix x", date="2020-01-01 00:00:00+00:00", files=1, name="a.py", change="MODIFY", added=1):
    path = f"src/{name}"
    return (hash, message, date, files, name, change, path, None if change == "DELETE" else path, added)


def test_bug_fix_limits(spark):
    rows = [
        mod("ok", files=14, added=999),
        mod("files", files=15),
        mod("lines", added=1000),
        mod("word", message="prefix"),
        mod("gone", name="b.py"),
        mod("later", message="drop", date="2020-02-01 00:00:00+00:00", name="b.py", change="DELETE"),
    ]
    found = bl.bug_fix_mods(spark.createDataFrame(rows, MOD))
    assert [r.hash for r in found.collect()] == ["ok"]


def test_latest_change_goes_by_time_not_by_text(spark):
    rows = [
        mod("c1", date="2020-01-01 23:00:00-05:00", change="DELETE"),
        mod("c2", date="2020-01-02 01:00:00+00:00"),
    ]
    assert bl.surviving_paths(spark.createDataFrame(rows, MOD)).count() == 0


def test_blame_pairs_by_line(spark):
    mods = spark.createDataFrame([mod("c3"), mod("c4", message="add")], MOD).withColumn(
        "diff_added",
        F.expr("array(named_struct('line_no', 1, 'text', 'x'), named_struct('line_no', 2, 'text', 'x'), "
               "named_struct('line_no', 3, 'text', 'y'))"),
    )
    history = spark.createDataFrame(
        [
            ("c3", "src/a.py", "x", "c1"),
            ("c3", "src/a.py", "x", "c1"),
            ("c3", "src/a.py", "y", "c3"),
            ("c3", "src/a.py", "z", "c2"),
            ("c4", "src/a.py", "x", "c1"),
        ],
        "orig_hash string, path string, text string, blame_hash string",
    )
    rows = bl.blame_pairs(mods, history).collect()
    assert [tuple(r) for r in rows] == [("c3", "c1", "/repo/src/a.py")]


def test_labels(spark):
    mods = spark.createDataFrame([mod("c1"), mod("c1"), mod("c1", name="b.py"), mod("c2")], MOD)
    blame = spark.createDataFrame(
        [("c8", "c1", "/repo/src/a.py"), ("c9", "c1", "/repo/src/a.py")], "orig_hash string, blame_hash string, file string"
    )
    rows = {(r.hash, r.file_name): r.type for r in bl.label_bugs(mods, blame).collect()}
    assert rows == {("c1", "a.py"): "Buggy", ("c1", "b.py"): "Clean", ("c2", "a.py"): "Clean"}
    assert bl.label_bugs(mods, blame).count() == 3
    assert {r.type for r in bl.label_bugs(mods, blame.limit(0)).collect()} == {"Clean"}


def test_anonymise_and_back(spark, sf_dir):
    mods = fixtures.mods(spark, sf_dir)
    hidden, emails = pv.anonymise(mods)
    assert not set(hidden.columns) & {"Author", "Email", "Committer", "file_name", "file_old_path", "file_new_path"}
    restored = pv.de_anonymise(hidden, emails)
    wrong = restored.where(F.sha2("Email", 256) != F.col("Email_encrypted")).count()
    assert wrong == 0 and restored.where("Email is null").count() == 0
    assert restored.select("Email").distinct().count() == mods.select("Email").distinct().count()
    added = hidden.where(F.col("file_change_type_name") == "ADD").select("file_old_path_encrypted").distinct()
    assert [r[0] for r in added.collect()] == [hashlib.sha256(b"nan").hexdigest()]
    assert "message" not in pv.hash_personal(mods, drop_message=True).columns


def test_unknown_hash_gives_no_email(spark):
    scored = spark.createDataFrame([("h1",), ("h2",), (None,)], "Email_encrypted string")
    emails = spark.createDataFrame([("h1", "a@x")], "Email_encrypted string, Email string")
    rows = pv.de_anonymise(scored, emails).collect()
    assert sorted((r.Email for r in rows), key=str) == [None, None, "a@x"]


def test_explode_of_bare_commit(spark):
    modification = ("x.py", ("ADD", 1), None, "x.py", None, ["m"], [], 3, 0, None, True, None, None, None, [], [])
    commit = (
        "c1", ("n", "e"), ("k",), "two\nlines", None, None, None, True, False, None, None, None,
        [modification, modification],
    )
    empty = ("c2", ("n", "e"), ("k",), "m", None, None, ["b"], True, False, None, None, None, [])
    rows = cm.explode_commits(spark.createDataFrame([commit, empty], COMMIT)).collect()
    assert len(rows) == 2
    row = rows[0]
    assert (row.number_of_mod_files, row.number_of_branches, row.file_size) == (2, 0, 0)
    assert (row.number_functions_before, row.number_functions_after) == (0, 1)
    assert row.committed_date is None and row.file_ext == "py"


@pytest.mark.parametrize("days", [("2020-01-02", "2020-01-02"), ("2020-01-03", "2020-01-02"), ("2020-01-01", None), ("", "2020-01-01")])
def test_bad_ranges(spark, days):
    with pytest.raises(ValueError):
        cm.scan_range(spark.createDataFrame([mod()], MOD), *days)


def test_ranges(spark):
    rows = [
        mod("first", date="2020-01-01 00:00:00+00:00"),
        mod("last", date="2020-01-31 19:00:00-05:00"),
        mod("after", date="2020-02-01 00:00:01+00:00"),
        mod("before", date="2020-01-01 00:30:00+02:00"),
    ]
    mods = spark.createDataFrame(rows, MOD)
    for table in (mods, rf.with_commit_time(mods)):
        found = cm.scan_range(table, "2020-01-01", "2020-02-01")
        assert {r.hash for r in found.collect()} == {"first", "last"}
    assert cm.scan_range(mods).count() == 4
    assert not cm.has_commits(cm.scan_range(mods, "2010-01-01", "2011-01-01"))
    assert cm.newest_first(mods).first().hash == "after"


def test_refresh_knows_null_paths(spark):
    mods = spark.createDataFrame([mod("c1", change="DELETE"), mod("c2")], MOD)
    assert rf.unseen(mods, mods).count() == 0
    more = mods.unionByName(spark.createDataFrame([mod("c3", change="DELETE")], MOD))
    assert [r.hash for r in rf.unseen(rf.with_commit_time(mods), more).collect()] == ["c3"]
    assert rf.unseen(rf.with_commit_time(mods), mods.limit(0)).count() == 0
