import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from effortlens.functions import dates, numbers, text


def values(spark, inputs, expression, kind="string"):
    """The expression over each input, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extension_without_dot(spark):
    names = [".bashrc", "a.tar.gz", "x.c++", "x.c#", None, "a.", "..a", "Makefile", "", "a b.py"]
    wanted = ["NoExt", "gz", "c++", "c#", "NoExt", "NoExt", "a", "NoExt", "NoExt", "py"]
    assert values(spark, names, text.extension) == wanted


def test_extension_with_dot(spark):
    assert values(spark, ["a.tar.gz", ".bashrc", "a"], text.dotted_extension) == [".gz", "NoExt", "NoExt"]


def test_extension_of_path(spark):
    paths = ["src/x.c++", "src/x.c#", None, "a.b/c", "a/.git", "d/e.tar.x_1-2", "x.a$bc", "x. "]
    wanted = ["c++", "NoExt", "NoExt", "NoExt", "NoExt", "x_1-2", "bc", "NoExt"]
    assert values(spark, paths, text.path_extension) == wanted


def test_hash_of_missing_value(spark):
    def digest(value):
        return hashlib.sha256(value.encode()).hexdigest()

    assert values(spark, [None, "é"], text.sha256_text) == [digest("nan"), digest("é")]


def test_bug_words(spark):
    messages = ["Fix x", "debug", "prefix", "BUG", "a bug, a fix", "éfix", "fix_me", None]
    wanted = [True, False, False, False, True, False, False, None]
    assert values(spark, messages, text.mentions_bug) == wanted
    assert values(spark, messages[:6], text.bug_word_count) == [1, 0, 0, 0, 2, 0]


SOURCES = [
    "a\nb",
    "a\r\nb\r\n",
    "",
    "\n",
    "\n\n",
    "a\x0bb\x1cc\x85d ",
    "a\rb",
    "a\x0c",
    "one",
    "x y\x1d\x1ez",
]


def test_lines_count_as_splitlines_does(spark):
    assert values(spark, SOURCES, text.line_count) == [len(s.splitlines()) for s in SOURCES]
    assert values(spark, [None], text.line_count) == [0]


def test_base_name(spark):
    assert values(spark, ["a/b/c.py", "c.py", None], text.base_name) == ["c.py", "c.py", None]


def test_lenient_numbers(spark):
    inputs = ["12", " 1.5 ", "x", "NaN", None, "12abc", "3d", "1e3", ""]
    wanted = [12.0, 1.5, None, None, None, None, None, 1000.0, None]
    assert values(spark, inputs, numbers.lenient_number) == wanted


def test_feature_numbers(spark):
    assert values(spark, [1.5, None, float("nan")], numbers.feature_number, "double") == [1.5, 0.0, 0.0]
    assert values(spark, [1.5, None, float("nan")], numbers.is_number, "double") == [True, False, False]


def test_argmax_takes_the_first_of_equals(spark):
    inputs = [[0.1, 0.7, 0.2], [0.5, 0.5], None]
    assert values(spark, inputs, numbers.argmax, "array<double>") == [1, 0, None]


def test_year_change_with_offset(spark):
    night = ["2020-12-31 23:30:00-05:00"]
    assert values(spark, night, dates.local_day) == [datetime.date(2020, 12, 31)]
    assert values(spark, night, dates.gmt_text) == ["2021-01-01 04:30:00+00:00"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_gmt_does_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert values(spark, ["2021-06-01T08:00:00+02:00"], dates.gmt_text) == ["2021-06-01 06:00:00+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_days_of_odd_dates(spark):
    assert values(spark, ["2020-01-05T10:00:00", "soon", None], dates.local_day) == [
        datetime.date(2020, 1, 5),
        None,
        None,
    ]
