import numpy as np
import pytest
from pyspark.sql import functions as F

from effortlens.operators import statistics as st
from effortlens.operators.features import add_features
from effortlens.schema import FEATURES


def frame_of(spark, rows):
    """Rows of (extension, supported, six features)."""
    schema = "file_ext string, hash string, Author string, language_supported boolean, " + ", ".join(
        f"{f} double" for f in FEATURES
    )
    return spark.createDataFrame(
        [(ext, f"h{i:04}", "a", ok, *map(float, x)) for i, (ext, ok, x) in enumerate(rows)], schema
    )


def noise(n, seed=1):
    return np.random.default_rng(seed).gamma(2.0, 3.0, (n, 6))


def test_features_by_hand(spark):
    mods = spark.createDataFrame(
        [(9, 7, 1, 4, 2, 0.5, 0.25, None), (0, 0, 0, 0, 0, 1.0, 1.0, 1.0)],
        "number_lines_added int, number_lines_removed int, number_functions_before int, "
        "number_functions_after int, number_functions_edited int, dmm_unit_size double, "
        "dmm_unit_complexity double, dmm_unit_interfacing double",
    )
    first, second = add_features(mods).orderBy(F.desc("number_lines_added")).collect()
    spread = 3**1.3 * 16**0.3 + 2**1.1 * 16**0.3
    wanted = [16**0.7, 3**1.3 * 4, 2**1.1 * 4, 0.25 * spread, 0.5 * spread]
    assert [first[f] for f in FEATURES[:5]] == pytest.approx(wanted)
    assert first[FEATURES[5]] is None
    assert [second[f] for f in FEATURES] == [0.0] * 6


def test_outliers_by_brute_force(spark):
    x = noise(300)
    x[5] = 500
    frame = frame_of(spark, [("py", True, row) for row in x])
    inside = (np.abs((x - x.mean(axis=0)) / x.std(axis=0)) < 3).all(axis=1)
    inliers, outliers = st.split_outliers(frame)
    assert {r.hash for r in inliers.collect()} == {f"h{i:04}" for i in np.flatnonzero(inside)}
    assert {r.hash for r in outliers.collect()} == {f"h{i:04}" for i in np.flatnonzero(~inside)}


def test_constant_feature_makes_every_row_an_outlier(spark):
    x = noise(60)
    x[:, 2] = 0.1
    rows = [("md", True, r) for r in x] + [("py", True, r) for r in noise(60, 2)]
    counts = {r.file_ext: r for r in st.extension_summary(frame_of(spark, rows)).collect()}
    assert (counts["md"].n_inliers, counts["md"].n_outliers) == (0, 60)
    assert counts["py"].n_inliers > 0


def test_constant_feature_scales_to_zero(spark):
    x = noise(20)
    x[:, 4] = 7
    frame = frame_of(spark, [("py", True, r) for r in x])
    rows = st.scale_minmax(frame).collect()
    assert {r.scaled_dmm_size for r in rows} == {0.0}
    assert max(r.scaled_total_changed for r in rows) == 1.0
    width = spark.range(1).select(st.unscaled(F.lit(0.5), F.lit(7.0), F.lit(7.0)).alias("v")).first()
    assert width.v == 7.5


def test_ranges_of_other_rows(spark):
    fitted = st.ranges(frame_of(spark, [("py", True, [0] * 6), ("py", True, [10] * 6)]))
    rows = st.scale_minmax(frame_of(spark, [("py", True, [5] * 6)]), fitted).collect()
    assert rows[0].scaled_total_changed == 0.5


def test_training_gates(spark):
    rows = [("few", True, r) for r in noise(49)] + [("py", True, r) for r in noise(50)]
    rows += [("md", False, r) for r in noise(60)]
    constant = noise(60)
    constant[:, 0] = 3
    rows += [("txt", True, r) for r in constant]
    frame = frame_of(spark, rows)
    assert [r.file_ext for r in st.trainable_extensions(frame).collect()] == ["py"]
    assert {r.file_ext for r in st.training_set(frame).collect()} == {"py"}


def test_at_least(spark):
    frame = frame_of(spark, [("a", True, [1] * 6)] * 2 + [("b", True, [1] * 6)] * 3)
    assert {r.file_ext for r in st.at_least(frame, 3).collect()} == {"b"}


def test_standardise(spark):
    x = noise(50)
    x[:, 1] = 2
    frame = frame_of(spark, [("py", True, r) for r in x])
    for by in ((), ("file_ext",)):
        rows = st.standardise(frame, FEATURES, by).orderBy("hash").collect()
        found = np.array([[r[f] for f in FEATURES] for r in rows])
        deviation = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
        assert found == pytest.approx((x - x.mean(axis=0)) / deviation, abs=1e-9)
