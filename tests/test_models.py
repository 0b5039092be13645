import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effortlens.operators import classifier as cl
from effortlens.operators import mixture as mx
from effortlens.operators import scoring as sc
from effortlens.operators import statistics as st
from effortlens.plans import fixtures, jobs
from effortlens.schema import FEATURES, MIXTURE, NO_MODEL
from effortlens.session import fresh_path, materialise
from effortlens.sources import models as files


def density(x, mean, covariance):
    away = x - mean
    inverse = np.linalg.inv(covariance)
    _, log_det = np.linalg.slogdet(covariance)
    distance = np.einsum("ni,ij,nj->n", away, inverse, away)
    return -0.5 * (distance + log_det + len(mean) * math.log(2 * math.pi))


def brute_force_mixture(x, centres, k, tolerance=1e-3, floor=1e-6, iterations=100):
    """Expectation and maximisation written out on one machine."""
    nearest = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    shares, bound = np.eye(k)[nearest], -np.inf
    for turn in range(iterations + 1):
        weights = shares.sum(axis=0)
        means = shares.T @ x / weights[:, None]
        covariances = [
            (shares[:, c, None] * (x - means[c])).T @ (x - means[c]) / weights[c] + floor * np.eye(x.shape[1])
            for c in range(k)
        ]
        if turn and abs(new_bound - bound) < tolerance:
            break
        if turn:
            bound = new_bound
        logs = np.array(
            [math.log(weights[c] / len(x)) + density(x, means[c], covariances[c]) for c in range(k)]
        ).T
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        shares, new_bound = np.exp(logs - total[:, None]), total.mean()
    return weights / len(x), means, covariances


@pytest.fixture(scope="module")
def blobs(spark):
    """Two extensions, each with three groups of points, some of them equal."""
    random = np.random.default_rng(3)
    rows, points = [], {}
    for ext, shift in (("py", 0.0), ("js", 5.0)):
        x = np.vstack([random.normal(shift + 4 * c, 0.5 + c, (150, 6)) for c in range(3)])
        x[:40] = x[0]
        points[ext] = x
        rows += [(ext, f"{ext}{i}", *map(float, r)) for i, r in enumerate(x)]
    schema = "file_ext string, hash string, " + ", ".join(f"{f} double" for f in FEATURES)
    frame = materialise(st.scale_minmax(spark.createDataFrame(rows, schema)), "blobs", by="file_ext")
    return frame, points


def test_mixture_equals_brute_force(spark, blobs, monkeypatch):
    frame, points = blobs
    centres = {}
    start = mx._start

    def remember(*args):
        centres.update(start(*args))
        return centres

    monkeypatch.setattr(mx, "_start", remember)
    found = mx.fit_mixtures(frame, k=3).collect()
    for ext, x in points.items():
        scaled = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
        weights, means, covariances = brute_force_mixture(scaled, centres[ext], 3)
        rows = sorted((r for r in found if r.file_ext == ext), key=lambda r: r.cluster)
        assert [r.weight for r in rows] == pytest.approx(weights, abs=1e-6)
        assert np.array([r["mean"] for r in rows]) == pytest.approx(means, abs=1e-6)
        for row, covariance in zip(rows, covariances):
            assert np.array(row.covariance).reshape(6, 6) == pytest.approx(covariance, abs=1e-6)


def test_posteriors_equal_brute_force_in_any_slicing(spark, blobs, monkeypatch):
    frame, points = blobs
    mixture = materialise(mx.fit_mixtures(frame, k=3, max_iterations=3), "mixture")
    raw = frame.select("file_ext", "hash", *FEATURES)
    parts = {(r.file_ext, r.cluster): r for r in mixture.collect()}
    for at_once in (10_000, 1):
        monkeypatch.setattr(mx, "MODELS_AT_ONCE", at_once)
        rows = mx.assign_clusters(raw, mixture, k=3).collect()
        assert len(rows) == 900
        for ext, x in points.items():
            scaled = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
            logs = np.array(
                [
                    math.log(parts[ext, c].weight)
                    + density(
                        scaled, np.array(parts[ext, c]["mean"]), np.array(parts[ext, c].covariance).reshape(6, 6)
                    )
                    for c in range(3)
                ]
            ).T
            wanted = np.exp(logs - logs.max(axis=1, keepdims=True))
            wanted /= wanted.sum(axis=1, keepdims=True)
            mine = {r.hash: r for r in rows if r.file_ext == ext}
            found = np.array([mine[f"{ext}{i}"].posteriors for i in range(len(x))])
            assert found == pytest.approx(wanted, abs=1e-6)
            assert [mine[f"{ext}{i}"].cluster for i in range(len(x))] == list(wanted.argmax(axis=1))


def test_a_vanished_cluster_has_no_share(spark):
    half = [0.0] * 6
    eye = [float(i == j) for i in range(6) for j in range(i + 1)]
    full = [float(i == j) for i in range(6) for j in range(6)]
    mixture = spark.createDataFrame(
        [("py", 0, 0.5, half, full, eye, 0.0), ("py", 2, 0.5, half, full, eye, 0.0)], MIXTURE
    )
    frame = spark.createDataFrame(
        [("py", "a", 0, *[1.0] * 6), ("py", "b", 1, *[2.0] * 6), ("md", "c", None, *[2.0] * 6), (None, "d", 0, *[2.0] * 6)],
        "file_ext string, hash string, cluster_id int, " + ", ".join(f"{f} double" for f in FEATURES),
    )
    rows = {r.hash: r for r in sc.score_mods(frame, mixture, k=3).collect()}
    assert rows["a"].probablities == pytest.approx(0.5)
    assert rows["a"].sum_centroid == pytest.approx(6.0)
    assert rows["a"].mod_score == pytest.approx(3.0)
    assert (rows["b"].predicted_cluster, rows["b"].probablities) == ("1", 0.0)
    for name in "cd":
        assert rows[name].predicted_cluster == NO_MODEL
        assert (rows[name].probablities, rows[name].sum_centroid, rows[name].mod_score) == (0, 0, 0)


def test_the_split_is_stable_and_takes_a_quarter(spark):
    frame = spark.range(4000).select(
        F.col("id").cast("string").alias("hash"), *[F.col("id").cast("double").alias(f) for f in FEATURES]
    )
    first = {r.hash for r in frame.where(cl.is_test_row()).collect()}
    again = {r.hash for r in frame.repartition(9).where(cl.is_test_row()).collect()}
    assert first == again and 0.22 < len(first) / 4000 < 0.28


def labelled_rows(spark, n=900):
    """Two extensions; the label is the quadrant of two features, which no single split tells."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (2 * n, 6))
    label = (x[:, 0] > 0) * 2 + (x[:, 3] > 0)
    rows = [("py" if i < n else "c", f"h{i}", int(label[i]) + 1, *map(float, x[i])) for i in range(2 * n)]
    return spark.createDataFrame(rows, "file_ext string, hash string, cluster int, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_classifiers_learn_products_of_features(spark, kind):
    frame = labelled_rows(spark)
    fitted = cl.settled_models(cl.fit_classifiers(frame, kind, rounds=20, depth=4))
    rows = {r.file_ext: r for r in fitted.collect()}
    assert {e: r.n_rows for e, r in rows.items()} == {"py": 900, "c": 900}
    assert all(r.accuracy > 0.9 and r.classes == [1, 2, 3, 4] for r in rows.values())
    other = frame.limit(1).withColumn("file_ext", F.lit("md")).unionByName(frame.limit(1).withColumn("file_ext", F.lit(None)))
    predicted = cl.predict_clusters(frame.unionByName(other), fitted)
    assert predicted.where("file_ext in ('py', 'c')").where("cluster_id = cluster").count() > 1700
    assert predicted.where("cluster_id is null").count() == 2
    assert cl.predict_clusters(frame, fitted.limit(0)).where("cluster_id is not null").count() == 0


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_train_save_and_score(spark, sf_dir, kind):
    root = fresh_path(spark, "models")
    some = fixtures.mods_with_ext(spark, sf_dir).where("file_ext in ('py', 'c++', 'md')")
    mods = materialise(some, "mods")
    jobs.train(mods, root, kind=kind, max_iterations=5)
    listed = {r.file_ext: r for r in files.registry(spark, root).collect()}
    assert set(listed) == {"py", "c++"}
    assert all(r.kind == kind and r.n_rows > 500 and 0.5 < r.accuracy <= 1 for r in listed.values())

    weights = files.load_mixture(spark, root).groupBy("file_ext").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in weights)

    scored = materialise(jobs.score(mods, root), "scored")
    assert scored.count() == mods.count()
    for row in scored.groupBy("file_ext").agg(
        F.max("mod_score").alias("top"),
        F.min("probablities").alias("low"),
        F.max("probablities").alias("high"),
        F.collect_set("predicted_cluster").alias("clusters"),
    ).collect():
        if row.file_ext in listed:
            assert 0 <= row.low <= row.high <= 1 + 1e-9 and row.top > 0
            assert set(row.clusters) <= set("01234")
        else:
            assert row.top == 0 and row.clusters == [NO_MODEL]

    trained = jobs.score(mods, root, scaler="training").agg(F.avg("mod_score")).first()[0]
    assert trained > 0
    assert jobs.score(mods, root, min_rows=10_000).count() == 0


def test_mixture_passes_take_blocks_of_one_extension(spark, blobs, monkeypatch):
    """A pass meets blocks, not rows; every row of an extension is in one of its blocks, null extensions in none."""
    frame, points = blobs
    monkeypatch.setattr(mx, "BLOCK_ROWS", 64)
    none = frame.limit(3).withColumn("file_ext", F.lit(None).cast("string"))
    rows = mx._blocks(frame.unionByName(none).coalesce(2)).collect()
    assert len(rows) < 40
    for ext, x in points.items():
        cells = [np.frombuffer(r.cells).reshape(6, -1) for r in rows if r.file_ext == ext]
        assert all(c.shape[1] <= 64 for c in cells)
        scaled = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
        assert np.sort(np.concatenate(cells, axis=1)[0]) == pytest.approx(np.sort(scaled[:, 0]), abs=1e-12)
    assert {r.file_ext for r in rows} == set(points)
    wanted, found = (mx.fit_mixtures(f, k=3, max_iterations=4).orderBy("file_ext", "cluster").collect() for f in (frame, frame.repartition(5)))
    for a, b in zip(wanted, found, strict=True):
        assert a["mean"] == pytest.approx(b["mean"], abs=1e-9) and a["covariance"] == pytest.approx(b["covariance"], abs=1e-9)
