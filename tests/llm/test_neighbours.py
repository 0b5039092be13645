import numpy as np
import pytest
from fixtures import clashing

from effortlens.llm import neighbours
from effortlens.llm.queries import QUERIES

VECTOR = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in queries:
        if q in rows:
            near = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, wanted):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in near}) / len(near) for q, near in wanted.items()])


def test_recall_and_scores_on_clustered_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (40, 16))
    data = (centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.25, (3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], VECTOR)
    got = found(neighbours.nearest(df, df.where("vec_id % 20 = 0"), sample_rows=1500))
    wanted = brute(list(enumerate(data)), range(0, 3000, 20))
    assert set(got) == set(wanted) and all(len(v) == 10 for v in got.values())
    assert recall(got, wanted) >= 0.9
    for q, near in got.items():
        assert near == sorted(near)
        for score, i in near:
            assert abs(score - float(np.sqrt(((data[i].astype(float) - data[q].astype(float)) ** 2).sum()))) < 1e-12


def test_an_index_routes_to_fewer_than_all_partitions():
    rng = np.random.default_rng(0)
    data = rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 2000)] + rng.normal(0, 0.2, (2000, 16))
    index = neighbours.fit_index(data)
    assert index.probes < 8
    sizes = np.bincount(index.ranked(data)[:, 0], minlength=16)
    assert sizes.max() < 0.3 * len(data)


def test_rows_that_take_no_part_ties_and_blocks(spark, monkeypatch):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(40, 0, -1)] + [(100 + i, [float(i), 0.5, 0.0], 0) for i in range(1, 12)]
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 3, 0), (203, [1.0, None, 2.0], 0), (204, [1.0, float("nan"), 0.0], 0),
           (205, [float("inf"), 1.0, 1.0], 0), (206, [1.0, 2.0], 0), (None, same, 0), (5, same, 0)]
    df = spark.createDataFrame(rows + odd, VECTOR)
    wanted = brute([(i, v) for i, v, _ in rows], [5, 30, 105, 200, 206])
    ask = lambda d: found(neighbours.nearest(d, d.where("vec_id in (5, 30, 105, 200, 204, 206)")))
    assert ask(df) == wanted
    assert ask(clashing(df)) == wanted
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    assert ask(df) == wanted
    assert wanted[5] == [(0.0, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10, 11)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0), (3, [4.0], 0)], VECTOR)
    assert found(neighbours.nearest(df, df)) == {1: [(1.0, 2), (3.0, 3)], 2: [(1.0, 1), (2.0, 3)], 3: [(2.0, 2), (3.0, 1)]}
    none = spark.createDataFrame([], VECTOR)
    assert neighbours.nearest(none, none).collect() == []
    assert neighbours.nearest(df, none).collect() == []


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_on_the_tables(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert recall(found(QUERIES["op2_learned_partitions"](spark, folder)), wanted) >= 0.9


def test_recall_on_a_larger_table(spark, tmp_path):
    """Twelve thousand rows around five hundred centres; every query is compared."""
    rng = np.random.default_rng(4)
    data = (rng.normal(0, 1, (500, 32))[rng.integers(0, 500, 12_000)] + rng.normal(0, 0.5, (12_000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    spark.createDataFrame([(*r, 0) for r in rows], VECTOR).write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = brute(rows, [i for i, _ in rows if i % 100 == 0])
    assert recall(found(QUERIES["op2_learned_partitions"](spark, str(tmp_path))), wanted) >= 0.9


def test_queries_of_almost_empty_partitions_probe_on(spark):
    """Of 70 rows 63 are copies of one vector; every query still gets ten neighbours."""
    data = np.random.default_rng(0).normal(0, 1, (70, 8))
    data[:63] = data[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data.astype(np.float32))], VECTOR)
    got = found(neighbours.nearest(df, df))
    assert {q: len(near) for q, near in got.items()} == dict.fromkeys(range(70), 10)
