"""What queries over mods join, shuffle and write."""

import glob
import os

from effortlens.operators import statistics as st
from effortlens.plans import catalog as ct
from effortlens.plans import fixtures as fx
from effortlens.plans import jobs
from effortlens.schema import FEATURES
from effortlens.sources import csv as csv_files
from effortlens.sources import json as json_files
from effortlens.sources import store as stores

NUMBER = 200


def _tables(spark, folder):
    """Lines of orders, some of them without an order, a part, a supplier or a customer."""
    day = "timestamp'1996-03-05'"
    spark.range(NUMBER).selectExpr(
        "if(id = 7, null, id div 4) as l_orderkey", "id % 9 as l_partkey", "id % 5 as l_suppkey", "cast(id % 4 + 1 as int) as l_linenumber",
        "cast(id % 50 + 1 as double) as l_quantity", "0.05D as l_discount", "0.02D as l_tax", "if(id % 3 = 0, 'A', 'N') as l_returnflag",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(45).selectExpr(
        "id as o_orderkey", "id % 6 as o_custkey", "if(id % 4 = 0, 'P', 'O') as o_orderstatus", f"{day} as o_orderdate", "'1-URGENT' as o_orderpriority"
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(8).selectExpr("id as p_partkey", "'red bolt' as p_name", "'Brand#1' as p_brand", "cast(id as int) as p_size").write.parquet(f"{folder}/part.parquet")
    spark.range(4).selectExpr("id as s_suppkey", "concat('S', id) as s_name").write.parquet(f"{folder}/supplier.parquet")
    spark.range(5).selectExpr("id as c_custkey", "concat('C#', id) as c_name").write.parquet(f"{folder}/customer.parquet")
    return folder


def test_mods_count_files_only_where_asked(spark, tmp_path):
    folder = _tables(spark, str(tmp_path))
    narrow = fx.mods(spark, folder).select("hash", "file_name")
    assert "Aggregate" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    lines = [r for r in range(NUMBER) if r != 7 and r // 4 < 45 and r % 9 < 8 and r % 5 < 4 and (r // 4) % 6 < 5]
    rows = fx.mods(spark, folder).select("hash", "file_name", "number_of_mod_files").collect()
    assert len(rows) == len(lines) == narrow.count()
    assert {(r["hash"], r["number_of_mod_files"]) for r in rows} == {(f"c{r // 4}", 3 if r // 4 == 1 else 4) for r in lines}


def test_scores_join_the_mods_once(spark, tmp_path, monkeypatch):
    folder = _tables(spark, str(tmp_path))
    joined = []
    monkeypatch.setattr(fx, "features", lambda *a, whole=fx.features: joined.append(1) or whole(*a))
    for name in ("assign_clusters", "centroids", "score_min_rows", "drop_unclustered"):
        joined.clear()
        found = ct.QUERIES[name](spark, folder)
        assert len(joined) == 1
        scans = {os.path.basename(os.path.dirname(f)) for f in found.inputFiles()}
        assert not any(s in ("lineitem.parquet", "orders.parquet") for s in scans)


def test_compressed_text_files_come_back(spark, tmp_path):
    folder = _tables(spark, str(tmp_path))
    mods = fx.mods_with_ext(spark, folder)
    plain, packed, cells = (str(tmp_path / n) for n in ("plain", "packed", "cells"))
    json_files.write_mods_json(mods, plain)
    json_files.write_mods_json(mods, packed, compression="gzip")
    csv_files.write_csv(mods, cells, compression="gzip")
    size = lambda path, end: sum(os.path.getsize(f) for f in glob.glob(f"{path}/*{end}"))
    assert 0 < size(packed, ".json.gz") < size(plain, ".json") / 5 and size(cells, ".csv.gz")
    given = sorted(map(str, mods.select("hash", "file_name", "merge_commit", "dmm_unit_size").collect()))
    for back in (json_files.read_mods_json(spark, packed, lines=True), csv_files.read_mods_csv(spark, cells)):
        assert sorted(map(str, back.select("hash", "file_name", "merge_commit", "dmm_unit_size").collect())) == given


def test_parts_are_joined_last(spark, tmp_path):
    folder = _tables(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx.mods(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert "p_partkey" in joins[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blame_is_worked_out_once(spark, tmp_path, monkeypatch):
    folder, written = _tables(spark, str(tmp_path)), []
    monkeypatch.setattr(ct, "materialise", lambda df, name, whole=ct.materialise, **o: written.append(name) or whole(df, name, **o))
    found = ct.QUERIES["blame_store"](spark, folder)
    assert written == ["blame"]
    given = [tuple(r) for r in fx.blame(spark, folder).collect()]
    assert given and sorted(map(tuple, found.collect())) == sorted(given)


def test_common_extensions_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    frame = spark.range(1000).selectExpr("if(id < 990, 'py', if(id < 993, null, concat('x', id))) as file_ext", "id").repartition(3)
    hinted, path = [], str(tmp_path / "scores")
    monkeypatch.setattr(type(frame), "hint", lambda df, *a, whole=type(frame).hint: hinted.append(df.count()) or whole(df, *a))
    stores.save_scores(frame, path)
    assert hinted == [10]
    key = lambda r: (r["id"], r["file_ext"])
    assert sorted(map(key, stores.load_scores(spark, path).collect())) == sorted(map(key, frame.collect()))
    hinted.clear()
    stores.save_scores(frame.where("id < 990"), path)
    assert hinted == [] and stores.load_scores(spark, path).count() == 990


def test_least_effort_of_gzip_comes_back(spark, tmp_path):
    mods = fx.mods_with_ext(spark, _tables(spark, str(tmp_path)))
    csv_files.write_csv(mods, str(tmp_path / "fast"), compression="gzip", fast=True)
    back = csv_files.read_mods_csv(spark, str(tmp_path / "fast"))
    assert sorted(map(str, back.select("hash", "file_name").collect())) == sorted(map(str, mods.select("hash", "file_name").collect()))


def test_training_set_reads_the_mods_once_and_shuffles_rows_once(spark, monkeypatch):
    rows = [("py", f"h{i}", "a", True, f"f{i}.py", *[float((i * p) % 17) for p in (1, 2, 3, 5, 7, 11)]) for i in range(80)]
    names = ["file_ext", "hash", "Author", "language_supported", "file_name", *FEATURES]
    frame = spark.createDataFrame(rows, names)
    hinted, written = [], []
    monkeypatch.setattr(type(frame), "hint", lambda df, *a, whole=type(frame).hint: hinted.append(a) or whole(df, *a))
    monkeypatch.setattr(st, "materialise", lambda df, name, whole=st.materialise, **o: written.append(name) or whole(df, name, **o))
    found = st.training_set(frame)
    assert hinted == [("rebalance", "file_ext")] and written == ["features", "training"]
    assert found.count() == 80 and found.agg({"scaled_total_changed": "max"}).first()[0] == 1.0
    assert not any("LocalTableScan" in line or "ExistingRDD" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines())


def test_scored_files_are_compressed(spark, tmp_path, monkeypatch):
    mods = fx.mods_with_ext(spark, _tables(spark, str(tmp_path)))
    monkeypatch.setattr(jobs, "score", lambda read, root: read)
    csv_files.write_csv(mods, str(tmp_path / "in"))
    jobs.score_file(spark, str(tmp_path / "in"), str(tmp_path / "out"), "none", compression="gzip")
    jobs.score_file(spark, str(tmp_path / "in"), str(tmp_path / "plain"), "none")
    assert glob.glob(f"{tmp_path}/out/*.csv.gz") and glob.glob(f"{tmp_path}/plain/*.csv") and not glob.glob(f"{tmp_path}/out/*.csv")
    assert csv_files.read_mods_csv(spark, str(tmp_path / "out")).count() == mods.count()
