import hashlib

import pytest
from compare import difference
from fixtures import DOC, clashing, documents, plain

from effortlens.llm import sharding
from effortlens.llm.queries import CHECKS, QUERIES


def bits(value):
    return f"{int(hashlib.md5(str('' if value is None else value).encode()).hexdigest()[:15], 16):060b}"


def brute(rows, limit):
    """Split buckets one at a time, as on insertion."""
    rows = [(bits(d) + bits(t), d, len((t or "").encode())) for d, t in rows]
    open_buckets, done = [""], []
    while open_buckets:
        prefix = open_buckets.pop()
        own = [r for r in rows if r[0].startswith(prefix)]
        if sum(r[2] for r in own) > limit and len(own) > 1 and len(prefix) < 120:
            open_buckets += [prefix + "0", prefix + "1"]
        else:
            done += [(r[1], prefix, len(prefix), len(own), sum(x[2] for x in own)) for r in own]
    return done


def found(docs, limit):
    return sharding.assign_shards(docs, limit).select("doc_id", "shard", "local_depth", "shard_rows", "shard_bytes").collect()


@pytest.mark.parametrize("limit", [100, 2_000, 10**9])
def test_equals_splitting_one_by_one(spark, limit):
    docs = documents(spark, extra=[(4, f"content {i} of the hot id" * 9, "", "", 0) for i in range(30)])
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], limit)
    assert plain(found(docs, limit)) == plain(wanted)
    assert plain(found(clashing(docs), limit)) == plain(wanted)
    assert max(len(r[1]) for r in wanted) > 60 or limit > 200


def test_equal_rows_may_exceed_the_limit_and_say_so(spark):
    docs = spark.createDataFrame([(1, "x" * 50, "", "", 0)] * 5 + [(2, None, "", "", 0)], DOC)
    rows = sharding.assign_shards(docs, 100).collect()
    assert {(r["doc_id"], r["shard_rows"], r["oversized"]) for r in rows} == {(1, 5, True), (2, 1, False)}


def test_no_rows(spark):
    assert sharding.assign_shards(spark.createDataFrame([], DOC)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, str(tmp_path / "shards"), 2_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert plain(back.select(docs.columns).collect()) == plain(docs.collect())
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 2_000)
    assert {r[0][1:] for r in back.select("__shard").distinct().collect()} == {w[1] for w in wanted}


def test_query_equals_its_sql(spark, sf_dir):
    name = "op1_extendible_sharding"
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, CHECKS[name]) is None
