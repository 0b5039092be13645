import pytest
from pyspark.sql import functions as F

from effortlens import session
from effortlens.operators import joins, privacy
from effortlens.operators.joins import join_lookup
from effortlens.operators.ordering import running_positions
from effortlens.plans import fixtures
from effortlens.session import materialise, settle


@pytest.mark.parametrize("max_rows", [1000, 5, 2, 1])
def test_lookup_equals_a_plain_left_join(spark, max_rows):
    keys = ["hot"] * 300 + [None] * 200 + [f"k{i % 40}" for i in range(400)] + ["unknown"] * 50
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int")
    lookup = spark.createDataFrame(
        [("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 40, 2)], "key string, value double"
    )
    wanted = sorted(map(str, big.join(lookup, ["key"], "left").select("key", "i", "value").collect()))
    found = join_lookup(big, lookup, ["key"], max_rows).select("key", "i", "value")
    assert sorted(map(str, found.collect())) == wanted


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_columns_have_one_order_at_every_size(spark, max_rows):
    big = spark.createDataFrame([("x", i, f"k{i % 3}") for i in range(9)], "a string, i int, k string")
    lookup = spark.createDataFrame([(float(i), f"k{i}") for i in range(3)], "v double, k string")
    found = join_lookup(big, lookup, ["k"], max_rows)
    assert found.columns == ["a", "i", "k", "v"]
    assert all(r.v == r.i % 3 for r in found.collect())


def test_e_mails_come_back_in_one_order_at_every_size(spark, sf_dir, monkeypatch):
    hidden, emails = privacy.anonymise(fixtures.mods(spark, sf_dir))
    near = privacy.de_anonymise(hidden, emails)
    monkeypatch.setattr(privacy, "join_lookup", lambda b, l, k: join_lookup(b, l, k, max_rows=10))
    far = privacy.de_anonymise(hidden, emails)
    assert near.columns == far.columns == [*hidden.columns, "Email"]
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))


def test_a_wide_lookup_is_not_broadcast(spark):
    wide = spark.range(40).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1_000_000).alias("v"))
    table, small = settle(wide, "wide")
    assert not small and table.count() == 40


def test_a_hot_key_is_dealt_to_several_tasks(spark):
    big = spark.range(0, 30_000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    lookup = big.select("k").distinct().withColumn("v", F.length("k"))
    joined = join_lookup(big, lookup, ["k"], max_rows=20)
    assert joined.where("v = length(k)").count() == 30_000


def test_heavy_keys_are_found_among_many_rare_ones(spark):
    """Hot keys, the null key too, lie in buckets found, with what they fill; rare ones fill none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.col("id").cast("string"))
    big = spark.range(0, 200_000, numPartitions=8).select(key.alias("k"), "id")
    bucket_of = lambda k: spark.createDataFrame([(k,)], "k string").select(joins._bucket(["k"])).first()[0]
    found = lambda frame, share: {r._bucket: r._parts for r in joins.heavy_buckets(frame, ["k"], share).collect()}
    assert found(big, 10) == {bucket_of("hot"): 4}
    assert set(found(big, 100)) == {bucket_of("hot"), bucket_of(None)}
    assert found(big.limit(0), 100) == {}


def test_a_large_lookup_writes_nothing_as_long_as_the_rows(spark, monkeypatch):
    written = {}

    def write(df, name, by=None):
        written[name] = materialise(df, name, by)
        return written[name]

    monkeypatch.setattr(session, "materialise", write)
    monkeypatch.setattr(joins, "materialise", write)
    monkeypatch.setattr(joins, "BUCKETS", 64)
    big = spark.range(3_000).select((F.col("id") % 700).alias("k"), "id")
    lookup = big.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = joins.join_lookup(big, lookup, ["k"], max_rows=50)
    assert joined.where("v = 2 * k").count() == 3_000
    assert {n: t.count() for n, t in written.items()} == {"lookup": 700, "key-buckets": 64}


def test_two_keys(spark):
    big = spark.range(100).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), "id")
    lookup = big.select("a", "b").distinct().withColumn("v", F.col("a") * 10 + F.col("b"))
    for max_rows in (100, 3):
        rows = join_lookup(big, lookup, ["a", "b"], max_rows).collect()
        assert len(rows) == 100 and all(r.v == r.a * 10 + r.b for r in rows)


def test_positions_equal_a_global_sort(spark):
    rows = [(i, i % 3, 0.5 if i % 2 else (i * 37 % 101) / 101) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, cluster int, s double")
    found = running_positions(frame.repartition(7), "cluster", "s", "id", gap=10, start=10).collect()
    place = 10
    for cluster in range(3):
        mine = sorted((r for r in found if r.cluster == cluster), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r.position for r in mine] == list(range(place + 1, place + len(mine) + 1))
        assert [r.s for r in mine] == sorted(r.s for r in mine)
        place += len(mine) + 10
    assert len(found) == 500
