"""What a streaming refresh carries of a mod."""

from pyspark.sql import functions as F

from test_store_moves import _rows, _spied, _stored

from effortlens.sources import store as stores
from effortlens.streaming import refresh as stream_refresh


def test_the_stream_carries_places_of_mods(spark, tmp_path, monkeypatch):
    store, seen = stores.ModStore(spark, str(tmp_path / "store"), "Demo"), _spied(monkeypatch, stream_refresh)
    store.create(_rows(spark, "2020-01", "a"))
    folder = str(tmp_path / "new mods")

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = stream_refresh.read_mod_stream(spark, folder, rows)
        assert "message" not in stream_refresh.first_places(stream).columns
        stream_refresh.start_refresh(stream, store, str(tmp_path / "state")).awaitTermination()
        return [r[0] for r in _stored(store)]

    assert arrive(_rows(spark, "2020-02", "b", "c")) == ["a", "b", "c"] and seen == []
    assert arrive(_rows(spark, "2020-02", "b", "d", "d").unionByName(_rows(spark, "2020-01", "a"))) == ["a", "b", "c", "d"] and seen == [1]


def test_a_derived_stream_is_stored_as_it_is(spark, tmp_path):
    store = stores.ModStore(spark, str(tmp_path / "store"), "Demo")
    store.create(_rows(spark, "2020-01", "a"))
    rows = _rows(spark, "2020-02", "b", "c")
    rows.write.parquet(str(tmp_path / "new"))
    stream = stream_refresh.read_mod_stream(spark, str(tmp_path / "new"), rows).where("hash = 'b'").withColumn("after", F.lit(5))
    stream_refresh.start_refresh(stream, store, str(tmp_path / "state")).awaitTermination()
    assert _stored(store) == [("a", "2020-01", 1, 0), ("b", "2020-02", 1, 5)]
