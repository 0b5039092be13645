"""Keep a mod store up to date from a folder of new mods."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from effortlens.operators.refresh import MOD_KEY, PLACE, placed, rows_at
from effortlens.sources.store import ModStore

# How long a mod that has arrived is remembered in the stream's state.
MEMORY = "7 days"


def read_mod_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of mods as they arrive, with the schema of `like`.

    The frame itself, not what is derived from it, remembers its folder: `start_refresh` then streams places of mods.
    """
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    if not re.search(r"[*?\[\]{}\\]", folder):
        stream._mod_folder = folder
    return stream


def first_arrivals(new: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Each mod once, however often it arrives within `memory`.

    Time is that of arrival, so no commit is too old to be taken: a watermark on commit
    dates would drop them. A repeat is the same mod with the same cells; what is kept
    of it is its key and a hash. What comes again later than `memory` passes.
    """
    timed = new.withColumns({"_cells": F.xxhash64(*new.columns), "_arrived": F.current_timestamp()})
    return _first(timed, memory).select(*new.columns)


def first_places(new: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Where each mod that `first_arrivals` gives stands in its file: only keys, a hash and places are shuffled."""
    timed = placed(new).withColumns({"_cells": F.xxhash64(*new.columns), "_arrived": F.current_timestamp()})
    return _first(timed.select(*MOD_KEY, "_cells", *PLACE, "_arrived"), memory).select(*PLACE)


def _first(timed: DataFrame, memory: str) -> DataFrame:
    return timed.withWatermark("_arrived", memory).dropDuplicatesWithinWatermark([*MOD_KEY, "_cells"])


def mods_at(places: DataFrame, schema: T.StructType, folder: str) -> DataFrame:
    """The mods at the given places of files of a folder; files of which all rows are asked for are read as they are."""
    name = F.col("_metadata.file_path")
    kept = {r["_file"]: r["count"] for r in places.groupBy("_file").count().collect()}
    reader = places.sparkSession.read.schema(schema)
    rows = reader.option("basePath", folder).parquet(*[unquote(f) for f in sorted(kept)])
    held = {r["_file"]: r["count"] for r in rows.groupBy(name.alias("_file")).count().collect()}
    part = sorted(f for f in kept if kept[f] != held[f])
    whole = rows.where(~name.isin(part)) if part else rows
    return whole.unionByName(rows_at(rows, places, part)) if part else whole


def start_refresh(new: DataFrame, store: ModStore, checkpoint: str, memory: str = MEMORY) -> StreamingQuery:
    """Add each micro-batch's unseen mods to the store; a repeated batch adds nothing.

    Repeats within `memory` are dropped by the state; a batch of nothing else does not touch the store.
    Mods of `read_mod_stream` stay in their files until their batch is stored; the stream carries their places.
    """
    folder, schema = vars(new).get("_mod_folder"), new.schema

    def add(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if not held.isEmpty():
                store.refresh(held if folder is None else mods_at(held, schema, folder))
        finally:
            held.unpersist()

    return (
        (first_arrivals if folder is None else first_places)(new, memory)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
