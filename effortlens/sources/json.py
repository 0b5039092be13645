"""Mod tables as JSON: an array of records, or one record per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from effortlens.schema import COMMIT, EDGE_NAMES, MOD

_BACK = {edge: name for name, edge in EDGE_NAMES.items()}


def read_mods_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Mods from JSON. With `lines` a file holds one record per line and can be split."""
    edge = T.StructType([T.StructField(EDGE_NAMES.get(f.name, f.name), f.dataType) for f in MOD.fields])
    return spark.read.schema(edge).option("multiLine", not lines).json(path).withColumnsRenamed(_BACK)


def write_mods_json(mods: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """One record per line. `gzip` takes a fraction of the disk, as every record names its columns; a file of it is not split."""
    mods.withColumnsRenamed(EDGE_NAMES).write.mode(mode).json(path, compression=compression)


def read_commits_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Nested commits from JSON, the input of `explode_commits`."""
    return spark.read.schema(COMMIT).option("multiLine", not lines).json(path)
