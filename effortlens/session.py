"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",
}

_local_dirs: dict[str, str] = {}


def spark_session(app: str = "effortlens", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    settings = {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    A local session without that setting gets a temporary folder; a cluster
    session without it is refused, since a machine-local folder would be lost
    together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="effortlens-")
    return _local_dirs[context.applicationId]


_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables written inside go to one folder, which is removed at the end.

    For jobs that end with a written result. A nested job uses the outer folder.
    """
    if _run_folder.get() is not None:
        yield
        return
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _run_folder.set(path)
    try:
        yield
    finally:
        _run_folder.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet, under the shared folder."""
    return f"{_run_folder.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(
    df: DataFrame, name: str, by: str | None = None, compression: str = "snappy", spread: bool = False
) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives Catalyst
    the true size of the table. With `by`, the files are laid out per value of
    that column; the rebalance hint splits a value that holds many rows over
    several files and packs rare values together. Rows that are `spread` that way already are written as they are.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if by is None:
        df.write.parquet(path, compression=compression)
    else:
        (df if spread else df.hint("rebalance", by)).write.partitionBy(by).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


# Blocks of rows that Python gets at once, some hundred kilobytes each.
BLOCKS_AT_ONCE = 16


@contextmanager
def few_at_once(spark: SparkSession, most: int = BLOCKS_AT_ONCE) -> Iterator[None]:
    """Jobs inside hand Python `most` rows at once: where a row is a block of rows, Spark's usual number is all of a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    usual = int(before)
    spark.conf.set(name, str(most if usual <= 0 else min(most, usual)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# What a broadcast or the driver may hold of one settled table.
SMALL_ROWS = 50_000
SMALL_BYTES = 32 << 20


def settle(df: DataFrame, name: str, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> tuple[DataFrame, bool]:
    """Compute a table that is expected to be small, once, and tell whether it is.

    It is written to the shared folder; rows and bytes of what was written are
    measured under a limit, never assumed.
    """
    table = materialise(df, name)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n_rows, n_bytes = table.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return table, n_rows <= max_rows and n_bytes <= max_bytes
