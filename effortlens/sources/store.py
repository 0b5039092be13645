"""Parquet tables that hold mods, blame rows, e-mail maps and scores between steps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effortlens.operators.refresh import MOD_KEY, PLACE, placed, rows_at, unseen_by_month, with_commit_time
from effortlens.schema import BLAME, EMAIL_MAP
from effortlens.session import fresh_path, materialise, run_folder, settle

# Bytes of staged files that one task packs into a file of its month, of about half the size.
FILE_BYTES = 64 << 20
# Months that a task keeps open files of, and that a write packs; rows of further months are sorted and shuffled.
OPEN_MONTHS = 200


# How staged files are written: they are read once, and a dictionary for each month's few rows of a task takes half of the time.
STAGED = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"}

# Open files in place of a sort of whole rows by month; a union of coalesced months keeps a task for each.
WRITE_SETTINGS = {
    "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_MONTHS),
    "spark.sql.unionOutputPartitioning": "false",
}


@contextmanager
def _write_settings(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in WRITE_SETTINGS}
    for name, value in WRITE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _text_months(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == "committed_month" else f for f in schema]
    )


class ModStore:
    """The mods and blame rows of one repository.

    Mods are partitioned by commit month, so that a date range and a refresh
    read only the months they need.
    """

    def __init__(self, spark: SparkSession, root: str, repository: str):
        self.spark = spark
        self.path = f"{root}/{repository.lower()}_index"
        self.blame_path = f"{root}/{repository.lower()}_blame_index"

    def _staged(self, mods: DataFrame) -> DataFrame:
        """Mods with their commit time in files by month, each task's its own: written as columns, not shuffled as rows."""
        spark, timed = mods.sparkSession, with_commit_time(mods)
        path = fresh_path(spark, "by-month")
        with _write_settings(spark):
            timed.write.partitionBy("committed_month").options(**STAGED).parquet(path)
        return spark.read.schema(_text_months(timed.schema)).parquet(path)

    def _pack(self, staged: DataFrame, files: list[Row], mode: str, rest: DataFrame | None = None) -> None:
        """Write staged files, those of a month in as few tasks as their bytes fill, and `rest`, shuffled by month."""
        months: dict[str | None, list[Row]] = {}
        for file in files:
            months.setdefault(file["committed_month"], []).append(file)
        size = {m: sum(f["file_size"] for f in of) for m, of in months.items()}
        largest = sorted(months, key=lambda m: -size[m])
        month, name = F.col("committed_month"), F.col("_metadata.file_path")
        parts = []
        for m in largest[:OPEN_MONTHS]:
            rows = staged.where(month.isNull() if m is None else month == m)
            named = rows.where(name.isin([f["_file"] for f in months[m]]))
            parts.append(named.coalesce(max(1, math.ceil(size[m] / FILE_BYTES))))
        small = [f["_file"] for m in largest[OPEN_MONTHS:] for f in months[m]]
        if small:
            parts.append(staged.where(name.isin(small)).hint("rebalance", "committed_month"))
        if rest is not None:
            parts.append(rest.hint("rebalance", "committed_month"))
        while len(parts) > 1:  # in pairs: a chain would be analysed anew with each part
            parts = [reduce(DataFrame.unionByName, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        whole = parts[0] if parts else staged.limit(0)
        with _write_settings(whole.sparkSession):
            whole.write.mode(mode).partitionBy("committed_month").parquet(self.path, compression="zstd")

    def _write(self, mods: DataFrame, mode: str) -> None:
        with run_folder(mods.sparkSession, "store-write"):
            staged = self._staged(mods)
            self._pack(staged, _files(staged), mode)

    def create(self, mods: DataFrame, blame: DataFrame | None = None) -> None:
        """Replace both tables."""
        self._write(mods, "overwrite")
        if blame is not None:
            blame.write.mode("overwrite").parquet(self.blame_path)

    def append(self, mods: DataFrame, blame: DataFrame | None = None) -> None:
        self._write(mods, "append")
        if blame is not None:
            blame.write.mode("append").parquet(self.blame_path)

    def mods(self) -> DataFrame:
        declared = _text_months(self.spark.read.parquet(self.path).schema)
        return self.spark.read.schema(declared).parquet(self.path)

    def blame(self) -> DataFrame:
        """Blame rows, each once; none if none were ever stored."""
        try:
            return self.spark.read.parquet(self.blame_path).distinct()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], BLAME)

    def exists(self) -> bool:
        """Whether mods were ever stored here."""
        try:
            self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def refresh(self, new: DataFrame, blame: DataFrame | None = None) -> None:
        """Append the mods that are not stored yet, each once; if there are none, no file is written.

        Keys, a hash and places of the new mods are compared. Files whose rows are all unseen and have
        hashes of their own are packed as they are; whole rows are compared, and shuffled, only of other files.
        """
        with run_folder(new.sparkSession, "store-refresh"):
            staged = self._staged(new)
            cells = F.xxhash64(*new.columns).alias("_cells")
            rows = placed(staged).select(*MOD_KEY, "committed_date", "committed_month", cells, *PLACE)
            left = unseen_by_month(self.mods(), rows).select("_cells", *PLACE)
            left = materialise(left, "unseen", compression="zstd")
            alike, small = settle(left.groupBy("_cells").count().where("count > 1").select("_cells"), "alike")
            twice = left.join(F.broadcast(alike) if small else alike, "_cells", "left_semi")
            doubtful = {r["_file"] for r in twice.select("_file").distinct().collect()}
            kept = {r["_file"]: r["count"] for r in left.groupBy("_file").count().collect()}
            whole = [f for f in _files(staged) if kept.get(f["_file"]) == f["count"] and f["_file"] not in doubtful]
            mixed = sorted(set(kept) - {f["_file"] for f in whole})
            rest = rows_at(staged, left, mixed).dropDuplicates() if mixed else None
            if whole or mixed:
                self._pack(staged, whole, "append", rest)
        if blame is not None:
            blame.write.mode("append").parquet(self.blame_path)


def _files(staged: DataFrame) -> list[Row]:
    """Month, name, bytes and rows of each staged file."""
    name, size = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size")
    return staged.groupBy("committed_month", name, size.alias("file_size")).count().collect()


def save_email_map(emails: DataFrame, path: str) -> None:
    emails.select(EMAIL_MAP.fieldNames()).write.mode("overwrite").parquet(path)


def load_email_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMAIL_MAP).parquet(path)


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    """Saved scores; extensions stay text, also those that look like numbers."""
    schema = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == "file_ext" else f for f in schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def save_scores(scored: DataFrame, path: str, append: bool = False) -> None:
    """All extensions in one write, a folder per extension. `append` adds a second run's rows again.

    Rows of extensions that have more than one in `OPEN_MONTHS` rows are written by the tasks that hold them; only
    those of rarer ones are shuffled, so that a task does not leave a file of some rows for each.
    """
    with run_folder(scored.sparkSession, "scores-write"):
        counts = materialise(scored.groupBy("file_ext").agg(F.count("*").alias("n_rows")), "rows-per-extension")
        total = counts.agg(F.sum("n_rows")).first()[0] or 0
        often = counts.where(F.col("file_ext").isNotNull() & (F.col("n_rows") * OPEN_MONTHS > total)).collect()
        common = F.coalesce(F.col("file_ext").isin([r["file_ext"] for r in often]), F.lit(False))
        spread = scored.where(common)
        if sum(r["n_rows"] for r in often) < total or not total:
            spread = spread.unionByName(scored.where(~common).hint("rebalance", "file_ext"))
        with _write_settings(scored.sparkSession):
            writer = spread.write.mode("append" if append else "overwrite").partitionBy("file_ext")
            writer.parquet(path, compression="zstd")
