"""Add only what a store does not hold yet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.functions.dates import instant

# What makes a mod the same mod. Paths may be null.
MOD_KEY = ("hash", "file_new_path", "file_old_path")

# Where a row read from files comes from.
PLACE = ("_file", "_row")


def with_commit_time(mods: DataFrame) -> DataFrame:
    """Add `committed_ts` and the store's partition column `committed_month`."""
    when = instant(F.col("committed_date"))
    return mods.withColumns(
        {"committed_ts": when, "committed_month": F.substring(F.col("committed_date"), 1, 7)}
    )


def near(store: DataFrame, new: DataFrame) -> DataFrame:
    """The stored mods of the months that the new rows span; with stored rows without a date, if new ones have none."""
    month, stored = F.substring(F.col("committed_date"), 1, 7), F.col("committed_month")
    low, high, undated = new.agg(F.min(month), F.max(month), F.count_if(month.isNull())).first()
    within = stored.between(low, high) if low is not None else F.lit(False)
    return store.where(within | stored.isNull() if undated else within)


def unseen(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` whose mod is not in `store`.

    A commit keeps its date for ever, so only the months of the new rows are
    compared: the store's other partitions are not read. Rows without a date are
    compared with stored rows without one.
    """
    if "committed_month" in store.columns:
        store = near(store, new)
    known = store.select(*MOD_KEY).distinct()
    same = reduce(lambda a, b: a & b, (new[k].eqNullSafe(known[k]) for k in MOD_KEY))
    return new.join(known, same, "left_anti")


def unseen_by_month(store: DataFrame, new: DataFrame) -> DataFrame:
    """As `unseen`, for a store and new rows that both have `committed_month`.

    Rows of months that the store does not hold are not shuffled for it, unless a commit among them is stored under another month.
    """
    store = near(store, new)
    months = [r["committed_month"] for r in store.select("committed_month").distinct().collect()]
    month = F.col("committed_month")
    held = F.coalesce(month.isin([m for m in months if m is not None]), F.lit(None in months))
    known, late = store.select(*MOD_KEY), new.where(~held)
    commits, stored = late.select("hash").distinct(), known.select("hash").distinct()
    if not commits.join(stored, commits["hash"].eqNullSafe(stored["hash"]), "left_semi").isEmpty():
        return unseen(known, new)
    return unseen(known, new.where(held)).unionByName(late)


def refreshed(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the unseen rows added."""
    return store.unionByName(unseen(store, new))


def placed(rows: DataFrame) -> DataFrame:
    """Rows read from Parquet files with their file and their number in it."""
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def rows_at(rows: DataFrame, places: DataFrame, files: list[str]) -> DataFrame:
    """The rows of `files` that are at the given places. Only these files are read and shuffled."""
    found = placed(rows.where(F.col("_metadata.file_path").isin(files)))
    return found.join(places.select(*PLACE), [*PLACE], "left_semi").drop(*PLACE)
