"""From nested commits to mods, and which commits to take."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.functions.dates import gmt_text, instant
from effortlens.functions.text import extension, line_count

ALL = "All"


def _length(array: str | Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)).cast("int")


def explode_commits(commits: DataFrame) -> DataFrame:
    """One row per modified file, the fields of its commit repeated, lists replaced by their lengths."""
    m = F.col("m")
    return commits.select("*", F.explode("modifications").alias("m")).select(
        "hash",
        F.col("author.name").alias("Author"),
        F.col("author.email").alias("Email"),
        F.col("msg").alias("message"),
        gmt_text(F.col("author_date").cast("timestamp").cast("string")).alias("authored_date"),
        F.col("committer.name").alias("Committer"),
        gmt_text(F.col("committer_date").cast("timestamp").cast("string")).alias("committed_date"),
        _length("branches").alias("number_of_branches"),
        "in_main_branch",
        F.col("merge").alias("merge_commit"),
        _length("modifications").alias("number_of_mod_files"),
        m["filename"].alias("file_name"),
        extension(m["filename"]).alias("file_ext"),
        m["change_type"]["name"].alias("file_change_type_name"),
        m["change_type"]["value"].alias("file_change_type_value"),
        m["old_path"].alias("file_old_path"),
        m["new_path"].alias("file_new_path"),
        _length(m["methods_before"]).alias("number_functions_before"),
        _length(m["methods"]).alias("number_functions_after"),
        _length(m["changed_methods"]).alias("number_functions_edited"),
        m["added"].alias("number_lines_added"),
        m["removed"].alias("number_lines_removed"),
        m["nloc"].alias("file_number_loc"),
        m["language_supported"].alias("language_supported"),
        line_count(m["source_code"]).alias("file_size"),
        "dmm_unit_size",
        "dmm_unit_complexity",
        "dmm_unit_interfacing",
        m["complexity"].alias("file_complexity"),
        m["token_count"].alias("tokens"),
    )


def commit_count(mods: DataFrame) -> DataFrame:
    return mods.agg(F.count_distinct("hash").alias("n_commits"))


def with_files_per_commit(mods: DataFrame) -> DataFrame:
    """Add `number_of_mod_files` to flat mods.

    The counts are pre-aggregated and joined back on the mod side's own
    shuffle, where adaptive execution can split a commit of any size.
    """
    counts = mods.groupBy("hash").agg(F.count("*").cast("int").alias("number_of_mod_files"))
    return mods.drop("number_of_mod_files").join(counts, "hash", "left")


def check_range(from_day: str | date, to_day: str | date) -> tuple[date, date]:
    """Both days are needed, and the first must come before the second."""
    if not from_day or not to_day:
        raise ValueError("both dates are needed")
    first, last = (d if isinstance(d, date) else date.fromisoformat(d) for d in (from_day, to_day))
    if first >= last:
        raise ValueError("the first date must come before the second")
    return first, last


def scan_range(mods: DataFrame, from_day: str | date = ALL, to_day: str | date | None = None) -> DataFrame:
    """Mods of commits between two days, both taken at 00:00 GMT; `"All"` takes every mod.

    On a table that carries `committed_ts`, as the mod store does, the bounds
    reach the Parquet scan; else the date text is parsed.
    """
    if from_day == ALL:
        return mods
    first, last = check_range(from_day, to_day)
    when = F.col("committed_ts") if "committed_ts" in mods.columns else instant(F.col("committed_date"))
    low, high = (F.to_timestamp(F.lit(f"{day.isoformat()} 00:00:00+00:00")) for day in (first, last))
    if "committed_month" in mods.columns:
        # Months are local, the bounds are GMT; two days cover any offset.
        months = [(d + timedelta(days=n)).strftime("%Y-%m") for d, n in ((first, -2), (last, 2))]
        mods = mods.where(F.col("committed_month").between(*months))
    return mods.where(when.between(low, high))


def has_commits(mods: DataFrame) -> bool:
    """False stands for the "no commits" outcome of a range."""
    return not mods.isEmpty()


def newest_first(mods: DataFrame) -> DataFrame:
    """Order by the point in time of the commit, newest first.

    A hash of the paths breaks ties, so that the sort can spread a commit with
    very many files over several tasks.
    """
    tie = F.xxhash64(*[c for c in ("file_new_path", "file_old_path", "file_name") if c in mods.columns])
    return mods.orderBy(instant(F.col("committed_date")).desc(), "hash", tie)


def dates_in_gmt(mods: DataFrame) -> DataFrame:
    return mods.withColumns({c: gmt_text(F.col(c)) for c in ("committed_date", "authored_date")})
