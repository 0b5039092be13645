"""The registered queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.functions import dates, numbers, text
from effortlens.operators import (
    blame as bl,
    classifier as cl,
    commits as cm,
    explore as ex,
    features as ft,
    mixture as mx,
    ordering as od,
    privacy as pv,
    refresh as rf,
    report as rp,
    scoring as sc,
    silhouette as sl,
    statistics as st,
)
from effortlens.plans import checks as ck
from effortlens.plans import fixtures as fx
from effortlens.plans import jobs
from effortlens.schema import FEATURES, NO_MODEL, PERSONAL
from effortlens.session import fresh_path, materialise, settle
from effortlens.sources import csv as csv_files
from effortlens.sources import json as json_files
from effortlens.sources import models as model_files
from effortlens.sources import store as stores
from effortlens.streaming import daily as stream_daily
from effortlens.streaming import refresh as stream_refresh
from effortlens.streaming import rollup as stream_rollup

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(check: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, sf_dir)

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        QUERIES[query.__name__] = run
        if check is not None:
            CHECKS[query.__name__] = check
        return query

    return add


def rounded(*names: str, digits: int = 4) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def sql_rounded(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_MOD_TEXT = "hash, Author, Email, message, authored_date, Committer, committed_date"
_MOD_NUMBERS = (
    "number_of_branches, in_main_branch, merge_commit, number_of_mod_files, file_change_type_name, "
    "number_functions_before, number_functions_after, number_functions_edited, number_lines_added, "
    "number_lines_removed, file_number_loc, language_supported, file_size, file_complexity, tokens"
)
_DMM = ("dmm_unit_size", "dmm_unit_complexity", "dmm_unit_interfacing")
_PATHS = "file_name, file_old_path, file_new_path"


def _names(listed: str) -> list[str]:
    return listed.split(", ")


def _mod_columns(mods: DataFrame) -> DataFrame:
    return mods.select(
        *_names(_MOD_TEXT), *_names(_MOD_NUMBERS), *_names(_PATHS), "file_ext", *rounded(*_DMM)
    )


_MODS_SQL = (
    f"WITH {ck.EXT} SELECT {_MOD_TEXT}, {_MOD_NUMBERS}, {_PATHS}, file_ext, {sql_rounded(*_DMM)} FROM fx"
)


# --- sources and sinks -------------------------------------------------------


@register(_MODS_SQL)
def mods_csv_round_trip(spark, sf_dir):
    """Write mods as CSV and read them back in their declared types."""
    path = fresh_path(spark, "mods-csv")
    csv_files.write_csv(fx.mods_with_ext(spark, sf_dir), path, compression="gzip")
    return _mod_columns(csv_files.read_mods_csv(spark, path))


@register(
    f"WITH {ck.EXT} SELECT hash, file_name, CASE WHEN merge_commit THEN file_complexity END AS file_complexity, "
    "number_lines_added FROM fx"
)
def mods_many_csv(spark, sf_dir):
    """Two folders of CSV files with different columns as one table."""
    mods = fx.mods_with_ext(spark, sf_dir)
    merged, direct = fresh_path(spark, "merged-csv"), fresh_path(spark, "direct-csv")
    csv_files.write_csv(mods.where("merge_commit"), merged, compression="gzip")
    csv_files.write_csv(mods.where("not merge_commit").drop("file_complexity"), direct, compression="gzip")
    both = csv_files.read_mods_many(spark, [merged, direct])
    return both.select("hash", "file_name", "file_complexity", "number_lines_added")


@register(_MODS_SQL)
def mods_json_round_trip(spark, sf_dir):
    path = fresh_path(spark, "mods-json")
    json_files.write_mods_json(fx.mods_with_ext(spark, sf_dir), path, compression="gzip")
    return _mod_columns(json_files.read_mods_json(spark, path, lines=True))


@register(
    f"WITH {ck.CHART} SELECT Email, committed_date, file_ext, "
    "CASE WHEN language_supported THEN 'True' ELSE 'False' END AS language_supported, "
    "cast(number_lines_added AS VARCHAR) AS number_lines_added FROM fz"
)
def csv_all_text(spark, sf_dir):
    """A CSV file read as plain text columns, truth values spelled out."""
    path = fresh_path(spark, "text-csv")
    csv_files.write_csv(
        fx.mods_with_ext(spark, sf_dir).select(
            "Email", "committed_date", "file_ext", "language_supported", "number_lines_added"
        ),
        path,
    )
    return csv_files.read_text_csv(spark, path)


_COMMITS_SQL = """
WITH c AS (SELECT *, unnest(generate_series(1, 1 + o_orderkey % 7)) AS i FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT concat('c', cast(o_orderkey AS VARCHAR)) AS hash, c_name AS Author, concat(c_name, '@example.org') AS Email,
       o_orderpriority AS message, concat(cast(o_orderdate AS VARCHAR), '+00:00') AS committed_date, c_mktsegment AS Committer,
       cast(1 + o_orderkey % 3 AS INT) AS number_of_branches, o_orderstatus = 'P' AS merge_commit,
       cast(1 + o_orderkey % 7 AS INT) AS number_of_mod_files,
       concat('file_', cast(o_orderkey % 1000 AS VARCHAR), '_', cast(i AS VARCHAR), '.py') AS file_name, 'py' AS file_ext,
       cast(5 AS INT) AS file_change_type_value,
       cast((o_orderkey + i) % 4 AS INT) AS number_functions_before, cast((o_orderkey + i) % 6 AS INT) AS number_functions_after,
       cast(o_orderkey % 3 AS INT) AS number_functions_edited, cast(o_orderkey % 40 + i AS INT) AS number_lines_added,
       o_orderkey % 5 <> 0 AS language_supported,
       cast(CASE WHEN o_orderkey % 6 <> 0 THEN i ELSE 0 END AS INT) AS file_size,
       round(o_orderkey % 10 / 10.0, 4) AS dmm_unit_size, cast(NULL AS DOUBLE) AS dmm_unit_interfacing,
       cast(o_orderkey % 900 AS INT) AS tokens
FROM c"""


@register(_COMMITS_SQL)
def explode_commits(spark, sf_dir):
    """Nested commits flattened to mods."""
    return cm.explode_commits(fx.commits(spark, sf_dir)).select(
        *_names("hash, Author, Email, message, committed_date, Committer, number_of_branches, merge_commit"),
        *_names("number_of_mod_files, file_name, file_ext, file_change_type_value, number_functions_before"),
        *_names("number_functions_after, number_functions_edited, number_lines_added, language_supported"),
        "file_size",
        *rounded("dmm_unit_size", "dmm_unit_interfacing"),
        "tokens",
    )


@register(
    "SELECT concat('c', cast(o_orderkey AS VARCHAR)) AS hash, concat('line ', cast(unnest(generate_series(1, i)) AS VARCHAR)) AS line "
    "FROM (SELECT o_orderkey, unnest(generate_series(1, 1 + o_orderkey % 7)) AS i FROM orders JOIN customer ON o_custkey = c_custkey) x"
)
def added_lines(spark, sf_dir):
    """Texts of all added lines of a commit, the lists of its mods flattened."""
    return fx.commits(spark, sf_dir).select(
        "hash",
        F.explode(
            F.flatten(F.transform("modifications", lambda m: text.line_texts(m["diff_added"])))
        ).alias("line"),
    )


@register(
    f"WITH {ck.MODS} SELECT hash, file_name, committed_date, number_lines_added FROM mods "
    "WHERE committed_date BETWEEN '1996-03-01 00:00:00+00:00' AND '1997-02-01 00:00:00+00:00'"
)
def scan_range(spark, sf_dir):
    found = cm.scan_range(fx.mods(spark, sf_dir), "1996-03-01", "1997-02-01")
    return found.select("hash", "file_name", "committed_date", "number_lines_added")


@register(f"WITH {ck.MODS} SELECT count(DISTINCT hash) AS n_commits FROM mods")
def commit_count(spark, sf_dir):
    return cm.commit_count(fx.mods(spark, sf_dir))


@register(f"WITH {ck.MODS} SELECT hash, file_name, number_lines_added, number_of_mod_files FROM mods")
def files_per_commit(spark, sf_dir):
    """The number of files of each commit, counted on flat mods."""
    mods = fx.mods(spark, sf_dir).select("hash", "file_name", "number_lines_added")
    return cm.with_files_per_commit(mods)


@register(f"WITH {ck.MODS} SELECT hash, file_name, committed_date FROM mods")
def newest_first(spark, sf_dir):
    return cm.newest_first(fx.mods(spark, sf_dir)).select("hash", "file_name", "committed_date")


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a store holds after its first run, and what a second run brings: overlapping years."""
    mods = materialise(fx.mods_with_ext(spark, sf_dir), "mods", compression="zstd")
    year = F.substring("committed_date", 1, 4)
    return mods.where(year < "1998"), mods.where(year >= "1997")


@register(f"WITH {ck.EXT} SELECT hash, file_name, number_lines_added, dmm_unit_size FROM fx")
def incremental_refresh(spark, sf_dir):
    """A store of the early years, refreshed with years that overlap."""
    old, new = _old_and_new(spark, sf_dir)
    both = rf.refreshed(old, new)
    return both.select("hash", "file_name", "number_lines_added", "dmm_unit_size")


@register(
    f"WITH {ck.CHART}, days AS (SELECT *, try_cast(day AS DATE) AS d FROM ch) SELECT Email, day AS date, file_ext, round(sum(mod_score), 4) AS score "
    "FROM days WHERE d < (SELECT max(d) FROM days) - 7 GROUP BY 1, 2, 3"
)
def stream_daily_sums(spark, sf_dir):
    """The score cube of the days that are closed: more than a week before the newest row of the stream."""
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("scored-csv", "daily", "daily-state"))
    csv_files.write_csv(_charted(spark, sf_dir), folder, compression="gzip", fast=True)
    stream = stream_rollup.read_scored_stream(spark, folder, maxFilesPerTrigger=100)
    stream_daily.start_daily_rollup(stream, target, checkpoint).awaitTermination()
    return stream_daily.read_daily(spark, target).select("Email", "date", "file_ext", *rounded("score"))


@register(
    f"WITH {ck.EXT} SELECT substr(committed_date, 1, 7) AS committed_month, count(*) AS n_mods, "
    "cast(sum(number_lines_added) AS BIGINT) AS n_lines FROM fx GROUP BY 1"
)
def mod_store(spark, sf_dir):
    """Create a partitioned mod store, refresh it, and scan it back."""
    old, new = _old_and_new(spark, sf_dir)
    store = stores.ModStore(spark, fresh_path(spark, "store"), "Demo")
    store.create(old)
    store.refresh(new)
    return store.mods().groupBy("committed_month").agg(
        F.count("*").alias("n_mods"), F.sum("number_lines_added").alias("n_lines")
    )


@register(
    f"WITH {ck.HISTORY} SELECT orig_hash, blame_hash, file FROM bl"
)
def blame_store(spark, sf_dir):
    """Blame rows stored twice come back once."""
    rows = materialise(fx.blame(spark, sf_dir), "blame", compression="zstd")
    store = stores.ModStore(spark, fresh_path(spark, "store"), "Demo")
    rows.write.parquet(store.blame_path, compression="zstd")
    rows.write.mode("append").parquet(store.blame_path, compression="zstd")
    return store.blame()


@register(
    f"WITH {ck.MODS} SELECT hash, file_name, replace(committed_date, '+00:00', '-05:00') AS local_date, "
    "concat(cast(cast(left(committed_date, 19) AS TIMESTAMP) + INTERVAL 5 HOUR AS VARCHAR), '+00:00') AS committed_date, "
    "concat(cast(cast(left(authored_date, 19) AS TIMESTAMP) - INTERVAL 330 MINUTE AS VARCHAR), '+00:00') AS authored_date FROM mods"
)
def dates_in_gmt(spark, sf_dir):
    """Local dates with an offset rewritten in GMT."""
    mods = fx.mods(spark, sf_dir)
    local = F.replace("committed_date", F.lit("+00:00"), F.lit("-05:00"))
    shifted = mods.select(
        "hash",
        "file_name",
        local.alias("local_date"),
        local.alias("committed_date"),
        F.replace("authored_date", F.lit("+00:00"), F.lit("+05:30")).alias("authored_date"),
    )
    return cm.dates_in_gmt(shifted)


# --- text, number and date functions ----------------------------------------


@register(
    f"WITH {ck.MODS} SELECT hash, file_name, file_new_path, "
    f"CASE WHEN regexp_matches(file_name, '^.+\\.[^.]+$') THEN regexp_extract(file_name, '^.+(\\.[^.]+)$', 1) ELSE 'NoExt' END AS ext_dotted, "
    f"{ck.ext_sql('file_name')} AS ext_plain, {ck.path_ext_sql('file_new_path')} AS ext_of_path, "
    "string_split(file_new_path, '/')[-1] AS base_name FROM mods"
)
def extension_forms(spark, sf_dir):
    name, path = F.col("file_name"), F.col("file_new_path")
    return fx.mods(spark, sf_dir).select(
        "hash",
        "file_name",
        "file_new_path",
        text.dotted_extension(name).alias("ext_dotted"),
        text.extension(name).alias("ext_plain"),
        text.path_extension(path).alias("ext_of_path"),
        text.base_name(path).alias("base_name"),
    )


@register(
    f"WITH {ck.MODS} SELECT hash, message, cast(len(regexp_extract_all(message, '\\b(?:bug|Bug|Fix|fix)\\b')) AS INT) AS bug_words FROM mods"
)
def bug_word_count(spark, sf_dir):
    return fx.mods(spark, sf_dir).select(
        "hash", "message", text.bug_word_count(F.col("message")).cast("int").alias("bug_words")
    )


@register(
    r"SELECT doc_id, cast(len(regexp_extract_all(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) + "
    r"CASE WHEN text = '' OR regexp_matches(text, '[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]\z') THEN 0 ELSE 1 END AS INT) AS n_lines FROM documents"
)
def line_count(spark, sf_dir):
    """Lines of whole document texts."""
    documents = fx.table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.line_count(F.col("text")).alias("n_lines"))


@register(
    f"WITH {ck.MODS} SELECT hash, file_name, sha256(coalesce(file_old_path, 'nan')) AS old_path_hash, "
    "sha256(cast(number_lines_added AS VARCHAR)) AS lines_hash FROM mods"
)
def sha256_text(spark, sf_dir):
    return fx.mods(spark, sf_dir).select(
        "hash",
        "file_name",
        text.sha256_text(F.col("file_old_path")).alias("old_path_hash"),
        text.sha256_text(F.col("number_lines_added")).alias("lines_hash"),
    )


@register(
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS number, "
    "CASE WHEN l_linenumber IN (1, 2) THEN 0.0 ELSE l_quantity END AS feature, l_linenumber NOT IN (1, 2) AS is_number FROM lineitem"
)
def lenient_number(spark, sf_dir):
    """Text that is no number becomes missing, missing becomes 0 in a feature."""
    line = F.col("l_linenumber")
    written = F.when(line == 1, "n/a").when(line == 2, "NaN").otherwise(F.col("l_quantity").cast("string"))
    number = numbers.lenient_number(written)
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        number.alias("number"),
        numbers.feature_number(number).alias("feature"),
        numbers.is_number(number).alias("is_number"),
    )


@register(
    f"WITH {ck.MODS} SELECT hash, file_name, split_part(committed_date, ' ', 1) AS day, "
    "cast(month(cast(left(committed_date, 10) AS DATE)) AS INT) AS month, cast(year(cast(left(committed_date, 10) AS DATE)) AS INT) AS year FROM mods"
)
def date_parts(spark, sf_dir):
    date = F.col("committed_date")
    return fx.mods(spark, sf_dir).select(
        "hash",
        "file_name",
        dates.day_text(date).alias("day"),
        F.month(dates.local_day(date)).alias("month"),
        F.year(dates.local_day(date)).alias("year"),
    )


# --- features, statistics, scaling ------------------------------------------


@register(
    f"WITH {ck.FEATURED} SELECT hash, file_name, file_ext, total_changed, n_functions_add_del, {sql_rounded(*FEATURES)} FROM ft"
)
def features(spark, sf_dir):
    return fx.features(spark, sf_dir).select(
        "hash", "file_name", "file_ext", "total_changed", "n_functions_add_del", *rounded(*FEATURES)
    )


@register(
    f"WITH {ck.FEATURED} SELECT file_ext, hash, Author, language_supported, {sql_rounded(*FEATURES)} FROM fz"
)
def training_frame(spark, sf_dir):
    frame = ft.training_frame(fx.features(spark, sf_dir))
    return frame.select("file_ext", "hash", "Author", "language_supported", *rounded(*FEATURES))


@register(f"WITH {ck.FEATURED} SELECT hash, file_name, {sql_rounded(*FEATURES)} FROM fz WHERE file_ext = 'java'")
def one_extension(spark, sf_dir):
    found = ft.feature_frame(fx.features(spark, sf_dir), "hash", "file_name", "file_ext")
    return found.where(F.col("file_ext") == "java").select("hash", "file_name", *rounded(*FEATURES))


@register(
    f"WITH {ck.MODS} SELECT hash, message, authored_date, committed_date, {_MOD_NUMBERS} FROM mods"
)
def dropped_columns(spark, sf_dir):
    """Clear-text columns left out."""
    return fx.mods(spark, sf_dir).drop(*PERSONAL, *_DMM)


def _stat_columns(ends: tuple[str, ...]) -> list[str]:
    return [f"{f}_{end}" for f in FEATURES for end in ends]


@register(
    f"WITH {ck.FEATURED} SELECT file_ext, count(*) AS n_rows, "
    + ", ".join(
        f"round(avg({f}), 4) AS {f}_avg, round(stddev_pop({f}), 4) AS {f}_sd" for f in FEATURES
    )
    + " FROM fz GROUP BY file_ext"
)
def moments(spark, sf_dir):
    frame = ft.training_frame(fx.features(spark, sf_dir))
    return st.moments(frame).select("file_ext", "n_rows", *rounded(*_stat_columns(("avg", "sd"))))


@register(
    f"WITH {ck.FEATURED} SELECT file_ext, "
    + ", ".join(f"round(min({f}), 4) AS {f}_min, round(max({f}), 4) AS {f}_max" for f in FEATURES)
    + " FROM fz GROUP BY file_ext"
)
def ranges(spark, sf_dir):
    frame = ft.training_frame(fx.features(spark, sf_dir))
    return st.ranges(frame).select("file_ext", *rounded(*_stat_columns(("min", "max"))))


@register(f"WITH {ck.FLAGGED} SELECT hash, file_name, file_ext, {sql_rounded(*FEATURES)} FROM fl WHERE NOT is_inlier")
def outliers(spark, sf_dir):
    frame = ft.scoring_frame(fx.features(spark, sf_dir))
    return st.split_outliers(frame)[1].select("hash", "file_name", "file_ext", *rounded(*FEATURES))


@register(f"WITH {ck.FLAGGED} SELECT hash, file_name, file_ext, {sql_rounded(*FEATURES)} FROM fl WHERE is_inlier")
def inliers(spark, sf_dir):
    frame = ft.scoring_frame(fx.features(spark, sf_dir))
    return st.split_outliers(frame)[0].select("hash", "file_name", "file_ext", *rounded(*FEATURES))


_SUMMARY_SQL = f"""WITH {ck.FLAGGED}
SELECT file_ext, count(*) AS n_rows, count(*) FILTER (is_inlier) AS n_inliers, count(*) FILTER (NOT is_inlier) AS n_outliers,
       arg_min(language_supported, concat(rpad(hash, 20, ' '), file_name)) AS supported
FROM fl GROUP BY file_ext"""


@register(_SUMMARY_SQL)
def extension_summary(spark, sf_dir):
    return st.extension_summary(ft.scoring_frame(fx.features(spark, sf_dir)))


@register(f"SELECT * FROM ({_SUMMARY_SQL}) s WHERE n_rows >= 50 AND supported AND n_inliers >= 1")
def trainable_extensions(spark, sf_dir):
    return st.trainable_extensions(ft.scoring_frame(fx.features(spark, sf_dir)))


@register(f"WITH {ck.SCALED_ROWS} SELECT hash, file_name, file_ext, {sql_rounded(*ck.SCALED)} FROM sc")
def scale_minmax(spark, sf_dir):
    frame = ft.scoring_frame(fx.features(spark, sf_dir))
    return st.scale_minmax(frame).select("hash", "file_name", "file_ext", *rounded(*ck.SCALED))


_TRAINING_SQL = f"""WITH {ck.FLAGGED},
gt AS (SELECT file_ext AS g FROM fl GROUP BY file_ext HAVING count(*) >= 50 AND bool_and(language_supported) AND count(*) FILTER (is_inlier) >= 1),
ti AS (SELECT * FROM fl JOIN gt ON file_ext = g WHERE is_inlier),
tr AS (SELECT file_ext AS x, {", ".join(f"min({f}) AS lo{i}, max({f}) AS hi{i}" for i, f in enumerate(FEATURES))} FROM ti GROUP BY file_ext)
SELECT file_ext, hash, {", ".join(f"round(coalesce(({f} - lo{i}) / nullif(hi{i} - lo{i}, 0), 0.0), 4) AS {s}" for i, (f, s) in enumerate(zip(FEATURES, ck.SCALED)))}
FROM ti JOIN tr ON file_ext = x"""


@register(_TRAINING_SQL)
def training_set(spark, sf_dir):
    """Scaled inliers of all trainable extensions, laid out per extension."""
    found = jobs.training_rows(fx.mods_with_ext(spark, sf_dir))
    return found.select("file_ext", "hash", *rounded(*ck.SCALED))


@register(
    f"WITH {ck.FLAGGED} SELECT hash, file_name, "
    + ", ".join(f"round(coalesce(({f} - a{i}) / nullif(s{i}, 0), 0.0), 4) AS {f}" for i, f in enumerate(FEATURES))
    + " FROM fl JOIN ms ON file_ext = e"
)
def standardise(spark, sf_dir):
    frame = ft.feature_frame(fx.features(spark, sf_dir), "hash", "file_name", "file_ext")
    return st.standardise(frame, FEATURES, by=("file_ext",)).select("hash", "file_name", *rounded(*FEATURES))


_NORM = "sqrt(" + " + ".join(f"{f} * {f}" for f in FEATURES) + ")"


@register(
    f"WITH {ck.FEATURED} SELECT hash, file_name, "
    + ", ".join(f"round(coalesce({f} / nullif({_NORM}, 0), {f}), 4) AS {f}" for f in FEATURES)
    + " FROM fz"
)
def normalise_rows(spark, sf_dir):
    frame = ft.feature_frame(fx.features(spark, sf_dir), "hash", "file_name")
    return ex.normalise_rows(frame, FEATURES).select("hash", "file_name", *rounded(*FEATURES))


def _describe_sql(f: str) -> str:
    third, fourth = (f"avg(pow({f} - mu_{f}, {n}))" for n in (3, 4))
    return (
        f"SELECT '{f}' AS feature, count({f}) AS n, round(min({f}), 4) AS minimum, round(max({f}), 4) AS maximum, "
        f"round(avg({f}), 4) AS mean, round(var_samp({f}), 4) AS variance, "
        f"round({third} / pow(var_pop({f}), 1.5), 4) AS skewness, round({fourth} / pow(var_pop({f}), 2) - 3, 4) AS kurtosis "
        f"FROM fz, (SELECT avg({f}) AS mu_{f} FROM fz) m"
    )


@register(f"WITH {ck.FEATURED} " + " UNION ALL ".join(_describe_sql(f) for f in FEATURES))
def describe(spark, sf_dir):
    frame = ft.feature_frame(fx.features(spark, sf_dir))
    return ex.describe(frame, FEATURES).select(
        "feature", "n", *rounded("minimum", "maximum", "mean", "variance", "skewness", "kurtosis")
    )


# --- mixture with given clusters, posteriors, scores -------------------------

_MEANS = [f"mean_{i}" for i in range(len(FEATURES))]
_POSTERIORS = [f"p{c}" for c in range(mx.CLUSTERS)]


# Columns that a mixture's parameters are taken from.
_MEASURED = ("file_ext", *FEATURES, "cluster_id")


def _clustered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Mods with raw features and a given cluster: one per ten added lines. `columns`, by default all, of them."""
    cluster = F.floor((F.col("number_lines_added") - 1) / 10).cast("int")
    frame = ft.scoring_frame(fx.features(spark, sf_dir)).withColumn("cluster_id", cluster)
    return frame.select(*columns) if columns else frame


def _clustered_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same with `columns` beside those measured, joined once and written: ranges, parameters and scores all read it."""
    return materialise(_clustered(spark, sf_dir, *columns, *_MEASURED), "clustered")


def _model(frame: DataFrame) -> DataFrame:
    return mx.moment_mixture(st.scale_minmax(frame))


@register(
    f"WITH {ck.MODEL} SELECT mt.e AS file_ext, cluster, round(weight, 6) AS weight, "
    + ", ".join(f"round(m{i}, 6) AS {m}" for i, m in enumerate(_MEANS))
    + ", "
    + " + ".join(f"ln(v{i})" for i in range(len(FEATURES))).join(("round(", ", 4) AS log_det"))
    + " FROM mt"
)
def moment_mixture(spark, sf_dir):
    """Mixture parameters from given clusters."""
    model = _model(_clustered_table(spark, sf_dir))
    means = [F.round(F.col("mean")[i], 6).alias(m) for i, m in enumerate(_MEANS)]
    return model.select("file_ext", "cluster", *rounded("weight", digits=6), *means, *rounded("log_det"))


@register(
    f"WITH {ck.POSTERIORS}, best AS (SELECT rid, cast(arg_max(cluster, p) AS INT) AS cluster, "
    + ", ".join(f"round(coalesce(max(p) FILTER (cluster = {c}), 0), 4) AS {p}" for c, p in enumerate(_POSTERIORS))
    + f" FROM pp GROUP BY rid) SELECT hash, file_name, {', '.join(_POSTERIORS)}, cluster FROM best JOIN fz ON best.rid = fz.rid"
)
def assign_clusters(spark, sf_dir):
    """Posteriors of every cluster and the most probable one."""
    frame = _clustered_table(spark, sf_dir, "hash", "file_name")
    found = mx.assign_clusters(frame, _model(frame))
    posteriors = [F.round(F.col("posteriors")[c], 4).alias(p) for c, p in enumerate(_POSTERIORS)]
    return found.select("hash", "file_name", *posteriors, "cluster")


@register(
    f"WITH {ck.MODEL} SELECT mt.e AS file_ext, cluster, "
    + ", ".join(
        f"round(m{i} * (CASE WHEN hi{i} = lo{i} THEN 1 ELSE hi{i} - lo{i} END) + lo{i}, 4) AS {f}"
        for i, f in enumerate(FEATURES)
    )
    + ", round(value, 4) AS Sum_centroids FROM mt JOIN rg ON mt.e = rg.e"
)
def centroids(spark, sf_dir):
    """The audit table: centroids in real units and their sum."""
    frame = _clustered_table(spark, sf_dir)
    found = mx.centroids(_model(frame), materialise(st.ranges(frame), "ranges"))
    return found.select("file_ext", "cluster", *rounded(*FEATURES, "Sum_centroids"))


_SCORES = ("probablities", "sum_centroid", "mod_score")


def _scored(frame: DataFrame, measured: DataFrame | None = None, **options) -> DataFrame:
    """`frame` scored with a mixture of given clusters, by default its own; one extension has no model."""
    measured = frame if measured is None else measured
    low_high = settle(st.ranges(measured), "ranges")[0]
    mixture = mx.moment_mixture(st.scale_minmax(measured, low_high)).where(F.col("file_ext") != "md")
    return sc.score_mods(frame, mixture, low_high, **options)


@register(f"WITH {ck.SCORED} SELECT hash, file_name, file_ext, predicted_cluster, {sql_rounded(*_SCORES)} FROM sd")
def score_mods(spark, sf_dir):
    """Scores of all mods with given mixture parameters; one extension has no model."""
    scored = _scored(_clustered_table(spark, sf_dir, "hash", "file_name"))
    return scored.select("hash", "file_name", "file_ext", "predicted_cluster", *rounded(*_SCORES))


@register(
    f"WITH {ck.SCORED}, ne AS (SELECT file_ext AS ext, count(*) AS n FROM sd GROUP BY file_ext) "
    f"SELECT hash, file_name, file_ext, {sql_rounded('mod_score')} FROM sd JOIN ne ON file_ext = ext "
    "WHERE n >= (SELECT avg(n) FROM ne)"
)
def score_min_rows(spark, sf_dir):
    """Extensions with fewer rows than the mean extension left out of the scores."""
    frame = _clustered_table(spark, sf_dir, "hash", "file_name")
    sizes = frame.groupBy("file_ext").count()
    mean = math.ceil(sizes.agg(F.avg("count")).first()[0] or 0)
    return _scored(frame, min_rows=mean).select("hash", "file_name", "file_ext", *rounded("mod_score"))


@register(f"WITH {ck.SCORED} SELECT file_ext, predicted_cluster, count(*) AS n_rows FROM sd WHERE predicted_cluster <> 'No Model found' GROUP BY 1, 2")
def drop_unclustered(spark, sf_dir):
    """Rows that got a cluster, counted per cluster."""
    scored = _scored(_clustered_table(spark, sf_dir))
    known = scored.withColumn("cluster", F.col("predicted_cluster").try_cast("int"))
    return (
        mx.drop_unclustered(known).groupBy("file_ext", "predicted_cluster").agg(F.count("*").alias("n_rows"))
    )


@register(
    f"WITH {ck.SCORED} SELECT Email, split_part(committed_date, ' ', 1) AS date, file_ext, round(sum(mod_score), 3) AS score "
    "FROM sd WHERE language_supported AND file_ext <> 'NoExt' GROUP BY 1, 2, 3"
)
def scored_cube(spark, sf_dir):
    """From raw mods to scores by author, date and language."""
    scored = _scored(_clustered_table(spark, sf_dir, "Email", "committed_date", "language_supported"))
    return rp.score_cube(scored).select("Email", "date", "file_ext", *rounded("score", digits=3))


@register(
    f"WITH {ck.SCALED_ROWS} SELECT cluster_id AS cluster, cast(i AS INT) AS i, cast(j AS INT) AS j, round(v, 6) AS covariance FROM ("
    + " UNION ALL ".join(
        f"SELECT cluster_id, {i} AS i, {j} AS j, covar_pop({ck.SCALED[i]}, {ck.SCALED[j]}) AS v FROM sc GROUP BY cluster_id"
        for i in range(len(FEATURES))
        for j in range(len(FEATURES))
    )
    + ") c"
)
def covariance_table(spark, sf_dir):
    """Covariances of the scaled features in each given cluster."""
    scaled = st.scale_minmax(_clustered(spark, sf_dir)).withColumnRenamed("cluster_id", "cluster")
    found = mx.covariance_table(scaled, list(ck.SCALED), ["cluster"])
    return found.select("cluster", "i", "j", *rounded("covariance", digits=6))


@register(f"WITH {ck.FEATURED} SELECT cluster_id, count(*) AS n_rows FROM fz GROUP BY cluster_id")
def cluster_sizes(spark, sf_dir):
    return mx.cluster_sizes(_clustered(spark, sf_dir), "cluster_id")


# --- privacy ------------------------------------------------------------------

_HASHED_SQL = ", ".join(f"sha256(coalesce({c}, 'nan')) AS {c}_encrypted" for c in PERSONAL)


@register(f"WITH {ck.EXT} SELECT hash, message, committed_date, file_ext, number_lines_added, {_HASHED_SQL} FROM fx")
def anonymise(spark, sf_dir):
    hidden, _ = pv.anonymise(fx.mods_with_ext(spark, sf_dir))
    return hidden.select(
        "hash", "message", "committed_date", "file_ext", "number_lines_added", *(f"{c}_encrypted" for c in PERSONAL)
    )


@register(f"WITH {ck.MODS} SELECT DISTINCT sha256(Email) AS Email_encrypted, Email FROM mods")
def email_map(spark, sf_dir):
    """The e-mail map, saved and loaded."""
    path = fresh_path(spark, "emails")
    stores.save_email_map(pv.email_map(fx.mods(spark, sf_dir)), path)
    return stores.load_email_map(spark, path)


@register(
    f"WITH {ck.MODS} SELECT hash, sha256(Email) AS Email_encrypted, CASE WHEN Email NOT LIKE '%7@example.org' THEN Email END AS Email FROM mods"
)
def de_anonymise(spark, sf_dir):
    """E-mails put back; a hash that is not in the map gives none."""
    hidden, emails = pv.anonymise(fx.mods(spark, sf_dir))
    known = materialise(emails.where(~F.col("Email").like("%7@example.org")), "emails")
    return pv.de_anonymise(hidden, known).select("hash", "Email_encrypted", "Email")


# --- blame --------------------------------------------------------------------


@register(f"WITH {ck.MODS}, {ck.FIXES} SELECT path FROM alive")
def surviving_paths(spark, sf_dir):
    return bl.surviving_paths(fx.mods(spark, sf_dir))


@register(f"WITH {ck.MODS}, {ck.FIXES} SELECT hash, message, file_name, file_new_path, number_lines_added FROM fixes")
def bug_fix_mods(spark, sf_dir):
    return bl.bug_fix_mods(fx.mods(spark, sf_dir)).select(
        "hash", "message", "file_name", "file_new_path", "number_lines_added"
    )


@register(f"WITH {ck.HISTORY} SELECT orig_hash, blame_hash, file FROM bl WHERE orig_hash <> blame_hash")
def drop_self_blame(spark, sf_dir):
    return bl.drop_self_blame(fx.blame(spark, sf_dir))


_PAIRS_SQL = f"""{ck.HISTORY}, {ck.FIXES},
pr AS (SELECT DISTINCT f.hash AS orig_hash, lh.blame_hash, concat('/repo/', file_new_path) AS file
       FROM fixes f JOIN (SELECT DISTINCT * FROM lh) lh ON f.hash = lh.orig_hash AND f.file_new_path = lh.path
            JOIN (SELECT unnest(range(1, 5)) AS n) ln ON n <= f.number_lines_added % 4 + 1 AND concat('line ', n % 3) IN ('line 0', 'line 2')
       WHERE f.hash <> lh.blame_hash)"""


@register(f"WITH {_PAIRS_SQL} SELECT orig_hash, blame_hash, file FROM pr")
def blame_pairs(spark, sf_dir):
    """Blame rows of the lines that bug fixes added."""
    return bl.blame_pairs(fx.mods_with_diff(spark, sf_dir), fx.line_history(spark, sf_dir))


_LABELLED = [c for c in bl.LABELLED if c not in ("file_change_type_value", "type", *_DMM)]


@register(
    f"WITH {_PAIRS_SQL}, gu AS (SELECT DISTINCT blame_hash AS gh, string_split(file, '/')[-1] AS gf FROM pr) "
    f"SELECT DISTINCT {', '.join(_LABELLED)}, {sql_rounded(*_DMM)}, CASE WHEN gh IS NULL THEN 'Clean' ELSE 'Buggy' END AS type, "
    f"{ck.path_ext_sql('file_new_path')} AS file_ext FROM mods LEFT JOIN gu ON hash = gh AND file_name = gf"
)
def label_bugs(spark, sf_dir):
    """Every mod labelled by the blame rows of bug fixes, copies removed."""
    mods = materialise(fx.mods(spark, sf_dir), "mods", compression="zstd")
    pairs = materialise(
        bl.blame_pairs(fx.mods_with_diff(spark, sf_dir), fx.line_history(spark, sf_dir)), "blame"
    )
    doubled = mods.unionByName(mods)
    return bl.label_bugs(doubled, pairs).select(*_LABELLED, *rounded(*_DMM), "type", "file_ext")


@register(f"WITH {ck.MODS} SELECT hash, file_name, number_lines_added, 'Clean' AS type FROM mods")
def label_without_blame(spark, sf_dir):
    """With an empty blame table every mod is clean."""
    none = fx.blame(spark, sf_dir).where(F.col("orig_hash").isNull())
    return bl.with_bug_type(fx.mods(spark, sf_dir), none).select("hash", "file_name", "number_lines_added", "type")


# --- report -------------------------------------------------------------------


def _charted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.features(spark, sf_dir).withColumn("mod_score", F.col("feature_total_changed"))


@register(f"WITH {ck.CHART} SELECT hash, Email, file_ext, {sql_rounded('mod_score')} FROM ch")
def chart_rows(spark, sf_dir):
    return rp.chart_rows(_charted(spark, sf_dir)).select("hash", "Email", "file_ext", *rounded("mod_score"))


_CUBE_SQL = f"WITH {ck.CHART} SELECT Email, day AS date, file_ext, round(sum(mod_score), 4) AS score FROM ch GROUP BY 1, 2, 3"


@register(_CUBE_SQL)
def score_cube(spark, sf_dir):
    return rp.score_cube(_charted(spark, sf_dir)).select("Email", "date", "file_ext", *rounded("score"))


@register(f"WITH {ck.CHART} SELECT DISTINCT Email FROM ch")
def authors(spark, sf_dir):
    return rp.authors(_charted(spark, sf_dir))


@register(f"WITH {ck.CHART} SELECT DISTINCT file_ext FROM ch")
def languages(spark, sf_dir):
    return rp.languages(_charted(spark, sf_dir))


@register(
    f"WITH {ck.CHART} SELECT hash, Email, {sql_rounded('mod_score')} FROM ch WHERE file_ext = 'js' AND cast(left(day, 4) AS INT) BETWEEN 1996 AND 1997"
)
def language_rows(spark, sf_dir):
    return rp.language_rows(_charted(spark, sf_dir), "js", 1996, 1997).select("hash", "Email", *rounded("mod_score"))


def _series_sql(where: str, authors: str = "ch") -> str:
    return f"""WITH {ck.CHART},
kept AS (SELECT DISTINCT Email FROM {authors}),
sums AS (SELECT Email, cast(substr(day, 6, 2) AS INT) AS month, sum(mod_score) AS s FROM ch WHERE {where} GROUP BY 1, 2),
ser AS (SELECT k.Email, cast(m.month AS INT) AS month, coalesce(s, 0.0) AS score
        FROM kept k CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS month) m
        LEFT JOIN sums ON sums.Email = k.Email AND sums.month = m.month)"""


_FOLDED = "file_ext = 'py' AND left(day, 4) BETWEEN '1996' AND '1997'"


@register(_series_sql(_FOLDED) + " SELECT Email, month, round(score, 4) AS score FROM ser")
def month_series(spark, sf_dir):
    """Twelve month sums per author; equal months of both years added up."""
    series = rp.month_series(_charted(spark, sf_dir), "py", (1996, 6), (1997, 5))
    return rp.long_series(series).select("Email", "month", *rounded("score"))


@register(
    _series_sql("file_ext = 'py' AND left(day, 7) BETWEEN '1996-06' AND '1997-05'")
    + " SELECT Email, month, round(score, 4) AS score FROM ser"
)
def month_series_exact(spark, sf_dir):
    """The same for exactly the chosen months."""
    series = rp.month_series(_charted(spark, sf_dir), "py", (1996, 6), (1997, 5), fold_years=False)
    return rp.long_series(series).select("Email", "month", *rounded("score"))


@register(_series_sql(_FOLDED) + " SELECT Email, round(sum(score), 4) AS total FROM ser GROUP BY Email")
def author_totals(spark, sf_dir):
    series = rp.month_series(_charted(spark, sf_dir), "py", (1996, 6), (1997, 5))
    return rp.author_totals(series).select("Email", *rounded("total"))


@register(
    _series_sql(_FOLDED, "(SELECT * FROM ch WHERE Email LIKE '%0@example.org') a")
    + " SELECT Email, month, round(score, 4) AS score FROM ser"
)
def author_selection(spark, sf_dir):
    """Month series of the authors in a table."""
    scored = _charted(spark, sf_dir)
    chosen = scored.where(F.col("Email").like("%0@example.org")).select("Email")
    series = rp.month_series(scored, "py", (1996, 6), (1997, 5), selection=chosen)
    return rp.long_series(series).select("Email", "month", *rounded("score"))


# --- set operations -------------------------------------------------------------


@register(
    f"WITH {ck.EXT} SELECT 'a' AS repository, hash, file_name, tokens FROM fx UNION ALL SELECT 'b', hash, file_name, NULL FROM fx"
)
def two_repositories(spark, sf_dir):
    """Tables of two repositories, one without a column, as one."""
    mods = fx.mods_with_ext(spark, sf_dir)
    first, second = mods.withColumn("repository", F.lit("a")), mods.withColumn("repository", F.lit("b"))
    both = first.unionByName(second.drop("tokens"), allowMissingColumns=True)
    return both.select("repository", "hash", "file_name", "tokens")


@register(f"WITH {ck.SCORED} SELECT file_ext, count(*) AS n_rows, round(sum(mod_score), 2) AS score FROM sd GROUP BY file_ext")
def scores_per_extension(spark, sf_dir):
    """All extensions written in one go, a folder each, and read back."""
    path = fresh_path(spark, "scores")
    # All columns of the mods are scored and written.
    stores.save_scores(_scored(materialise(_clustered(spark, sf_dir), "clustered", compression="zstd")), path)
    found = stores.load_scores(spark, path).groupBy("file_ext")
    return found.agg(F.count("*").alias("n_rows"), F.round(F.sum("mod_score"), 2).alias("score"))


# --- exploration ------------------------------------------------------------------

_DIMENSIONS = 64
_X = [f"x{i}" for i in range(_DIMENSIONS)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.spread_array(fx.table(spark, sf_dir, "embeddings"), "embedding", _DIMENSIONS)


_SILHOUETTE_SQL = """WITH e AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS s, count(*) AS n,
             count(*) FILTER (a.vec_id = b.vec_id) AS itself
      FROM e a, e b GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, own, max(CASE WHEN own = label AND n > 1 THEN s / (n - itself) END) AS a,
              min(CASE WHEN own <> label THEN s / n END) AS b FROM d GROUP BY 1, 2),
si AS (SELECT vec_id, own AS label, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""


@register(_SILHOUETTE_SQL + " SELECT vec_id, label, round(silhouette, 4) AS silhouette FROM si")
def silhouette_samples(spark, sf_dir):
    """Silhouette of every labelled vector, squared Euclidean distance."""
    found = ex.silhouette_samples(_vectors(spark, sf_dir), _X, "label")
    return found.select("vec_id", "label", *rounded("silhouette"))


@register(_SILHOUETTE_SQL + " SELECT round(avg(silhouette), 4) AS silhouette FROM si")
def silhouette_mean(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    mean = ex.silhouette_mean(vectors, _X, "label")
    return vectors.sparkSession.createDataFrame([(round(mean, 4),)], "silhouette double")


@register(
    _SILHOUETTE_SQL
    + """ SELECT label, rank, position, round(silhouette, 4) AS silhouette FROM (
    SELECT label, silhouette, row_number() OVER (PARTITION BY label ORDER BY silhouette) AS rank,
           row_number() OVER (ORDER BY label, silhouette) + 10 * label + 10 AS position FROM si) r"""
)
def silhouette_positions(spark, sf_dir):
    """Silhouettes ascending inside each cluster, clusters stacked with gaps of ten."""
    found = ex.silhouette_samples(_vectors(spark, sf_dir), _X, "label").select("vec_id", "label", "silhouette")
    placed = od.running_positions(found, "label", "silhouette", "vec_id", gap=10, start=10)
    return placed.select("label", "rank", "position", *rounded("silhouette"))


_EUCLIDEAN_SQL = _SILHOUETTE_SQL.replace("sum(list_distance(a.v, b.v) * list_distance(a.v, b.v))", "sum(list_distance(a.v, b.v))")


@register(_EUCLIDEAN_SQL + " SELECT vec_id, label, round(silhouette, 4) AS silhouette FROM si")
def euclidean_silhouettes(spark, sf_dir):
    """Silhouette of every labelled vector, plain Euclidean distance."""
    found = sl.euclidean_silhouettes(_vectors(spark, sf_dir), _X, "label")
    return found.select("vec_id", "label", *rounded("silhouette"))


@register(_EUCLIDEAN_SQL + " SELECT count(*) AS n_rows, round(avg(silhouette), 4) AS silhouette FROM si")
def euclidean_mean(spark, sf_dir):
    """Mean silhouette over all vectors, plain Euclidean distance."""
    found = sl.euclidean_mean(_vectors(spark, sf_dir), _X, "label", sample_rows=None)
    return found.select("n_rows", *rounded("silhouette"))


@register(
    f"WITH {ck.FEATURED} SELECT hash, file_name, {sql_rounded(FEATURES[3], FEATURES[5])} FROM fz"
)
def feature_subset(spark, sf_dir):
    """Two columns of the feature matrix."""
    frame = ft.feature_frame(fx.features(spark, sf_dir), "hash", "file_name")
    return frame.select("hash", "file_name", *rounded(FEATURES[3], FEATURES[5]))


def _feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Centres drawn at random depend on the order of the rows; this is the one they were drawn from so far.
    return materialise(ft.feature_frame(fx.features(spark, sf_dir, parts_last=False), "hash", "file_ext"), "matrix")


@register()
def kmeans(spark, sf_dir):
    """Five clusters of standardised features: centres."""
    frame = st.standardise(_feature_matrix(spark, sf_dir), FEATURES)
    _, model = ex.kmeans(frame, FEATURES)
    return ex.centres_table(model, frame)


@register()
def pca_variance(spark, sf_dir):
    """Share of the variance per principal component, and the running sum."""
    frame = _feature_matrix(spark, sf_dir)
    _, model = ex.pca(frame, FEATURES)
    return ex.explained_variance(model, frame)


@register(
    f"WITH {ck.FEATURED} SELECT cast({len(FEATURES)} AS BIGINT) AS components, 1.0::DOUBLE AS total, round(("
    + " + ".join(f"corr({a}, {b}) * corr({a}, {b})" for a in FEATURES for b in FEATURES)
    + f") / {len(FEATURES) ** 2}, 6) AS squares, true AS falling FROM fz"
)
def pca_invariants(spark, sf_dir):
    """What any set of principal components of these features must add up to."""
    frame = _feature_matrix(spark, sf_dir)
    _, model = ex.pca(frame, FEATURES, k=len(FEATURES))
    shares = ex.explained_variance(model, frame)
    ratios = F.transform(F.array_sort(F.collect_list(F.struct("component", "ratio"))), lambda x: x["ratio"])
    return shares.agg(
        F.count("*").alias("components"),
        F.round(F.sum("ratio"), 6).alias("total"),
        F.round(F.sum(F.col("ratio") * F.col("ratio")), 6).alias("squares"),
        (F.reverse(F.array_sort(ratios)) == ratios).alias("falling"),
    )


@register(f"WITH {ck.FEATURED} SELECT count(*) AS n_rows, cast(0 AS BIGINT) AS misplaced FROM fz")
def kmeans_invariants(spark, sf_dir):
    """Every row is in the cluster whose centre is nearest."""
    frame = st.standardise(_feature_matrix(spark, sf_dir), FEATURES)
    labelled, model = ex.kmeans(frame, FEATURES)
    centres = [[float(v) for v in centre] for centre in model.clusterCenters()]
    away = [sum(((F.col(f) - v) ** 2 for f, v in zip(FEATURES, centre)), F.lit(0.0)) for centre in centres]
    own = F.element_at(F.array(*away), F.col("cluster") + 1)
    return labelled.agg(F.count("*").alias("n_rows"), F.count_if(own > F.least(*away) + 1e-9).alias("misplaced"))


@register()
def kmeans_on_components(spark, sf_dir):
    """Clusters of the principal component scores: sizes."""
    scores, _ = ex.pca(_feature_matrix(spark, sf_dir), FEATURES)
    names = [f"pc{i}" for i in range(ex.COMPONENTS)]
    labelled, _ = ex.kmeans(scores, names, init="random", max_iterations=10)
    return mx.cluster_sizes(labelled)


@register()
def silhouette_sweep(spark, sf_dir):
    """Mean silhouette of normalised features for each number of clusters."""
    frame = materialise(ex.normalise_rows(_feature_matrix(spark, sf_dir), FEATURES), "normalised")
    return ex.silhouette_sweep(frame, FEATURES)


# --- fitted models ------------------------------------------------------------------


@register()
def fit_mixtures(spark, sf_dir):
    """Mixtures of all trainable extensions: weights and means."""
    mixture = mx.fit_mixtures(jobs.training_rows(fx.mods_with_ext(spark, sf_dir)))
    return mixture.select(
        "file_ext", "cluster", "weight", *[F.col("mean")[i].alias(m) for i, m in enumerate(_MEANS)]
    )


_MOMENTS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


@register(
    f"WITH tt AS ({_TRAINING_SQL.replace(', 4) AS', ', 12) AS')}) SELECT file_ext, 1.0::DOUBLE AS weights, "
    + ", ".join(f"round(avg({s}), 5) AS m{i}" for i, s in enumerate(ck.SCALED))
    + ", "
    + ", ".join(f"round(avg({ck.SCALED[i]} * {ck.SCALED[j]}), 5) AS m{i}{j}" for i, j in _MOMENTS)
    + " FROM tt GROUP BY file_ext"
)
def mixture_moments(spark, sf_dir):
    """First and second moments of the fitted mixtures: whatever the clusters are, those of the training rows."""
    size = len(FEATURES)
    fitted = mx.fit_mixtures(jobs.training_rows(fx.mods_with_ext(spark, sf_dir)))
    w, mean = F.col("weight"), lambda i: F.col("mean")[i]
    second = lambda i, j: F.col("covariance")[i * size + j] - (mx.COVARIANCE_FLOOR if i == j else 0.0) + mean(i) * mean(j)
    return fitted.groupBy("file_ext").agg(
        F.round(F.sum(w), 5).alias("weights"),
        *[F.round(F.sum(w * mean(i)), 5).alias(f"m{i}") for i in range(size)],
        *[F.round(F.sum(w * second(i, j)), 5).alias(f"m{i}{j}") for i, j in _MOMENTS],
    )


@register()
def mixture_covariances(spark, sf_dir):
    """Covariances of the fitted mixtures, cell by cell."""
    return mx.model_covariances(mx.fit_mixtures(jobs.training_rows(fx.mods_with_ext(spark, sf_dir))))


# Every trained extension with its number of training rows; what is learnt has no SQL, but how well has a bound.
_MODELS_SQL = f"WITH tt AS ({_TRAINING_SQL}) SELECT file_ext, 'KIND' AS kind, count(*) AS n_rows, true AS learnt FROM tt GROUP BY file_ext"


def _learnt() -> Column:
    return F.col("accuracy").between(0.75, 1.0).alias("learnt")


@register(_MODELS_SQL.replace("KIND", "boosted"))
def classifier_accuracy(spark, sf_dir):
    """Accuracy of boosted trees on unseen rows, per extension: 100 rounds of depth 6, as `train` has them.

    The models tell it; here all unseen rows are predicted once more and counted.
    """
    training = jobs.training_rows(fx.mods_with_ext(spark, sf_dir))
    mixture, low_high, fitted = jobs.fit_training(training)
    unseen = jobs.labelled_rows(training, mixture, low_high).where(cl.is_test_row())
    hit = (F.col("cluster_id") == F.col("cluster")).cast("double")
    counted = cl.predict_clusters(unseen, fitted).groupBy("file_ext").agg(F.avg(hit).alias("recount"))
    found = cl.accuracy_table(fitted).join(counted, "file_ext")
    same = F.abs(F.col("accuracy") - F.col("recount")) < 1e-12
    return found.select("file_ext", F.lit("boosted").alias("kind"), "n_rows", (_learnt() & same).alias("learnt"))


@register(_MODELS_SQL.replace("KIND", "boosted"))
def classifier_by_levels(spark, sf_dir):
    """Trees of all extensions grown by one grouped sum per level, beside those that one task per extension grows: the same."""
    mods = fx.mods_with_ext(spark, sf_dir)
    size = sum((F.col(f) for f in FEATURES), F.lit(0.0))
    label = F.least(F.lit(4), F.floor(F.log2(size + 1))).cast("int")
    rows = materialise(jobs.training_rows(mods).select("file_ext", "hash", *FEATURES, label.alias("cluster")), "labelled")
    spread, here = (cl.fit_classifiers(rows, rounds=2, depth=3, local_rows=n) for n in (0, cl.LOCAL_ROWS))
    parts = [c for c in spread.columns if c != "n_rows"]
    of = lambda frame, name: frame.select("file_ext", "n_rows", F.to_json(F.struct(*parts)).alias(name))
    both = of(spread, "a").join(of(here, "b").drop("n_rows"), "file_ext")
    return both.select("file_ext", F.lit("boosted").alias("kind"), "n_rows", (F.col("a") == F.col("b")).alias("learnt"))


@register(_MODELS_SQL.replace("KIND", "forest"))
def model_registry(spark, sf_dir):
    """Random forests trained, saved and listed."""
    root = fresh_path(spark, "models")
    jobs.train(fx.mods_with_ext(spark, sf_dir), root, kind="forest")
    return model_files.registry(spark, root).select("file_ext", "kind", "n_rows", _learnt())


@register(
    f"WITH {ck.EXT}, tt AS ({_TRAINING_SQL}) SELECT hash, Email, file_ext, "
    "file_ext IN (SELECT file_ext FROM tt) AS has_model, true AS consistent FROM fx"
)
def score_file(spark, sf_dir):
    """Train, anonymise to CSV, score the file, put e-mails back: every mod, its e-mail, and scores that add up."""
    root, source, target = (fresh_path(spark, n) for n in ("models", "hidden-csv", "scored-csv"))
    mods = materialise(fx.mods_with_ext(spark, sf_dir), "mods", compression="zstd")
    jobs.train(mods, root)
    hidden, emails = pv.anonymise(mods)
    csv_files.write_csv(hidden, source, compression="gzip")
    jobs.score_file(spark, source, target, root, compression="gzip")
    found = csv_files.read_text_csv(spark, target)
    restored = pv.de_anonymise(found, materialise(emails, "emails"))
    p, value, score = (F.col(c).cast("double") for c in _SCORES)
    has_model = F.col("predicted_cluster") != NO_MODEL
    known = has_model & p.between(0, 1 + 1e-9) & F.col("predicted_cluster").isin(*"01234") & (value > 0)
    unknown = ~has_model & (p == 0) & (value == 0)
    adds_up = F.abs(score - p * value) <= 1e-6 * F.greatest(F.lit(1.0), value)
    return restored.select(
        "hash", "Email", "file_ext", has_model.alias("has_model"), ((known | unknown) & adds_up).alias("consistent")
    )


# --- streams ------------------------------------------------------------------------

@register(_CUBE_SQL)
def stream_rollup_sums(spark, sf_dir):
    """The score cube from a stream of CSV files as `restore` writes them, with all columns."""
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("scored-csv", "rollup", "rollup-state"))
    hidden, emails = pv.anonymise(_charted(spark, sf_dir))
    csv_files.write_csv(pv.de_anonymise(hidden, materialise(emails, "emails")), folder, compression="gzip")
    stream = stream_rollup.read_scored_stream(spark, folder, maxFilesPerTrigger=100)
    stream_rollup.start_rollup(stream, target, checkpoint).awaitTermination()
    found = stream_rollup.read_rollup(spark, target)
    return found.select("Email", "date", "file_ext", *rounded("score"))


@register(
    f"WITH {ck.EXT} SELECT substr(committed_date, 1, 7) AS committed_month, count(*) AS n_mods, "
    "cast(sum(number_lines_added) AS BIGINT) AS n_lines FROM fx GROUP BY 1"
)
def stream_refresh_store(spark, sf_dir):
    """A mod store kept up to date from a stream; copies of stored commits add nothing."""
    old, new = _old_and_new(spark, sf_dir)
    store = stores.ModStore(spark, fresh_path(spark, "store"), "Demo")
    store.create(old)
    folder, checkpoint = fresh_path(spark, "new-mods"), fresh_path(spark, "refresh-state")
    new.write.parquet(folder, compression="zstd")
    stream = stream_refresh.read_mod_stream(spark, folder, new)
    stream_refresh.start_refresh(stream, store, checkpoint).awaitTermination()
    return store.mods().groupBy("committed_month").agg(
        F.count("*").alias("n_mods"), F.sum("number_lines_added").alias("n_lines")
    )
