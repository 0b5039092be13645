"""Commit data derived from the given order tables.

An order is a commit, a line item is one modified file in it, the customer is
the author, the supplier the committer, and the part is the file. Everything
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.functions.text import extension
from effortlens.operators.features import add_features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _int(column: Column) -> Column:
    return column.cast("int")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


def _file_name() -> Column:
    """Worked out where the line items have met their parts: it is longer than what it is made of."""
    suffix = F.element_at(
        F.array(*map(F.lit, (".py", ".js", ".java", ".c++", ".md", "", ".c#"))), F.col("p_size") % 7 + 1
    )
    stem = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), _text("p_partkey"))
    return F.concat(stem, suffix).alias("file_name")


def _message() -> Column:
    priority = F.col("o_orderpriority")
    return (
        F.when(priority.startswith("1"), F.concat(F.lit("Fix "), "p_name"))
        .when(priority.startswith("2"), F.concat(F.lit("closes bug in "), "p_name"))
        .when(priority.startswith("3"), F.concat(F.lit("debug prefix for "), "p_name"))
        .otherwise(F.concat(F.lit("add "), "p_name"))
    )


def mods(spark: SparkSession, sf_dir: str, parts_last: bool = True) -> DataFrame:
    """The mod table, without `file_ext` and the change-type number.

    The number of files per commit comes from a pre-aggregated count joined on
    the commit side, so that no commit is ever gathered into one task; a left join, which
    Spark leaves out where nobody asks for the number. The line items meet suppliers and orders,
    which have met their customers before, while they are narrow, and parts last: what is written of
    the mods then has those of one file together, with what is long in a mod, its paths and their hashes.
    With `parts_last` false orders come last: the same rows, those of one commit together.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    files_per_commit = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_files")
    )
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(files_per_commit, "o_orderkey", "left")
    )
    suppliers = (table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    with_order = (orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = (_files(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    rows = lineitem
    for met in (suppliers, with_order, parts) if parts_last else (parts, suppliers, with_order):
        rows = rows.join(*met)
    rows = rows.withColumn("file_name", _file_name())
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), "file_name")
    flag, line, size = F.col("l_returnflag"), F.col("l_linenumber"), F.col("p_size")
    renamed = (flag == "N") & (line == 3)
    tax, discount = F.col("l_tax"), F.col("l_discount")
    day = F.col("o_orderdate")
    known = line != 7
    return rows.select(
        F.concat(F.lit("c"), _text("l_orderkey")).alias("hash"),
        F.col("c_name").alias("Author"),
        F.concat(
            F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.org")
        ).alias("Email"),
        _message().alias("message"),
        F.concat(_text(day - F.expr("INTERVAL '1' DAY")), F.lit("+00:00")).alias("authored_date"),
        F.col("s_name").alias("Committer"),
        F.concat(_text(day), F.lit("+00:00")).alias("committed_date"),
        _int(1 + F.col("o_custkey") % 3).alias("number_of_branches"),
        (F.col("o_orderstatus") != "P").alias("in_main_branch"),
        (F.col("o_orderstatus") == "P").alias("merge_commit"),
        _int(F.col("n_files")).alias("number_of_mod_files"),
        "file_name",
        F.when(flag == "A", "ADD")
        .when(flag == "R", "DELETE")
        .when(renamed, "RENAME")
        .otherwise("MODIFY")
        .alias("file_change_type_name"),
        F.when(flag != "A", path).alias("file_old_path"),
        F.when(renamed, F.concat(F.lit("src/moved/"), "file_name")).when(flag != "R", path).alias("file_new_path"),
        _int(line % 5).alias("number_functions_before"),
        _int(size % 6).alias("number_functions_after"),
        _int(_int(F.col("l_quantity")) % 4).alias("number_functions_edited"),
        _int(F.col("l_quantity")).alias("number_lines_added"),
        _int(F.round(discount * 100)).alias("number_lines_removed"),
        _int(size * 10).alias("file_number_loc"),
        (~(size % 7).isin(4, 5)).alias("language_supported"),
        _int(size * 12).alias("file_size"),
        F.when(known, tax * 10).alias("dmm_unit_size"),
        F.when(known, discount * 10).alias("dmm_unit_complexity"),
        F.when(known, tax * 5 + discount * 5).alias("dmm_unit_interfacing"),
        _int(size).alias("file_complexity"),
        _int(size * 50).alias("tokens"),
    )


def mods_with_ext(spark: SparkSession, sf_dir: str, parts_last: bool = True) -> DataFrame:
    return mods(spark, sf_dir, parts_last).withColumn("file_ext", extension(F.col("file_name")))


def features(spark: SparkSession, sf_dir: str, parts_last: bool = True) -> DataFrame:
    return add_features(mods_with_ext(spark, sf_dir, parts_last))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested commits: one per order, with one to seven modifications written as an array.

    The source text of a modification is the order's priority text over as many
    lines as the position of the modification, so line counts can be checked.
    """
    order, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")

    def modification(i: Column) -> Column:
        name = F.concat(F.lit("file_"), _text(key % 1000), F.lit("_"), _text(i), F.lit(".py"))
        line = F.concat("o_orderpriority", F.lit("\n"))
        method = F.lit("m")
        return F.struct(
            name.alias("filename"),
            F.struct(F.lit("MODIFY").alias("name"), F.lit(5).alias("value")).alias("change_type"),
            F.concat(F.lit("src/"), name).alias("old_path"),
            F.concat(F.lit("src/"), name).alias("new_path"),
            F.array_repeat(method, _int((key + i) % 4)).alias("methods_before"),
            F.array_repeat(method, _int((key + i) % 6)).alias("methods"),
            F.array_repeat(method, _int(key % 3)).alias("changed_methods"),
            _int(key % 40 + i).alias("added"),
            _int(key % 11).alias("removed"),
            _int(key % 200).alias("nloc"),
            (key % 5 != 0).alias("language_supported"),
            F.when(key % 6 != 0, F.repeat(line, i)).alias("source_code"),
            _int(key % 17).alias("complexity"),
            _int(key % 900).alias("token_count"),
            F.transform(
                F.sequence(F.lit(1), i),
                lambda n: F.struct(n.alias("line_no"), F.concat(F.lit("line "), _text(n)).alias("text")),
            ).alias("diff_added"),
            F.array(F.struct(i.alias("line_no"), F.lit("old").alias("text"))).alias("diff_deleted"),
        )

    return order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("c"), _text(key)).alias("hash"),
        F.struct(
            F.col("c_name").alias("name"), F.concat("c_name", F.lit("@example.org")).alias("email")
        ).alias("author"),
        F.struct(F.col("c_mktsegment").alias("name")).alias("committer"),
        F.col("o_orderpriority").alias("msg"),
        F.col("o_orderdate").alias("author_date"),
        F.col("o_orderdate").alias("committer_date"),
        F.array_repeat(F.lit("b"), _int(1 + key % 3)).alias("branches"),
        (F.col("o_orderstatus") != "P").alias("in_main_branch"),
        (F.col("o_orderstatus") == "P").alias("merge"),
        (key % 10 / 10.0).alias("dmm_unit_size"),
        (key % 7 / 7.0).alias("dmm_unit_complexity"),
        F.lit(None).cast("double").alias("dmm_unit_interfacing"),
        F.transform(F.sequence(F.lit(1), _int(1 + key % 7)), modification).alias("modifications"),
    )


def line_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which commit last wrote each added line; two of the three texts that `mods_with_diff` has are known.

    Stand-in for version-control line history: the first commit that touched
    the file in the same year. Found by a partial-aggregating minimum.
    """
    rows = mods(spark, sf_dir).select("hash", "file_name", "file_new_path", "committed_date")
    year = F.substring("committed_date", 1, 4).alias("year")
    first = rows.groupBy("file_name", year).agg(
        F.substring_index(F.min(F.concat("committed_date", F.lit("|"), "hash")), "|", -1).alias("blame_hash")
    )
    return (
        rows.withColumn("year", year)
        .join(first, ["file_name", "year"])
        .where(F.col("file_new_path").isNotNull())
        .select(
            F.col("hash").alias("orig_hash"),
            F.col("file_new_path").alias("path"),
            F.explode(F.array(F.lit("line 0"), F.lit("line 2"))).alias("text"),
            "blame_hash",
        )
    )


def mods_with_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mods that carry the added lines of their diff: one to four lines, some of them alike."""
    lines = F.transform(
        F.sequence(F.lit(1), F.col("number_lines_added") % 4 + 1),
        lambda n: F.struct(n.alias("line_no"), F.concat(F.lit("line "), _text(n % 3)).alias("text")),
    )
    return mods(spark, sf_dir).withColumn("diff_added", lines)


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blame rows for every commit and file, self blame included."""
    return (
        line_history(spark, sf_dir)
        .select("orig_hash", "blame_hash", F.concat(F.lit("/repo/"), "path").alias("file"))
        .distinct()
    )
