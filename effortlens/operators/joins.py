"""Joins that stay safe when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.session import SMALL_ROWS, materialise, settle

# Keys are counted by the bucket of their hash, never one by one.
BUCKETS = 1 << 16
# A bucket is heavy if it holds more than one in so many rows: one that is 30 times the mean, for a hot key in it.
HEAVY = 2_000


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")


def heavy_buckets(big: DataFrame, keys: list[str], share: int = HEAVY) -> DataFrame:
    """(_bucket, _parts): key buckets that hold more than one in `share` rows, and how many such shares they fill.

    One pass that sums BUCKETS counts inside each task first, however many keys
    there are. Every key above the share is in a bucket found; fewer than `share` buckets are.
    """
    counts = materialise(big.groupBy(_bucket(keys)).agg(F.count("*").alias("n_rows")), "key-buckets")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    most = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = F.col("n_rows") * share / F.lit(max(total, 1))
    return counts.where(filled > 1).select("_bucket", F.least(F.ceil(filled), F.lit(most)).cast("int").alias("_parts"))


def join_lookup(
    big: DataFrame, lookup: DataFrame, keys: list[str], max_rows: int = SMALL_ROWS, written: str | None = None
) -> DataFrame:
    """Left join `big` with a `lookup` that has one row per key.

    The columns are those of `big`, then the others of `lookup`, at every size.
    The lookup is computed once. One that is small in rows and bytes (measured,
    never assumed) is broadcast, so `big` is not shuffled. A larger one is
    joined by a shuffle, and `big` is read twice: once to count its keys in buckets,
    once for the join. Rows of heavy buckets are dealt to as many parts as they fill, each of
    which gets its copy of the bucket's lookup rows, so no task gets a hot key whole.
    A bucket has a BUCKETS-th of the lookup: all copies are a few hundredths of it.
    A `big` that is costly is `written` under that name before it is read twice, and only then.
    """
    table, small = settle(lookup, "lookup", max_rows)
    values = [c for c in table.columns if c not in keys]
    if small:
        return big.join(F.broadcast(table), keys, "left").select(*big.columns, *values)

    if written is not None:
        big = materialise(big, written, compression="zstd")
    # Fewer than HEAVY rows of two numbers, whatever the tables.
    heavy = F.broadcast(heavy_buckets(big, keys, min(max_rows, HEAVY)))
    # Any part may hold any row, as each has the lookup row; so the task's number will do.
    part = F.coalesce(F.spark_partition_id() % F.col("_parts"), F.lit(0)).alias("_part")
    dealt = big.select("*", _bucket(keys)).join(heavy, "_bucket", "left").select(*big.columns, part)
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copied = table.select("*", _bucket(keys)).join(heavy, "_bucket", "left").select(
        *table.columns, F.explode(copies).alias("_part")
    )
    return dealt.join(copied, [*keys, "_part"], "left").select(*big.columns, *values)
