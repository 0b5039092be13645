"""Sharding by extendible hashing.

A row's hash is a string of bits: those of its key, then those of its content,
so that rows of one hot key can still be told apart. A directory is indexed by
the leading bits. A bucket whose rows exceed the byte limit, and only such a
bucket, is split on the next bit, until every bucket fits; its bits are the
shard's name and their number the local depth. Several directory entries lead to
one shard where its local depth is below the directory's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.session import materialise

BYTE_LIMIT = 1 << 20
# Bits looked at in one pass over the rows' sizes, and bits there are (two MD5 sums of 60 bits are used).
LEVEL_BITS = 12
HASH_BITS = 120


def _sixty_bits(value: Column) -> Column:
    """The first 60 bits of the MD5 sum, as 0s and 1s."""
    return F.lpad(F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 2), 60, "0")


def hash_bits(key: Column, content: Column) -> Column:
    """120 bits of a row; null key or content counts as empty text."""
    return F.concat(
        _sixty_bits(F.coalesce(key.cast("string"), F.lit(""))), _sixty_bits(F.coalesce(content, F.lit("")))
    )


def directory(sizes: DataFrame, byte_limit: int = BYTE_LIMIT, level_bits: int = LEVEL_BITS) -> DataFrame:
    """(shard, local_depth, shard_rows, shard_bytes, oversized) from `sizes` (bits, bytes).

    A pass sums the bytes under the next `level_bits` bits of the buckets that
    are still too large, so its rows are at most 2^level_bits per such bucket
    (and their prefixes), however many rows there are. A shard of rows equal in
    all bits, or of one row, may exceed the limit and says so in `oversized`.
    """
    done, open_rows, depth = None, sizes.withColumn("rows", F.lit(1).cast("long")), 0
    while True:
        last = min(depth + level_bits, HASH_BITS)
        cells = (
            open_rows.groupBy(F.substring("bits", 1, last).alias("cell"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        )
        lengths = F.sequence(F.lit(depth), F.lit(last))
        prefixes = (
            cells.select("bytes", "rows", F.explode(F.transform(lengths, lambda n: F.substring("cell", 1, n))).alias("shard"))
            .groupBy("shard")
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        )
        # A bucket is reached if the one above it was split: too large, and more than one row.
        prefixes = materialise(
            prefixes.withColumn("split", (F.col("shard_bytes") > byte_limit) & (F.col("shard_rows") > 1)), "sharding-level"
        )
        above = prefixes.where("split").select(F.col("shard").alias("parent"))
        reached = prefixes.where(F.length("shard") > depth).withColumn(
            "parent", F.expr("substring(shard, 1, length(shard) - 1)")
        ).join(above, "parent", "left_semi").drop("parent")
        if depth == 0:
            reached = reached.unionByName(prefixes.where(F.length("shard") == 0))
        final = reached.where(~F.col("split") | (F.length("shard") == HASH_BITS))
        done = final if done is None else done.unionByName(final)
        open_cells = prefixes.where(F.col("split") & (F.length("shard") == last)).select("shard")
        if last == HASH_BITS or open_cells.isEmpty():
            break
        open_rows = open_rows.withColumn("shard", F.substring("bits", 1, last)).join(open_cells, "shard", "left_semi").drop("shard")
        depth = last
    return done.select(
        "shard",
        F.length("shard").alias("local_depth"),
        "shard_rows",
        "shard_bytes",
        (F.col("shard_bytes") > byte_limit).alias("oversized"),
    )


def assign_shards(docs: DataFrame, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """(doc_id, shard, local_depth, global_depth, shard_rows, shard_bytes, oversized) for every row.

    `docs` has (doc_id, text); other columns are ignored. The size of a row is
    that of its text in bytes, zero for null. Repeated rows stay together. An
    empty table has no shards.
    """
    sizes = materialise(
        docs.select(
            "doc_id",
            hash_bits(F.col("doc_id"), F.col("text")).alias("bits"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        ),
        "sharding-sizes",
    )
    shards = materialise(directory(sizes.select("bits", "bytes"), byte_limit), "sharding-directory")
    depths = [r[0] for r in shards.select("local_depth").distinct().collect()]  # HASH_BITS + 1 rows at most
    # Shards of different depths never share a prefix: one of a row's prefixes is a shard.
    names = sizes.withColumn("shard", F.explode(F.array(*[F.substring("bits", 1, d) for d in sorted(depths)] or [F.lit("")])))
    return names.join(shards, "shard").select(
        "doc_id", "shard", "local_depth", F.lit(max(depths, default=0)).alias("global_depth"), "shard_rows", "shard_bytes", "oversized"
    )


def write_shards(docs: DataFrame, path: str, byte_limit: int = BYTE_LIMIT) -> None:
    """Write all columns of `docs` as Parquet, one folder per shard. Rows without an id are told apart by their text."""
    text = F.coalesce("text", F.lit(""))
    bits = hash_bits(F.col("doc_id"), F.col("text"))
    sizes = materialise(docs.select(bits.alias("bits"), F.octet_length(text).cast("long").alias("bytes")), "sharding-sizes")
    shards = materialise(directory(sizes, byte_limit).select("shard", "local_depth"), "sharding-directory")
    depths = sorted(r[0] for r in shards.select("local_depth").distinct().collect())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(row, F.explode(F.array(*[F.substring(bits, 1, d) for d in depths] or [F.lit("")])).alias("shard"))
    placed = named.join(shards, "shard", "left_semi")
    flat = placed.select("row.*", F.concat(F.lit("b"), "shard").alias("__shard"))
    flat.repartition("__shard").write.partitionBy("__shard").parquet(path)
