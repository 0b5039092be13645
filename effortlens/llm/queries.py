"""The operators of this folder applied to whole tables, and check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.llm import (
    alignment, bpe, chat, domain_scores, neighbours, repeats, secrets, sharding, simhash, tiling, toxicity, url_lists,
    whitening,
)
from effortlens.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(check: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if check is not None:
            CHECKS[query.__name__] = check
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[bytes, str]:
    """Content of the rank file, and the pattern."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def alignment_tokenizers() -> tuple[bytes, bytes]:
    """Content of the byte-level and of the piece vocabulary, a megabyte or two; tasks get it, not the paths."""
    import public_tokenizers

    return tuple(bpe.read_ranks(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def _bits(value: str) -> str:
    """The first 60 bits of an MD5 sum as text of 0s and 1s, in DuckDB."""
    return f"lpad(bin(('0x' || substr(md5({value}), 1, 15))::UBIGINT), 60, '0')"


@register(
    f"""
    WITH sizes AS (
      SELECT doc_id, {_bits("coalesce(doc_id::VARCHAR, '')")} || {_bits("coalesce(text, '')")} AS bits,
             coalesce(strlen(text), 0)::BIGINT AS bytes
      FROM documents
    ), depths AS (
      SELECT unnest(range(0, 61)) AS depth
    ), sums AS (
      SELECT substr(bits, 1, depth) AS shard, depth, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
      FROM sizes, depths GROUP BY ALL
    ), named AS (
      SELECT doc_id, min(depth) AS local_depth, min_by(shard, depth) AS shard, min_by(shard_rows, depth) AS shard_rows,
             min_by(shard_bytes, depth) AS shard_bytes
      FROM (SELECT *, substr(bits, 1, depth) AS shard FROM sizes, depths) JOIN sums USING (shard, depth)
      WHERE shard_bytes <= {sharding.BYTE_LIMIT} OR shard_rows = 1
      GROUP BY doc_id, bits
    )
    SELECT doc_id, shard, local_depth::INT AS local_depth, (SELECT max(local_depth) FROM named)::INT AS global_depth,
           shard_rows, shard_bytes, shard_bytes > {sharding.BYTE_LIMIT} AS oversized
    FROM named
    """
)
def op1_extendible_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@register()
def op2_learned_partitions(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@register()
def op3_run_length_dedup(spark, sf_dir):
    cut = repeats.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register()
def op4_toxicity_machine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (~toxicity.in_training()).alias("held_out"), toxicity.score(machine, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register()
def op5_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@register()
def op6_simhash_tiles(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@register()
def op7_byte_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), *tokenizer()))


@register()
def op8_cross_entropy_difference(spark, sf_dir):
    """Documents labelled as of good quality are the target."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return domain_scores.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@register()
def op9_greedy_tiling(spark, sf_dir):
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The given tables have no list and no times; both are derived from the pages: a page is fetched on
# a day that follows from its number, and a host, its parent domain or an address is listed by rules
# on the digest of its name.
_DAY = "date_add(DATE '2024-01-01', CAST((page_id * 7919) % 366 AS INT))"


def captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(_DAY).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """(pattern, action, listed_at): three dated entries for about half of the hosts, parent domains and addresses."""
    url = F.col("url")
    host = url_lists.host_of(url)
    names = pages.select(
        F.explode(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), url_lists.canonical(url))).alias("pattern")
    ).where("pattern IS NOT NULL AND pattern <> ''").distinct()
    digit = lambda i: F.conv(F.substring(F.md5(F.lower("pattern").cast("binary")), i, 2), 16, 10).cast("int")
    return names.where(digit(1) < 128).select(
        "pattern",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.element_at(F.array(*map(F.lit, ("block", "allow", "remove"))), digit(2 * i + 3) % 3 + 1).alias("action"),
                        F.date_add(F.lit("2024-01-01").cast("date"), 120 * i + digit(2 * i + 9) % 120).alias("listed_at"),
                    )
                    for i in range(3)
                ]
            )
        ).alias("entry"),
    ).select("pattern", "entry.*")


def _digit(i: int) -> str:
    return f"('0x' || substr(md5(lower(pattern)), {i}, 2))::INT"


_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '')"


@register(
    rf"""
    WITH captures AS (
      SELECT page_id, url, (DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INT))::DATE AS fetched_at, {_HOST} AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS rest
      FROM pages
    ), addresses AS (
      SELECT *, host || CASE WHEN rest = '' THEN '/' ELSE rest END AS address FROM captures
    ), names AS (
      SELECT DISTINCT unnest([host, regexp_extract(host, '([^.]+\.[^.]+)$', 1), address]) AS pattern FROM addresses
    ), entries AS (
      SELECT lower(pattern) AS pattern, i, (['block', 'allow', 'remove'])[CASE i WHEN 0 THEN {_digit(3)} WHEN 1 THEN {_digit(5)} ELSE {_digit(7)} END % 3 + 1] AS action,
             (DATE '2024-01-01' + (120 * i + CASE i WHEN 0 THEN {_digit(9)} WHEN 1 THEN {_digit(11)} ELSE {_digit(13)} END % 120)::INT)::DATE AS listed_at
      FROM names, (SELECT unnest([0, 1, 2]) AS i)
      WHERE pattern <> '' AND {_digit(1)} < 128
    ), spans AS (
      SELECT pattern, action, listed_at, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS until
      FROM (SELECT DISTINCT pattern, action, listed_at FROM entries)
    ), asked AS (
      SELECT page_id, url, fetched_at, k AS depth,
             lower(CASE WHEN k < n THEN array_to_string(labels[n - k : n], '.') ELSE address END) AS pattern
      FROM (SELECT *, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n FROM addresses) a,
           (SELECT unnest(range(0, 20)) AS k) WHERE k <= n
    ), best AS (
      SELECT page_id, url, fetched_at, max_by(action, depth) AS action, max_by(pattern, depth) AS pattern
      FROM asked JOIN spans USING (pattern)
      WHERE action <> 'remove' AND fetched_at >= listed_at AND (until IS NULL OR fetched_at < until)
      GROUP BY ALL
    )
    SELECT c.page_id, c.url, c.fetched_at, coalesce(b.action, 'none') AS verdict, b.pattern
    FROM captures c LEFT JOIN best b USING (page_id, url, fetched_at)
    """
)
def op10_temporal_url_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.judge(captures(pages), list_entries(pages))


@register()
def op11_token_alignment(spark, sf_dir):
    own = alignment_tokenizers()
    aligned = alignment.aligned_table(table(spark, sf_dir, "documents"), *own)
    return alignment.summary(aligned, alignment.link_counts(aligned), *own)


@register()
def op12_chat_windows(spark, sf_dir):
    """With conversation -7, which says control strings."""
    control = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        control.alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select(own.columns)
    formatted = materialise(chat.windows(given.unionByName(own)), "chat-windows")
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chat.read_back(formatted).select(
        "conv_id", F.struct("part", "window", F.array_join(said, "").alias("said"), F.array_join("targets", "").alias("loss")).alias("piece"),
        F.size("turns").cast("long").alias("n"),
    )
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.sum("n").alias("n_turns"))
    joined = lambda name: F.array_join(F.transform("pieces", lambda p: p[name]), "")
    chars = formatted.groupBy(F.col("conv_id").alias("conv")).agg(F.sum(F.length("text")).alias("formatted_chars"))
    texts = whole.select("conv_id", "n_turns", joined("said").alias("said"), joined("loss").alias("loss"))
    return texts.join(chars, F.col("conv_id").eqNullSafe(F.col("conv"))).select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


@register()
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))
