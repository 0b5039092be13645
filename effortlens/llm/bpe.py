"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Every chunk is
pre-tokenised by itself, so the chunks of one long text run in parallel. Where a
boundary of a chunk meets a boundary of the chunk before it inside their
overlap, both go on alike from there: the cut is moved to that boundary, and the
pieces between such boundaries are encoded independently of each other.
Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortlens.llm.arrays import blocks, utf8

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 2_048
# The pattern looks at most this many characters past a token before it decides the token's end.
LOOK_AHEAD = 4

_ENCODINGS: dict[tuple[int, str], tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file's content, built once per process."""
    key = (hash(ranks), pattern)
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


def read_ranks(path: str) -> bytes:
    """A vocabulary has tens of thousands of entries, under a megabyte; tasks get its content, not its path."""
    with open(path, "rb") as file:
        return file.read()


def _arrays(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encoder(ranks: bytes, pattern: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks, pattern)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets):
                part = batch.slice(first, last - first)
                ids = [own.encode_ordinary(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), _arrays(ids), pa.array([own.decode_bytes(x) for x in ids], pa.binary())],
                    [*keys, "ids", "decoded"],
                )

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Boundaries in the first and the last `overlap` characters of each chunk, both counted from the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                sure = len(text) - LOOK_AHEAD
                ends = [e for m in own.finditer(text) if (e := m.end()) <= sure]
                heads.append([e for e in ends if e < overlap])
                tails.append([e - chunk for e in ends if e >= chunk])
            names = [n for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*batch.columns, _arrays(heads), _arrays(tails)], [*names, "head", "tail"])

    return run


def stitched_pieces(texts: DataFrame, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, piece, text): texts cut where pre-token boundaries are sure. `texts` has (key, text), key unique.

    A chunk without a common boundary in its overlap (a run of thousands of
    letters, say) is put together with what precedes it, and so is the rest of
    that text: what was not confirmed is encoded in sequence.
    """
    cut = texts.select(
        "key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / chunk).cast("int")),
                lambda i: F.substring("text", i * chunk + 1, F.lit(chunk + overlap)),
            )
        ).alias("chunk", "text"),
    )
    marked = cut.mapInArrow(
        _boundaries(pattern, chunk, overlap), "key string, chunk int, text string, head array<int>, tail array<int>"
    )
    by_text = Window.partitionBy("key").orderBy("chunk")
    synced = marked.withColumn("sync", F.array_min(F.array_intersect("head", F.lag("tail").over(by_text))))
    synced = synced.withColumn("sync", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("sync")))
    sure = synced.withColumn(
        "sync", F.when(F.min(F.col("sync").isNotNull()).over(by_text), F.col("sync"))
    ).withColumn("next", F.lead("sync").over(by_text))
    first = F.coalesce("sync", F.lit(0))
    own = F.substring("text", first + 1, F.lit(chunk) + F.coalesce("next", F.lit(0)) - first)
    pieces = sure.withColumn("piece", F.count("sync").over(by_text)).select("key", "piece", "chunk", own.alias("text"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]))
    return pieces.groupBy("key", "piece").agg(joined.alias("text"))


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(doc_id, ids, decoded) for every row of `docs` (doc_id, text, any others); `keep` names the columns kept beside `ids` and `decoded`.

    `ids` are the token ids of the whole text, `decoded` the bytes that decoding
    the ids gives. A null text counts as empty and has no ids. Repeated rows
    give repeated results; null ids of documents are kept.
    """
    kept = [f"_kept{i}" for i in range(len(keep))]
    types = [docs.schema[name].dataType.simpleString() for name in keep]
    texts = docs.select(*[F.col(f"`{name}`").alias(k) for name, k in zip(keep, kept)], F.coalesce("text", F.lit("")).alias("text"))
    one = texts.where(F.length("text") <= chunk)
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(kept, types)), "ids array<int>", "decoded binary"])
    short = one.mapInArrow(_encoder(ranks, pattern, kept), schema)

    # Equal long texts are worked on once.
    long = texts.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    # Two rows of one key have equal texts, so any of them stands for all.
    pieces = stitched_pieces(long.select("key", "text").dropDuplicates(["key"]), pattern, chunk, overlap)
    encoded = pieces.mapInArrow(
        _encoder(ranks, pattern, ["key", "piece"]), "key string, piece long, ids array<int>, decoded binary"
    )
    whole = encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("pieces"))
    decoded = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["decoded"]))
    texts_done = whole.select("key", F.flatten(F.transform("pieces", lambda x: x["ids"])).alias("ids"), decoded.alias("decoded"))
    long_ids = long.select("key", *kept).join(texts_done, "key").select(*kept, "ids", "decoded")
    return short.unionByName(long_ids).select(*[F.col(k).alias(name) for k, name in zip(kept, keep)], "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode`'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
