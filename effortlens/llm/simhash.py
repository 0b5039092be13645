"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid into tiles by the population counts of their four
16-bit lanes. Two fingerprints at `radius` or fewer differing bits differ by no
more than that in those counts altogether, so all other pairs of tiles are
skipped. Tile pairs that remain are compared exactly, every fingerprint of one
against every one of the other, by numpy's exclusive-or and bit count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.components import connected_components
from effortlens.session import materialise

RADIUS = 2
SHINGLE = 3
# Fixed value: the seed of the shingle hash.
SEED = 42
# Fingerprints in a block of a tile, at most about; a comparison holds ROWS x BLOCK words.
BLOCK = 4096
ROWS = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for first in range(0, n, 65_536):
        part = hashes[first : first + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of `docs`; fp is the fingerprint's 64 bits as a long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _lane(i: int) -> F.Column:
    return F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))


def _tile_shifts(radius: int) -> list[tuple[int, ...]]:
    return [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs (a[i], b[j]) connect, one per fingerprint at most."""
    nodes, at = np.unique(np.concatenate((a[i], b[j])), return_inverse=True)
    left, right = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("a"), batch.column("b")):
                a = left.values.to_numpy().view(np.uint64)
                b = right.values.to_numpy().view(np.uint64)
                ones, others = [], []
                for first in range(0, len(a), ROWS):
                    i, j = np.nonzero(np.bitwise_count(a[first : first + ROWS, None] ^ b[None, :]) <= radius)
                    differ = a[i + first] != b[j]
                    x, y = _forest(a, b, i[differ] + first, j[differ])
                    ones.append(x)
                    others.append(y)
                x, y = np.concatenate(ones), np.concatenate(others)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between `distinct` fingerprints (fp) that connect whatever lies within `radius` bits.

    Within a compared block pair, links are thinned to a spanning forest, so
    a dense group gives one link per member and not one per pair.
    """
    lanes = distinct.select("fp", *[_lane(i).cast("int").alias(f"t{i}") for i in range(4)])
    tile = ["t0", "t1", "t2", "t3"]
    # At most 17 to the power of 4 rows, whatever the input.
    sizes = lanes.groupBy(*tile).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    blocks = (
        lanes.join(F.broadcast(sizes), tile)
        .groupBy(*tile, F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = materialise(blocks, "simhash-tiles")
    # Half of the neighbour tiles, so that a pair of tiles meets once.
    shifts = [d for d in _tile_shifts(radius) if d >= (0, 0, 0, 0)]
    near = F.explode(F.array(*[F.struct(*[(F.col(t) + d).alias(t) for t, d in zip(tile, ds)]) for ds in shifts]))
    left = blocks.select(
        F.col("fps").alias("a"), F.col("part").alias("a_part"), F.struct(*tile).alias("home"), near.alias("tile")
    )
    right = blocks.select(F.struct(*tile).alias("tile"), F.col("part").alias("b_part"), F.col("fps").alias("b"))
    pairs = left.join(right, "tile").where("home <> tile OR a_part <= b_part").select("a", "b")
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text, any others).

    `component_id` is the smallest doc_id reached by links of `radius` or fewer
    differing bits. Null and empty texts have the fingerprint zero and are
    linked like any other; rows with a null doc_id take part and name no
    component unless they are alone, then component_id is null.
    """
    prints = materialise(fingerprints(docs), "simhash-fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    parts = connected_components(near_links(distinct.select("fp"), radius), "simhash-components")
    roots = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
