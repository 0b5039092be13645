"""Benchmark decontamination by greedy string tiling.

Texts are word sequences. Runs of `MIN_MATCH` words that a document shares with
a benchmark item are the seeds; an equi-join of seeds names the pairs worth a
look. For such a pair, running Karp-Rabin hashes find the common word runs; the
longest are marked first, no word twice, down to runs of `MIN_MATCH` words. The
marked share of the item's words is the coverage. It does not depend on the
order of the runs, so reordered passages count in full. An item too short for a
seed is looked up whole: it covers the texts that have just its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.arrays import blocks, gram_hashes, powers, utf8, word_hashes
from effortlens.session import materialise

MIN_MATCH = 5
COVERAGE = 0.5
# Bits of the seed filter that every task gets (2 MB), whatever the number of seeds.
FILTER_BITS = 1 << 24
# Words of the longest runs looked for first; longer ones are found as well, as matches are extended.
FIRST_SEARCH = 32


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _short(words: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of the rows of fewer than `k` words, number of them for each row; longer rows have none)."""
    sizes = np.bincount(rows, minlength=n)
    return words[sizes[rows] < k], np.where(sizes < k, sizes, 0)


def _item_grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            words, rows = word_hashes(data, offsets)
            grams, at = gram_hashes(words, rows, k)
            n = len(batch)
            short, lengths = _short(words, rows, n, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item"),
                    pa.array(np.bincount(rows, minlength=n).astype(np.int32)),
                    _lists(grams.view(np.int64), np.bincount(rows[at], minlength=n), pa.int64()),
                    _lists(short.view(np.int64), lengths, pa.int64()),
                ],
                ["item", "n_words", "grams", "words"],
            )

    return run


def _shared_grams(k: int, words_of_filter: np.ndarray):
    """Rows with seeds that pass the filter: their word positions and hashes. Rows too short for a seed: their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words_of_filter
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets):
                part = offsets[first : last + 1]
                words, rows = word_hashes(data[part[0] : part[-1]], part - part[0])
                grams, at = gram_hashes(words, rows, k)
                bit = grams & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero((table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                n = last - first
                short, lengths = _short(words, rows, n, k)
                if not len(hit) and not len(short):
                    continue
                row = rows[at[hit]]
                begins = np.searchsorted(rows, np.arange(n))
                sizes = np.bincount(row, minlength=n)
                found = np.flatnonzero(sizes + lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first).take(pa.array(found)),
                        batch.column("doc").slice(first, last - first).take(pa.array(found)),
                        _lists((at[hit] - begins[row]).astype(np.int32), sizes[found], pa.int32()),
                        _lists(grams[hit].view(np.int64), sizes[found], pa.int64()),
                        _lists(short.view(np.int64), lengths[found], pa.int64()),
                    ],
                    ["doc_id", "doc", "at", "grams", "words"],
                )

    return run


class _Side:
    """One word sequence given by its seeds: places, hashes, and which words are marked."""

    def __init__(self, at: np.ndarray, grams: np.ndarray, n_words: int, k: int):
        self.at, self.grams, self.k = at, grams, k
        self.marked = np.zeros(n_words + 1, np.int64)
        up, self.down = powers(len(at) + 1)
        self.sums = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(grams.view(np.uint64) * up[: len(at)], out=self.sums[1:])

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first seed, running hash) of every run of `s` unmarked words made of shared seeds."""
        m = s - self.k + 1
        if m > len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        i = np.arange(len(self.at) - m + 1)
        before = np.concatenate(([0], np.cumsum(self.marked)))
        whole = (self.at[i + m - 1] - self.at[i] == m - 1) & (before[self.at[i] + s] == before[self.at[i]])
        i = i[whole]
        return i, (self.sums[i + m] - self.sums[i]) * self.down[i]

    def free(self, place: int) -> bool:
        return not self.marked[place]


def _matches(doc: _Side, item: _Side, s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of `s` words or more: (length, place in the document, place in the item)."""
    k = doc.k
    table: dict[int, list[int]] = {}
    for i, h in zip(*(x.tolist() for x in item.windows(s))):
        table.setdefault(h, []).append(i)
    found = []
    starts = set()
    for i, h in zip(*(x.tolist() for x in doc.windows(s))):
        for j in table.get(h, ()):
            p, b = int(doc.at[i]), int(item.at[j])
            starts.add((p, b))
            if (p - 1, b - 1) in starts:
                continue  # part of a run found one word earlier
            length, x, y = k, i, j
            if doc.grams[x] != item.grams[y]:
                continue
            while (
                x + 1 < len(doc.at) and y + 1 < len(item.at)
                and doc.at[x + 1] == doc.at[x] + 1 and item.at[y + 1] == item.at[y] + 1
                and doc.grams[x + 1] == item.grams[y + 1]
                and doc.free(p + length) and item.free(b + length)
            ):
                x, y, length = x + 1, y + 1, length + 1
            if length >= s:
                found.append((length, p, b))
    return found


def greedy_tiles(
    doc_at: np.ndarray, doc_grams: np.ndarray, item_grams: np.ndarray, k: int = MIN_MATCH, first: int = FIRST_SEARCH
) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words), longest first, ties by place."""
    doc = _Side(doc_at, doc_grams, int(doc_at[-1]) + k, k)
    item = _Side(np.arange(len(item_grams)), item_grams, len(item_grams) + k - 1, k)
    tiles, s = [], max(first, k)
    while True:
        found = _matches(doc, item, s)
        # What these overlap is cut short and found again in the next turn, with shorter matches.
        longest = max((m[0] for m in found), default=0)
        for length, p, b in sorted(m for m in found if m[0] == longest):
            if not doc.marked[p : p + length].any() and not item.marked[b : b + length].any():
                doc.marked[p : p + length] = item.marked[b : b + length] = 1
                tiles.append((p, b, length))
        if not found:
            if s == k:
                return tiles
            s = max(k, s // 2)


def _tile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, counts = [], []
            for at, grams, item in zip(batch.column("at"), batch.column("grams"), batch.column("item_grams")):
                tiles = greedy_tiles(at.values.to_numpy(), grams.values.to_numpy(), item.values.to_numpy(), k)
                covered.append(sum(t[2] for t in tiles))
                counts.append(len(tiles))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("item"), pa.array(covered, pa.int32()), pa.array(counts, pa.int32())],
                ["doc", "item", "n_matched", "n_tiles"],
            )

    return run


def seed_filter(grams: DataFrame) -> np.ndarray:
    """The seeds' low bits as a bit table of fixed size; `grams` has (gram)."""
    cells = grams.groupBy(F.expr(f"(gram & {FILTER_BITS - 1}) >> 6").alias("cell")).agg(
        F.expr("bit_or(1L << cast(gram & 63 AS INT))").alias("bits")
    )
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for cell, bits in cells.collect():  # FILTER_BITS / 64 rows at most
        table[cell] = bits
    return table.view(np.uint64)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH
) -> DataFrame:
    """(doc_id, item_id, n_words, n_matched, n_tiles, coverage) of every pair that reaches `coverage`.

    `docs` has (doc_id, text), `benchmark` (item_id, text); other columns are
    ignored. Null and empty texts match nothing. Items of fewer than `k` words
    match texts of the same words in the same order and no others (a run of so
    few words inside a longer text tells nothing). Rows that repeat an id count as further texts of that id; the best
    covered pair is returned once. Null ids are kept as null.
    """
    items = benchmark.select("item_id", F.md5(F.coalesce("text", F.lit(""))).alias("item"), "text")
    sequences = materialise(
        items.dropDuplicates(["item"]).select("item", "text").mapInArrow(
            _item_grams(k), "item string, n_words int, grams array<long>, words array<long>"
        ).where(F.col("n_words") > 0),
        "tiling-items",
    )
    item_grams = sequences.select("item", "n_words", F.explode("grams").alias("gram"))
    table = seed_filter(item_grams.select("gram"))

    shared = materialise(
        docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("doc"), "text").mapInArrow(
            _shared_grams(k, table), "doc_id long, doc string, at array<int>, grams array<long>, words array<long>"
        ),
        "tiling-documents",
    )
    # Equal texts are tiled once.
    texts = shared.where(F.size("grams") > 0).select("doc", "at", "grams").dropDuplicates(["doc"])
    places = item_grams.groupBy("gram", "item").agg(F.count("*").alias("places"), F.first("n_words").alias("n_words"))
    seeds = texts.select("doc", F.explode(F.array_distinct("grams")).alias("gram"))
    pairs = (
        seeds.join(places, "gram")
        .groupBy("doc", "item")
        .agg(F.sum("places").alias("places"), F.first("n_words").alias("n_words"))
        # A place covers k words at most: pairs below cannot reach the threshold.
        .where(F.col("places") * k >= F.col("n_words") * coverage)
        .select("doc", "item")
    )
    tiled = (
        pairs.join(texts, "doc")
        .join(sequences.select("item", F.col("grams").alias("item_grams")), "item")
        .mapInArrow(_tile(k), "doc string, item string, n_matched int, n_tiles int")
    )
    best = (
        tiled.join(sequences.select("item", "n_words"), "item")
        .withColumn("coverage", F.col("n_matched") / F.col("n_words"))
        .where(F.col("coverage") >= coverage)
    )
    brief = shared.where(F.size("words") > 0).select("doc", "words").dropDuplicates(["doc"]).join(
        sequences.where(F.size("words") > 0).select("item", "n_words", "words"), "words"
    )
    whole = brief.select(
        "doc", "item", F.col("n_words").alias("n_matched"), F.lit(1).alias("n_tiles"), "n_words", F.lit(1.0).alias("coverage")
    )
    named = best.unionByName(whole).join(items.select("item_id", "item").distinct(), "item").join(
        shared.select("doc_id", "doc").distinct(), "doc"
    )
    found = F.max(F.struct("coverage", "n_matched", "n_words", -F.col("n_tiles"))).alias("m")
    return named.groupBy("doc_id", "item_id").agg(found).select(
        "doc_id",
        "item_id",
        F.col("m.n_words").alias("n_words"),
        F.col("m.n_matched").alias("n_matched"),
        (-F.col("m.col4")).alias("n_tiles"),
        F.col("m.coverage").alias("coverage"),
    )
