"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background, which is what lies outside
it, share one vocabulary: every word of the corpus, with its share in all documents. A
word's probability mixes its share in the model's text with that; a pair's share falls
back on the word's, the more the rarer its first word.

The models are matched: of the longer of the two, documents are drawn by hash until
both have the same number of words, as nearly as documents allow; the counts are scaled for the
rest. A model of more text would know more words, and whatever is ordinary would look like it.
Counts alone, scaled, do not mend that. A document's score is the mean over its words
of target loss minus background loss, in nats: the lower, the more like the target.

A document is never scored by its own words: they are taken off the counts of the model
that has them.

The models stay distributed: no table of words or pairs is ever in one place.
Documents are dealt to groups; a group sends its distinct words and pairs with
their counts to buckets by hash, a bucket sums them over all groups and sends each
group the sums of what it named, in the same order. With these the group scores
its documents.

    documents, in groups --- words, pairs, counts ---> buckets: sums
    the same groups  <--- sums of what the group named --- : scores

A word in all documents comes once from each group, so no bucket holds more for
being hot. Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.arrays import blocks, gram_hashes, utf8, word_hashes
from effortlens.llm.repeats import _gaps, _pack, _unpack
from effortlens.session import materialise

# Weight of the whole corpus's word shares in a word's probability.
SHARED = 0.2
# Occurrences of a first word at which a pair's own share and the fallback weigh the same.
BACKING = 4.0
# Distinct hashes gathered before they are summed.
GATHER = 1 << 20
# Groups and buckets per shuffle partition.
GROUPS, BUCKETS = 2, 1

# `packed` holds word keys and their five counts, pair keys and their two.
_ASKS = "bucket int, group int, n_words int, n_pairs int, packed binary"
# `packed` holds the counts alone.
_SUMS = _ASKS
# What a document is counted in.
TARGET, BACKGROUND, NEITHER = 0, 1, 2
_SCORES = "doc_id long, n_words long, score double"


def _table(columns: list[list], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


def _empty(schema: str) -> pa.Table:
    return _table([[] for _ in schema.split(", ")], schema)


# --- counts --------------------------------------------------------------------


class _Counts:
    """Distinct keys in order, and the sums of `width` counts of each."""

    def __init__(self, width: int):
        self.keys, self.counts, self.size = [np.zeros(0, np.uint64)], [np.zeros((width, 0), np.int64)], 0

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> None:
        self._put(*_summed(keys, np.stack(counts)))
        if self.size > 4 * GATHER:
            self._put(*self.sums(), anew=True)

    def _put(self, keys: np.ndarray, counts: np.ndarray, anew: bool = False) -> None:
        if anew:
            self.keys, self.counts, self.size = [], [], 0
        self.keys.append(keys)
        self.counts.append(counts)
        # What is summed already does not call for another sum.
        self.size += 0 if anew else len(keys)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate(self.keys), np.concatenate(self.counts, axis=1))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, c, len(found)) for c in counts]).astype(np.int64)


def _texts(group: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word, row, pair, place of the pair's first word) of a group, block by block; a row lies in one block."""
    data, offsets = utf8(group.column("text"))
    for first, last in blocks(offsets):
        part = offsets[first : last + 1]
        words, rows = word_hashes(data[part[0] : part[-1]], part - part[0])
        pairs, at = gram_hashes(words, rows, 2)
        yield words, rows + first, pairs, at


def _members(group: pa.Table) -> np.ndarray:
    """1 where a row is counted, for either model."""
    model = group.column("model").to_numpy()
    return np.stack([model == TARGET, model == BACKGROUND]).astype(np.int64)


def _counted(group: pa.Table) -> tuple[np.ndarray, ...]:
    """(words, their counts in either model, in both as a text's last word, and in all text; pairs, their counts)."""
    members = _members(group)
    words, pairs = _Counts(5), _Counts(2)
    for found, rows, both, at in _texts(group):
        mine, ends = members[:, rows], np.ones(len(found), np.int64)
        ends[at] = 0
        words.add(found, *mine, *(mine * ends), np.ones_like(ends))
        pairs.add(both, *mine[:, at])
    return *words.sums(), *pairs.sums()


# --- the passes ------------------------------------------------------------------


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket.astype(np.int64), np.arange(buckets + 1))


def _asks(name: int, counted: tuple[np.ndarray, ...], buckets: int) -> pa.Table:
    words, word_counts, pairs, pair_counts = counted
    word_edges, pair_edges = _edges(words, buckets), _edges(pairs, buckets)
    columns: list[list] = [[], [], [], [], []]
    for bucket in range(buckets):
        w, p = (slice(e[bucket], e[bucket + 1]) for e in (word_edges, pair_edges))
        n_words, n_pairs = w.stop - w.start, p.stop - p.start
        if n_words or n_pairs:
            packed = _pack(
                _gaps(words[w]), word_counts[:, w].reshape(-1), _gaps(pairs[p]), pair_counts[:, p].reshape(-1)
            )
            for column, value in zip(columns, (bucket, name, n_words, n_pairs, packed)):
                column.append(value)
    return _table(columns, _ASKS)


def _ask_pass(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        return _asks(group.column("group")[0].as_py(), _counted(group), buckets)

    return run


def _sum_pass(table: pa.Table) -> pa.Table:
    """Sums of a bucket's words and pairs, to the groups that named them."""
    names, parts = [], []
    for group, n, m, packed in zip(*(table.column(c).to_pylist() for c in ("group", "n_words", "n_pairs", "packed"))):
        words, word_counts, pairs, pair_counts = _unpack(
            packed, (np.uint64, n), (np.int64, 5 * n), (np.uint64, m), (np.int64, 2 * m)
        )
        names.append(group)
        parts.append((np.cumsum(words, dtype=np.uint64), word_counts.reshape(5, n), np.cumsum(pairs, dtype=np.uint64), pair_counts.reshape(2, m)))
    sums, places = [], []
    for i in (0, 2):
        found, at = np.unique(np.concatenate([p[i] for p in parts]), return_inverse=True)
        counts = np.concatenate([p[i + 1] for p in parts], axis=1)
        sums.append(np.stack([np.bincount(at, c, len(found)) for c in counts]).astype(np.int64))
        places.append(np.split(at, np.cumsum([len(p[i]) for p in parts])[:-1]))
    parts.clear()
    bucket = table.column("bucket")[0].as_py()
    rows = [
        (bucket, group, len(w), len(p), _pack(sums[0][:, w].reshape(-1), sums[1][:, p].reshape(-1)))
        for group, w, p in zip(names, *places)
    ]
    return _table([list(c) for c in zip(*rows)], _SUMS)


def _read_sums(sums: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the group's words in order, and of its pairs."""
    words, pairs = [np.zeros((5, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    for a, b, packed in zip(*(sums.sort_by("bucket").column(c).to_pylist() for c in ("n_words", "n_pairs", "packed"))):
        w, p = _unpack(packed, (np.int64, 5 * a), (np.int64, 2 * b))
        words.append(w.reshape(5, a))
        pairs.append(p.reshape(2, b))
    return np.concatenate(words, axis=1), np.concatenate(pairs, axis=1)


def _own(rows: np.ndarray, keys: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, how often it occurs) of every occurrence of a key in a row."""
    _, cell, n = np.unique(rows * n_keys + keys, return_inverse=True, return_counts=True)
    return cell, n[cell]


def _score_pass(sizes: tuple[int, int], n_all: int, shared: float, backing: float):
    n = np.array(sizes)[:, None]

    def run(group: pa.Table, sums: pa.Table) -> pa.Table:
        if not len(group):
            return _empty(_SCORES)
        words, _, pairs, _ = _counted(group)
        word_sums, pair_sums = _read_sums(sums)
        alone, leading, members = word_sums[:2], word_sums[:2] - word_sums[2:4], _members(group)
        n_words, loss = np.zeros(len(group), np.int64), np.zeros(len(group))
        for found, rows, both, at in _texts(group):
            w = np.searchsorted(words, found)
            length = np.bincount(rows, minlength=len(group))
            cell, own = _own(rows, w, len(words))
            # The model that has the row, and its size without the row.
            mine = members[:, rows]
            size = n - mine * length[rows]
            whole = word_sums[4, w] / n_all
            p = (1 - shared) * np.where(size > 0, (alone[:, w] - mine * own) / np.maximum(size, 1), whole) + shared * whole
            if len(at):
                own_leads = np.bincount(cell[at], minlength=int(cell.max()) + 1)[cell[at]]
                pair = np.searchsorted(pairs, both)
                matched = (size.min(axis=0) / np.maximum(size, 1))[:, at]
                before = matched * (leading[:, w[at]] - mine[:, at] * own_leads)
                seen = matched * (pair_sums[:, pair] - mine[:, at] * _own(rows[at], pair, len(pairs))[1])
                p[:, at + 1] = (seen + backing * p[:, at + 1]) / (before + backing)
            n_words += length
            loss += np.bincount(rows, np.log(p[1]) - np.log(p[0]), len(group))
        score = pa.array(loss / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.table({"doc_id": group.column("doc_id"), "n_words": pa.array(n_words), "score": score})

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of every row."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        n = np.zeros(len(batch), np.int64)
        for first, last in blocks(offsets):
            part = offsets[first : last + 1]
            n[first:last] = np.bincount(word_hashes(data[part[0] : part[-1]], part - part[0])[1], minlength=last - first)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(n)], ["doc_id", "draw", "n"])


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, shared: float = SHARED, backing: float = BACKING
) -> DataFrame:
    """(doc_id, n_words, score) for every row of `docs` (doc_id, text, any others).

    `target_ids` (doc_id) names the target's documents; ids that occur twice,
    are null, or have no document change nothing. A null or empty text, or one
    without words, has a null score and no words. A repeated row is a document of its
    own: the others' words stay in the models; rows equal in id and text are drawn together.
    With an empty target, or nothing outside it, both models have the word shares of the whole corpus.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = GROUPS * partitions, BUCKETS * partitions
    flags = target_ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("in_target", F.lit(True))
    place = F.xxhash64("doc_id", F.xxhash64("text"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"place": place, "draw": F.pmod(F.xxhash64(F.lit("draw"), place), F.lit(1 << 30)) / float(1 << 30)}
    )
    inside = F.coalesce("in_target", F.lit(False))
    lengths = given.select("doc_id", "draw", "text").mapInArrow(_lengths, "doc_id long, draw double, n long")
    drawn = lengths.groupBy("doc_id", "draw").agg(F.sum("n").alias("n")).join(flags, "doc_id", "left")
    known = materialise(drawn.select("draw", "n", inside.alias("inside")), "lm-lengths")
    both = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in (F.col("inside"), ~F.col("inside"))]
    long = known.agg(*both).first()
    # Each document of the longer side is in its model if its hash falls into the share of the shorter.
    shares = [min(long) / max(n, 1) for n in long]
    kept = F.col("draw") < F.when(F.col("inside"), shares[0]).otherwise(shares[1])
    sizes = tuple(known.where(kept).agg(*both).first())
    # The target may be as large as the corpus: a sorted join at every size, never a broadcast.
    texts = given.join(flags.hint("merge"), "doc_id", "left").withColumn("inside", inside).select(
        F.pmod("place", F.lit(groups)).cast("int").alias("group"),
        "doc_id",
        F.when(~kept, NEITHER).when(F.col("inside"), TARGET).otherwise(BACKGROUND).alias("model"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by_group = texts.groupBy("group")
    sums = by_group.applyInArrow(_ask_pass(buckets), _ASKS).groupBy("bucket").applyInArrow(_sum_pass, _SUMS)
    return by_group.cogroup(sums.groupBy("group")).applyInArrow(_score_pass(sizes, sum(long), shared, backing), _SCORES)
