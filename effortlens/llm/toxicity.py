"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of longer words, hashed to 30
bits; a term's value grows with the number of different words that give it and
with the term's rarity. The machine has a weight per term and, by a short vector per term, a weight per pair
of terms: an insult counts for more beside the mention of a group, a word part
for less in a long text. A linear model has no such products.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortlens.session import materialise

# Labelled rows the machine is fitted on, at most; those with the least hash of their id.
TRAIN_ROWS = 10_000
# Terms the machine keeps: those whose presence depends most on the label, and the most frequent ones,
# which may tell something only together with another.
TERMS = 1024
FREQUENT_TERMS = 64
FACTORS = 8
EPOCHS = 60
# Machines fitted from different starts; their mean is a machine again, with the factors of all.
STARTS = 3
_HASH_MASK = (1 << 30) - 1
_PREFIXES = range(4, 11)
# Length classes of a text: bit length of its number of different words.
_LENGTHS = 24
# Words remembered with their terms by a task, at most.
KNOWN_WORDS = 100_000
_WORD = re.compile(r"\w+")


def _ids(word: bytes) -> list[int]:
    """Hashed terms of a word: itself and its beginnings."""
    out = [zlib.crc32(word) & _HASH_MASK]
    out += [zlib.crc32(word[:n], n) & _HASH_MASK for n in _PREFIXES if n < len(word)]
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """A fitted machine: bias; scale, weight and factors per kept term (length classes come last)."""

    terms: dict[int, int]
    bias: float
    scales: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def features(self, text: str | None, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the kept terms in a text. `known` remembers words seen before."""
        words, counts = words_of(text), {}
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in words:
            places = known.get(word)
            if places is None:
                places = tuple(p for i in _ids(word.encode()) if (p := self.terms.get(i)) is not None)
                known[word] = places
            for p in places:
                counts[p] = counts.get(p, 0) + 1
        at = np.fromiter([*counts, len(self.terms) + min(len(words).bit_length(), _LENGTHS - 1)], np.int64)
        values = np.log2(1.0 + np.fromiter([*counts.values(), 1], np.float64))
        return at, values

    def probability(self, at: np.ndarray, values: np.ndarray) -> float:
        v, values = self.factors[at], values * self.scales[at]
        pairs = ((values @ v) ** 2 - (values**2) @ (v**2)).sum() / 2
        z = self.bias + values @ self.weights[at] + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit_machine(
    terms: list[int], rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
    factors: int = FACTORS, epochs: int = EPOCHS, starts: int = STARTS, seed: int = 7,
) -> Machine:
    """Adam on the logistic loss over (places, values) rows. Without rows of both labels, all scores are the share of label 1."""
    n = len(terms) + _LENGTHS
    seen = np.bincount(np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, np.int64), minlength=n)
    scales = np.sqrt(np.log((len(rows) + 1) / (seen + 1)))
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
    bias, weights, vectors = float(np.log(share / (1 - share))), np.zeros(n), np.zeros((n, factors * starts))
    if len(labels) and 0 < labels.mean() < 1:
        table = np.zeros((len(rows), n))
        for r, (at, values) in enumerate(rows):
            table[r, at] = values * scales[at]
        fits = [_descend(table, labels, bias, factors, epochs, np.random.default_rng(seed + i)) for i in range(starts)]
        bias += sum(float(b[0]) for b, _, _ in fits) / starts
        weights = sum(w for _, w, _ in fits) / starts
        # A product of factors is a mean over machines once each is divided by the root of their number.
        vectors = np.concatenate([v for _, _, v in fits], axis=1) / np.sqrt(starts)
    return Machine({t: i for i, t in enumerate(terms)}, bias, scales, weights, vectors)


def _descend(
    table: np.ndarray, labels: np.ndarray, bias: float, factors: int, epochs: int, rng: np.random.Generator
) -> list[np.ndarray]:
    """Change of the bias, weights and factors after `epochs` passes over the rows in random order."""
    state = [np.zeros(1), np.zeros(table.shape[1]), rng.normal(0, 0.05, (table.shape[1], factors))]
    w, v = state[1:]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    step, batch = 0, 128
    for _ in range(epochs):
        order = rng.permutation(len(table))
        for start in range(0, len(table), batch):
            chosen = order[start : start + batch]
            x = table[chosen]
            xv, x2 = x @ v, x**2
            z = bias + state[0][0] + x @ w + (xv**2 - x2 @ v**2).sum(1) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[chosen]) / len(chosen)
            grads = [
                np.array([g.sum()]),
                x.T @ g + 1e-4 * w,
                x.T @ (g[:, None] * xv) - (x2.T @ g)[:, None] * v + 1e-3 * v,
            ]
            step += 1
            for s, d, a, b in zip(state, grads, first, second):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                s -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return state


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text is not divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _term_counts(batches):
    for batch in batches:
        ids, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = np.unique(np.fromiter((i for w in words_of(text) for i in _ids(w.encode())), np.int64))
            ids.append(own)
            toxic.append(np.full(len(own), label, np.int64))
        terms, at = np.unique(np.concatenate(ids), return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms),
                pa.array(np.bincount(at, np.concatenate(toxic), len(terms)).astype(np.int64)),
                pa.array(np.bincount(at, minlength=len(terms))),
            ],
            ["term", "toxic", "rows"],
        )


def _features(machine: Machine):
    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            pairs = [machine.features(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([p[0] for p in pairs], pa.list_(pa.int64())),
                    pa.array([p[1] for p in pairs], pa.list_(pa.float64())),
                ],
                ["toxic", "at", "values"],
            )

    return run


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: int = TERMS,
    frequent_terms: int = FREQUENT_TERMS,
) -> Machine:
    """Fit on documents whose id is labelled and in the training fold.

    A document with several labels is toxic if one of them says so; null labels
    and labels without a document are ignored. Of several texts under an id one
    is learnt from, that with the least hash.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & in_training())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("long").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    # `chosen` has train_rows rows of two numbers at most, and so has the sample, however many rows share an id.
    text = F.coalesce("text", F.lit(""))
    one_text = F.min(F.struct(F.xxhash64(text), text.alias("text")))["text"].alias("text")
    sample = materialise(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(one_text).select("text", "toxic"),
        "toxicity-sample",
    )
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    n, p = float(totals["n"]), float(totals["p"])
    counts = materialise(
        sample.mapInArrow(_term_counts, "term long, toxic long, rows long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
        .where(F.col("rows") >= 3),
        "toxicity-terms",
    )
    # Chi-square of presence and label.
    kept = counts.withColumn(
        "chi", F.pow(F.col("toxic") * n - F.col("rows") * p, 2) / (F.col("rows") * (n - F.col("rows") + 0.5))
    )
    telling = kept.orderBy(F.desc("chi"), "term").limit(terms)
    frequent = kept.orderBy(F.desc("rows"), "term").limit(frequent_terms)
    names = sorted({r["term"] for part in (telling, frequent) for r in part.select("term").collect()})
    blank = Machine({t: i for i, t in enumerate(names)}, 0.0, np.zeros(0), np.zeros(0), np.zeros(0))
    rows = sample.mapInArrow(_features(blank), "toxic long, at array<long>, values array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["toxic"], r["at"], r["values"]))
    return fit_machine(
        names, [(np.array(r["at"]), np.array(r["values"])) for r in rows], np.array([r["toxic"] for r in rows], float)
    )


def score(machine: Machine, text: Column) -> Column:
    """Probability of label 1 for a text column; null counts as empty."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pa.array([machine.probability(*machine.features(t, known)) for t in texts.to_pylist()], pa.float64())

    return run(text)
