"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into partitions of
about equal size with few edges between them, and a small classifier learns which
partitions hold the neighbours of a vector. Every row is filed under its most
probable partition; a query is sent to its several most probable ones, whose rows
are compared with it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortlens.session import materialise

NEAREST = 10
# Rows the partitions and the classifier are fitted on, at most; those with the least hash of their id.
SAMPLE_ROWS = 8_000
PARTITIONS = 16
# Sample neighbours that the probed partitions must hold; sets how many are probed.
SAMPLE_RECALL = 0.97
# Rows and queries compared in one task, at about.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024


@dataclass
class Index:
    """A classifier of one hidden layer: vector to probabilities of partitions; and how many partitions to probe."""

    centre: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum((vectors - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Partitions by falling probability, ties to the smaller number."""
        return np.argsort(-self.probabilities(vectors), axis=1, kind="stable")


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of every row, computed in blocks of rows."""
    n = len(vectors)
    out = np.zeros((n, k), np.int64)
    squares = (vectors**2).sum(axis=1)
    for first in range(0, n, 1024):
        part = slice(first, min(first + 1024, n))
        d = squares[part, None] + squares[None, :] - 2 * vectors[part] @ vectors.T
        d[np.arange(part.stop - first), np.arange(first, part.stop)] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[part] = near
    return out


def balanced_partition(graph: np.ndarray, vectors: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Label per node: few graph edges between labels, no label with over 1.1 times the even share.

    Starts from slices along random directions, then moves nodes to the label
    that most of their neighbours (in either direction) have while there is room.
    """
    n = len(graph)
    label = np.zeros(n, np.int64)
    pending, count = [(np.arange(n), parts, 0)], 0
    while pending:  # halves by a principal direction, in proportion to the parts wanted
        rows, wanted, base = pending.pop()
        if wanted == 1:
            label[rows] = base
            continue
        centred = vectors[rows] - vectors[rows].mean(axis=0)
        direction = rng.normal(size=vectors.shape[1])
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-30
        order = np.argsort(centred @ direction, kind="stable")
        left = wanted // 2
        cut = len(rows) * left // wanted
        pending += [(rows[order[:cut]], left, base), (rows[order[cut:]], wanted - left, base + left)]
        count += 1
    source = np.repeat(np.arange(n), graph.shape[1])
    ends = np.concatenate((graph.ravel(), source))
    starts = np.concatenate((source, graph.ravel()))
    room = int(np.ceil(1.1 * n / parts))
    for _ in range(rounds):
        votes = np.bincount(starts * parts + label[ends], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            # Half of the wishes are met in a round, or neighbours would swap places for ever.
            if sizes[best[i]] < room and rng.random() < 0.5:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit_index(vectors: np.ndarray, parts: int = PARTITIONS, recall: float = SAMPLE_RECALL, seed: int = 11, hidden: int = 128) -> Index:
    """Fit on sample rows. Fewer than four rows per partition make one partition."""
    rng = np.random.default_rng(seed)
    n, dim = vectors.shape
    if n < 4 * parts:
        return Index(np.zeros(dim), 1.0, [np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    k = min(NEAREST, n - 1)
    graph = neighbour_graph(vectors, k)
    label = balanced_partition(graph, vectors, parts, rng)
    # Where a row's neighbours are, itself included: what the classifier learns.
    goal = np.bincount((np.arange(n)[:, None] * parts + label[graph]).ravel(), minlength=n * parts).reshape(n, parts)
    goal = (goal + np.eye(parts)[label] * 2) / (k + 2)
    centre = vectors.mean(axis=0)
    scale = float(np.sqrt(((vectors - centre) ** 2).mean()) + 1e-30)
    x = (vectors - centre) / scale
    layers = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    held = rng.random(n) < 0.2
    learn = np.flatnonzero(~held)
    for _ in range(25):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 256)):
            a = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            z = a @ layers[2] + layers[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - goal[rows]) / len(rows)
            da = (dz @ layers[2].T) * (a > 0)
            grads = [x[rows].T @ da + 1e-4 * layers[0], da.sum(0), a.T @ dz + 1e-4 * layers[2], dz.sum(0)]
            step += 1
            for w, g, m, v in zip(layers, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    index = Index(centre, scale, layers, parts)
    # Rows are filed by the classifier; probe until held-out rows find enough of their neighbours.
    order = index.ranked(vectors)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    rows = np.flatnonzero(held) if held.any() else np.arange(n)
    at = np.take_along_axis(place[rows], order[:, 0][graph[rows]], axis=1)
    shares = [(at < m).mean() for m in range(1, parts + 1)]
    index.probes = 1 + int(np.argmax(np.array(shares) >= min(recall, shares[-1])))
    return index


def usable(embedding: str, dim: int | None = None) -> Column:
    """Vectors that take part: not null or empty, no null or non-finite component, not all zero, of `dim` components."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)
    return F.coalesce(fine & (F.size(x) == dim if dim else F.lit(True)), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _filed(index: Index, probes: int, sizes: np.ndarray | None = None, least: int = 0):
    """The `probes` first partitions of every row; with `sizes`, on down its ranking until they hold `least` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ranked = index.ranked(_matrix(batch.column("vector")))
                n = np.full(len(ranked), min(probes, ranked.shape[1]))
                if sizes is not None:
                    short = (np.cumsum(sizes[ranked], axis=1) < least).sum(axis=1) + 1
                    n = np.minimum(np.maximum(n, short), ranked.shape[1])
                places = pa.array([row[:m] for row, m in zip(ranked.astype(np.int32).tolist(), n.tolist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "parts"])

    return run


def _search(k: int):
    """The k nearest rows of a block for every query of a block, by exact distance and then id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_flat, ids, flat in zip(*(batch.column(c) for c in ("q_ids", "q_flat", "ids", "flat"))):
                q_ids, ids = (x.values.to_numpy() for x in (q_ids, ids))
                queries = q_flat.values.to_numpy().reshape(len(q_ids), -1)
                vectors = flat.values.to_numpy().reshape(len(ids), -1)
                out_q, out_i, out_s = [], [], []
                for q, vector in zip(q_ids, queries):
                    score = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
                    own = np.flatnonzero(ids != q)
                    if len(own) > k:
                        edge = np.partition(score[own], k - 1)[k - 1]
                        own = own[score[own] <= edge]
                    best = own[np.lexsort((ids[own], score[own]))[:k]]
                    out_q.append(np.full(len(best), q))
                    out_i.append(ids[best])
                    out_s.append(score[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (out_q, out_i, out_s)], ["query_id", "vec_id", "score"]
                )

    return run


def _blocks(rows: DataFrame, per_block: int, ids: str, flat: str) -> DataFrame:
    """(part, block, ids, vectors end to end) with about `per_block` rows each, however large a partition is."""
    # One row per partition.
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / per_block).cast("int").alias("n"))
    dealt = rows.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    gathered = F.array_sort(F.collect_list(F.struct("vec_id", "vector")))
    return dealt.groupBy("part", "block").agg(gathered.alias("rows")).select(
        "part", "block", F.transform("rows", lambda r: r["vec_id"]).alias(ids), F.flatten(F.transform("rows", lambda r: r["vector"])).alias(flat)
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, sample_rows: int = SAMPLE_ROWS, parts: int = PARTITIONS
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found rows, itself left out.

    Both tables have (vec_id, embedding); other columns are ignored. The score
    is the Euclidean distance in double precision; ties go to the smaller
    vec_id. Rows without an id, and vectors that are null, empty, all zero, of
    another size than most, or have null or non-finite components, take no
    part. Repeated rows of one id count as one (the least vector). A query gets
    fewer than k rows only if there are fewer candidates.
    """
    schema = "vec_id long, vector array<double>"
    valid = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    size = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    take = lambda df: df.where(usable("embedding", size["dim"]) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(
        F.min(F.col("embedding").cast("array<double>")).alias("vector")
    )
    clean = materialise(take(vectors), "ann-vectors")
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    order = np.argsort(sample["vec_id"].to_numpy(), kind="stable")
    index = fit_index(_matrix(sample["vector"])[order], parts)

    home = F.element_at("parts", 1).alias("part")
    filed = clean.mapInArrow(_filed(index, 1), f"{schema}, parts array<int>").select("vec_id", "vector", home)
    filed = materialise(filed, "ann-filed")
    # One row per partition.
    sizes = np.zeros(parts, np.int64)
    for part, n in filed.groupBy("part").count().collect():
        sizes[part] = n
    # One row more than k, as a query's own may be among them.
    asked = take(queries).mapInArrow(_filed(index, index.probes, sizes, k + 1), f"{schema}, parts array<int>").select(
        "vec_id", "vector", F.explode("parts").alias("part")
    )
    rows = _blocks(filed, BLOCK_ROWS, "ids", "flat")
    wanted = _blocks(materialise(asked, "ann-asked"), BLOCK_QUERIES, "q_ids", "q_flat")
    found = (
        wanted.drop("block").join(rows.drop("block"), "part")
        .mapInArrow(_search(k), "query_id long, vec_id long, score double")
    )
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
