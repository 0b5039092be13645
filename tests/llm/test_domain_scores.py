import math
import struct
from collections import Counter

import pytest
import xxhash
from fixtures import DOC, clashing, documents
from test_tiling import words

from effortlens.llm import domain_scores
from effortlens.llm.queries import QUERIES


def draw(doc, text):
    """Spark's hash of a row, worked out anew."""
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    signed = lambda x: struct.pack("<Q", x)
    inner = 42 if text is None else h(text.encode(), 42)
    place = h(signed(inner), 42 if doc is None else h(struct.pack("<q", doc), 42))
    value = h(signed(place), h(b"draw", 42))
    return (value - (value >> 63 << 64)) % (1 << 30) / (1 << 30)


def brute(rows, target, shared=domain_scores.SHARED, backing=domain_scores.BACKING):
    """Scores by counting the other rows anew for every row."""
    docs, draws = [(d, words(t)) for d, t in rows], [draw(d, t) for d, t in rows]
    long = [sum(len(w) for d, w in docs if (d in target) == inside) for inside in (True, False)]
    share = [min(long) / max(n, 1) for n in long]
    members = []
    for (doc, _), u in zip(docs, draws):
        side = 0 if doc in target else 1
        members.append(side if u < share[side] else None)
    uni, bi, first = ([Counter(), Counter()] for _ in range(3))
    whole_corpus = Counter()
    for (doc, w), side in zip(docs, members):
        whole_corpus.update(w)
        if side is not None:
            uni[side].update(w)
            bi[side].update(zip(w, w[1:]))
            first[side].update(w[:-1])
    total, n_all = [sum(c.values()) for c in uni], sum(long)
    out = []
    for (doc, w), side in zip(docs, members):
        own, loss = (Counter(w), Counter(zip(w, w[1:])), Counter(w[:-1])), 0.0
        left = lambda s, counts, i, key: counts[s][key] - (own[i][key] if s == side else 0)
        size = [total[s] - (len(w) if s == side else 0) for s in (0, 1)]
        for i, x in enumerate(w):
            p = []
            for s in (0, 1):
                whole = whole_corpus[x] / n_all
                q = (1 - shared) * (left(s, uni, 0, x) / size[s] if size[s] else whole) + shared * whole
                if i:
                    m = min(size) / max(size[s], 1)
                    q = (m * left(s, bi, 1, (w[i - 1], x)) + backing * q) / (m * left(s, first, 2, w[i - 1]) + backing)
                p.append(q)
            loss += math.log(p[1]) - math.log(p[0])
        out.append((doc, len(w), loss / len(w) if w else None))
    return sorted(out, key=str)


def near(got, wanted):
    got = sorted((tuple(r) for r in got), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    for g, w in zip(got, wanted):
        assert g[2] == pytest.approx(w[2], abs=1e-9) if w[2] is not None else g[2] is None


def test_equals_counting_by_hand(spark):
    """Null ids, ids with two texts and repeated rows are in."""
    docs = documents(spark)
    docs = docs.unionByName(docs.where("doc_id in (7, 11)"))
    ids = spark.createDataFrame([(7,), (7,), (10,), (13,), (None,), (99_999,), (31,), (40,), (4,)], "doc_id long")
    target = {4, 7, 10, 13, 31, 40}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    near(domain_scores.cross_entropy_difference(docs, ids).collect(), brute(rows, target))
    found = domain_scores.cross_entropy_difference(clashing(docs), clashing(ids), shared=0.5, backing=1.0)
    near(found.collect(), brute(rows, target, 0.5, 1.0))


def test_a_document_is_not_scored_by_its_own_words(spark):
    """Words that only one document has tell nothing about it, in the target or outside."""
    docs = documents(spark).select("doc_id", "text")
    alone = spark.createDataFrame([(900, "zq1 zq2 zq1 zq2 zq1"), (901, "zq3 zq4 zq3 zq4 zq3")], docs.schema)
    ids = spark.createDataFrame([(7,), (10,), (13,), (31,), (900,)], "doc_id long")
    found = domain_scores.cross_entropy_difference(docs.unionByName(alone), ids).where("doc_id >= 900").collect()
    assert [r["n_words"] for r in found] == [5, 5] and [r["score"] for r in found] == pytest.approx([0, 0], abs=1e-12)


def test_empty_tables(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long")
    assert domain_scores.cross_entropy_difference(spark.createDataFrame([], DOC), none).collect() == []
    rows = domain_scores.cross_entropy_difference(docs, none).collect()
    assert len(rows) == docs.count()
    assert {r["n_words"] == 0 for r in rows if r["score"] is None} == {True}


def test_counts_handed_on_in_parts(spark, monkeypatch):
    docs = documents(spark)
    ids = spark.createDataFrame([(7,), (10,)], "doc_id long")
    whole = sorted(domain_scores.cross_entropy_difference(docs, ids).collect(), key=str)
    monkeypatch.setattr(domain_scores, "GATHER", 10)
    parts = sorted(domain_scores.cross_entropy_difference(docs, ids).collect(), key=str)
    assert [r[:2] for r in parts] == [r[:2] for r in whole]
    assert [r[2] for r in parts] == pytest.approx([r[2] for r in whole])


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    wanted = brute(rows, good)
    near(QUERIES["op8_cross_entropy_difference"](spark, sf_dir).collect(), wanted)


def test_rare_words_and_pairs_of_a_larger_corpus(spark):
    """At 300,000 words, what occurs once or twice is counted and scored as in a small corpus."""
    common = " ".join(["the quick brown fox jumps over a lazy dog"] * 110)
    rows = [(i, f"rare{i // 2} odd{i} {common}") for i in range(300)] + [(900, "rare3 odd7 rare3 the fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = {0, 3, 7, 50, 900}
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    near(domain_scores.cross_entropy_difference(docs, ids).collect(), brute(rows, target))
