import numpy as np
import pytest
import xxhash
from fixtures import DOC, clashing, documents, plain

from effortlens.llm import simhash
from effortlens.llm.components import connected_components
from effortlens.llm.queries import QUERIES


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)]


def found(docs):
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(), "component_id").collect()


def test_equals_all_pairs(spark):
    docs = documents(spark, extra=[(900, "A B c D", "", "", 0), (901, "a b\tC\x0bd", "", "", 0)])
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(found(docs)) == plain(wanted)
    assert plain(found(clashing(docs))) == plain(wanted)
    assert found(spark.createDataFrame([], DOC)) == []


@pytest.mark.parametrize("block", [3, 4096])
def test_links_of_random_fingerprints(spark, block):
    """Chains within the radius, across tiles and blocks of one tile."""
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for v in list(values):
        for _ in range(6):
            v ^= 1 << int(rng.integers(0, 63))
            v ^= 1 << int(rng.integers(0, 63))
            values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    parts = connected_components(simhash.near_links(df, block=block))
    got = {r["node"]: r["root"] for r in parts.collect()}
    label = {v: v for v in values}
    moved = True
    while moved:
        moved = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2 and label[a] < label[b]:
                    label[b] = label[a]
                    moved = True
    assert {v: got.get(v, v) for v in values} == label


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert plain(QUERIES["op6_simhash_tiles"](spark, sf_dir).collect()) == plain(brute(rows))
