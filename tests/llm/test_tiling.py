import random

import numpy as np
from fixtures import DOC, clashing, documents, plain, prose

from effortlens.llm import arrays, tiling
from effortlens.llm.queries import QUERIES

ITEM = "item_id long, text string"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() or "À" <= c <= "Þ" else c
    return out


def slow_tiles(doc, item, k):
    """Longest first, ties by place, one match marked at a time."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while (p + n < len(doc) and b + n < len(item) and free_d[p + n] and free_i[b + n] and doc[p + n] == item[b + n]):
                    n += 1
                if n > best[0]:
                    best = (n, p, b)
        if best[0] < k:
            return covered
        n, p, b = best
        covered += n
        free_d[p : p + n], free_i[b : b + n] = [False] * n, [False] * n


def brute(docs, items, coverage=0.5, k=5):
    out = {}
    for doc, text in docs:
        for name, item in items:
            d, i = words(text), words(item)
            if 0 < len(i) < k and d == i:
                out[doc, name] = 1.0
            if len(i) >= k and len(d) >= k and set(zip(*[d[j:] for j in range(k)])) & set(zip(*[i[j:] for j in range(k)])):
                share = slow_tiles(d, i, k) / len(i)
                if share >= coverage:
                    out[doc, name] = max(out.get((doc, name), 0), share)
    return sorted(((d, n, s) for (d, n), s in out.items()), key=str)


def tables(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(12, 50))) for i in range(8)]
    items += [(3, prose(rng, 20)), (8, items[0][1]), (9, None), (10, ""), (11, "only four words here"), (None, items[1][1])]
    extra = []
    for i, (_, text) in enumerate(items[:8]):
        w = text.split()
        a, b, c = w[: len(w) // 3], w[len(w) // 3 : 2 * len(w) // 3], w[2 * len(w) // 3 :]
        extra += [
            (700 + i, prose(rng, 30) + " " + " ".join(c + ["between"] + a + ["other"] + b) + " " + prose(rng, 9), "", "", 0),
            (720 + i, " ".join(a), "", "", 0),
            (740 + i, "".join(c if c == "ß" else c.upper() for c in ". ".join(w)), "", "", 0),
            (760 + i, " ".join(w[::-1]), "", "", 0),
        ]
    # Short items: alike but for case and marks, inside a longer text, with a word more, one fewer, in another order.
    short = ["Only four words, here!", "only four words here", "so only four words here it is", "only four words here too", "four words here", "four only words here"]
    extra += [(780 + i, text, "", "", 0) for i, text in enumerate(short)]
    items += [(12, "ok"), (13, "OK."), (11, "four words here")]
    extra += [(790, "Ok", "", "", 0), (791, "ok ok", "", "", 0), (None, "ok", "", "", 0)]
    return documents(spark, extra=extra + [extra[0]]), spark.createDataFrame(items, ITEM)


def found(docs, items):
    return sorted(((r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contaminated(docs, items).collect()), key=str)


def test_equals_the_slow_way(spark):
    docs, items = tables(spark)
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.where("length(text) < 5000").collect()], [tuple(r) for r in items.collect()])
    got = found(docs, items)
    assert got == wanted
    assert {(d, i) for d, i, _ in got if i in (11, 12, 13)} == {(780, 11), (781, 11), (784, 11), (790, 12), (790, 13), (None, 12), (None, 13)}
    assert {700, 740} <= {d for d, _, _ in got} and 760 not in {d for d, _, _ in got}
    assert found(clashing(docs), clashing(items)) == wanted


def test_no_rows(spark):
    docs, items = tables(spark)
    assert found(spark.createDataFrame([], DOC), items) == []
    assert found(docs, spark.createDataFrame([], ITEM)) == []


def test_tiles_do_not_overlap_and_are_greedy():
    rng = random.Random(2)
    for _ in range(200):
        doc = " ".join(rng.choice("ab") for _ in range(rng.randint(5, 40)))
        item = " ".join(rng.choice("ab") for _ in range(rng.randint(5, 25)))
        sides = []
        for text in (doc, item):
            data = np.frombuffer(text.encode(), np.uint8)
            sides.append(arrays.gram_hashes(*arrays.word_hashes(data, np.array([0, len(data)])), 5))
        shared = np.isin(sides[0][0], sides[1][0])
        if not shared.any():
            continue
        tiles = tiling.greedy_tiles(sides[0][1][shared], sides[0][0][shared], sides[1][0])
        d, i = doc.split(), item.split()
        for side in (0, 1):
            places = [p for t in tiles for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        assert all(d[p : p + n] == i[b : b + n] and n >= 5 for p, b, n in tiles)
        assert sum(t[2] for t in tiles) == slow_tiles(d, i, 5)


def test_whole_table(spark, sf_dir):
    read = lambda n: [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").collect()]
    got = QUERIES["op9_greedy_tiling"](spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["coverage"]) for r in got), key=str) == brute(read("documents"), read("benchmark"))
