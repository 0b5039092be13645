import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from fixtures import DOC, clashing, documents, plain

from effortlens.llm import repeats
from effortlens.llm.queries import QUERIES

LAST = (1 << 63) - 1


def brute(rows, window=repeats.WINDOW):
    """The definition, with the set of all windows of smaller documents."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            w = data[i : i + window]
            least[w] = min(least.get(w, LAST), LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if least[data[i : i + window]] < (LAST if doc is None else doc):
                gone[i : i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(docs, **settings):
    return [
        (r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in repeats.cut_repeats(docs, **settings).collect()
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed):
    docs = documents(spark, seed)
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(0 < r[2] < r[1] for r in wanted)
    assert plain(found(docs)) == plain(wanted)


def test_spans_and_kept_bytes_are_the_text(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    by_id = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in repeats.cut_repeats(docs).collect():
        data, at, kept = by_id[r["doc_id"]], 0, b""
        for a, b in zip(r["starts"], r["stops"]):
            assert at <= a < b and (a > at or at == 0)
            kept += data[at:a]
            at = b
        assert kept + data[at:] == bytes(r["kept"])


def test_other_columns_and_no_rows(spark):
    docs = documents(spark)
    assert plain(found(clashing(docs))) == plain(found(docs))
    assert found(spark.createDataFrame([], DOC)) == []


def test_an_anchor_of_very_many_groups(spark):
    """Windows of common anchors go one by one, with the same result."""
    shared = "a passage that every document of this table holds, word by word, from its first to its last byte"
    rows = [(i, f"{i * 7919} head {i} " + shared + f" tail {i * 31} end {i}", "", "", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, DOC)
    wanted = plain(brute([(r[0], r[1]) for r in rows]))
    assert plain(found(docs, common_groups=2)) == wanted
    assert plain(found(docs)) == wanted


def test_an_anchor_of_few_groups_with_very_many_stretches(spark):
    """What one index holds is bounded, however few groups the documents fill."""
    passage = "a passage that a third of all documents hold, with another text before and behind it in every one"
    tables = [
        pa.table(
            {"group": pa.array([g] * 8000, pa.int32()), "doc_id": range(g * 8000, g * 8000 + 8000), "place": range(g * 8000, g * 8000 + 8000),
             "doc": range(8000), "text": [f"{hashlib.md5(b'%d %d' % (g, i)).hexdigest()} {passage} {i * 7919 % 8009} {g}" for i in range(8000)]}
        )
        for g in range(2)
    ]
    anchors = pa.concat_tables([repeats._anchor_pass(1, 50)(t) for t in tables])
    shared = repeats._sharing_pass(50)(anchors)
    pick = lambda g: shared.filter(pa.compute.equal(shared.column("group"), g))
    held = {}
    for g, t in enumerate(tables):
        for r in repeats._stretch_pass(1, 50)(t, pick(g)).to_pylist():
            if r["n_bytes"]:
                kinds = [(k, r["n"]) for k in (np.uint32, np.int64, np.int32, np.int64, np.uint8)]
                keys, _, _, _, sizes, _ = repeats._unpack(r["packed"], *kinds, (np.uint8, r["n_bytes"]))
                for k, n in zip(keys.tolist(), sizes.tolist()):
                    held[k] = held.get(k, 0) + n
    assert 0 < max(held.values()) <= repeats.INDEX_BYTES
    rows = [(r["doc_id"], r["text"], "", "", 0) for t in tables for r in t.slice(0, 60).to_pylist()]
    wanted = plain(brute([(r[0], r[1]) for r in rows]))
    assert plain(found(spark.createDataFrame(rows, DOC), common_bytes=1000)) == wanted


def test_index_against_sorted_suffixes():
    rng = np.random.default_rng(3)
    strings = [rng.integers(97, 99, rng.integers(50, 77)).astype(np.uint8) for _ in range(40)]
    strings += [np.tile(np.array([97, 98], np.uint8), 30), np.full(76, 97, np.uint8), np.full(60, 97, np.uint8)]
    strings += [np.concatenate((strings[0][:20], strings[1][:50])) for _ in range(2)]
    sizes = np.array([len(s) for s in strings])
    docs = rng.integers(0, 20, len(strings))
    index = repeats.RunLengthIndex(np.concatenate(strings), sizes, docs)
    hits = {(int(s), int(o)): int(d) for a, b, c in index.matching_statistics() for s, o, d in zip(a, b, c)}
    wanted = {}
    for s, x in enumerate(strings):
        for o in range(len(x) - 49):
            w = x[o : o + 50].tobytes()
            least = min(d for y, d in zip(strings, docs) if w in y.tobytes())
            if least < docs[s]:
                wanted[s, o] = int(least)
    assert wanted and hits == wanted
    assert len(index.run_starts) < sizes.sum()


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(QUERIES["op3_run_length_dedup"](spark, sf_dir).collect()) == plain(wanted)
