import hashlib
import json
import random
import time
from collections import Counter
from functools import lru_cache

import numpy as np
from fixtures import DOC, clashing, documents, plain

from effortlens.llm import alignment
from effortlens.llm.queries import QUERIES, alignment_tokenizers

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@lru_cache
def both():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text):
    """(id, start, end) of all tokens of both tokenizers, from their own names of tokens."""
    a, b = both()
    byte = {c: i for i, c in byte_names()}

    def spans(pieces):
        out, at = [], 0
        for i, raw in pieces:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in pieces)

    e = a.encode(" " + text, add_special_tokens=False)
    of_a = spans([(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)])
    names = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    of_b = spans([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in names])
    return of_a, of_b


def byte_names():
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    extra = 256
    for i in range(256):
        if i in shown:
            yield i, chr(i)
        else:
            yield i, chr(extra)
            extra += 1


def brute(rows):
    """Pairs of tokens compared one by one; groups grown token by token."""
    texts = {}
    for _, text in rows:
        if text in texts:
            continue
        links, groups, a, b = [], [], [], []
        if text:
            (a, raw_a), (b, raw_b) = tokens(text)
            if not raw_a == raw_b == (" " + text).encode():
                a, b = [], []
        starts = {end: i for i, _, end in b}
        links = [(i, starts[end]) for i, _, end in a if end in starts]
        i = j = 0
        while i < len(a):
            left, right = [a[i]], [b[j]]
            i, j = i + 1, j + 1
            while left[-1][2] != right[-1][2]:
                if left[-1][2] < right[-1][2]:
                    left.append(a[i])
                    i += 1
                else:
                    right.append(b[j])
                    j += 1
            groups.append(",".join(str(x) for x, _, _ in left) + "|" + ",".join(str(x) for x, _, _ in right))
        texts[text] = (a, b, links, groups)
    count = Counter(link for _, text in rows for link in texts[text][2])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for doc, text in rows:
        a, b, links, groups = texts[text]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(count[x] == most[x[1]] for x in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), digest))
    return out


def found(docs):
    own = alignment_tokenizers()
    aligned = alignment.align(docs, *own).cache()
    return [tuple(r[c] for c in COLUMNS) for r in alignment.summary(aligned, alignment.link_counts(aligned), *own).collect()]


ODD = [
    (701, "a▁b is not its bytes", "", "", 0), (702, "<|endoftext|> </s> <unk> <0x41> <s>", "", "", 0), (703, " ", "", "", 0),
    (704, "日本語 \U0001f600\U0001f44d\U0001f3fd", "", "", 0), (705, "\x00\x01 \t\n\n", "", "", 0), (706, "   lead and trail   ", "", "", 0),
    (707, "ﬁ é  x ﻿", "", "", 0), (707, "ﬁ é  x ﻿", "", "", 0),
]


def test_brute_force_with_odd_texts(spark):
    docs = documents(spark, extra=ODD)
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(found(docs)) == plain(wanted)
    assert plain(found(clashing(docs).repartition(5))) == plain(wanted)


def test_links_are_the_ends_of_groups(spark):
    docs = documents(spark, extra=ODD).where("length(text) < 3000")
    aligned = alignment.align(docs, *alignment_tokenizers()).cache()
    links = alignment.links(aligned).groupBy("a_id", "b_id").count()
    counts = alignment.link_counts(aligned).drop("best")
    assert plain(links.collect()) == plain(counts.collect())


def test_no_rows_and_no_tokens(spark):
    assert found(spark.createDataFrame([], DOC)) == []
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], DOC)
    assert plain(found(rows)) == plain([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])


def test_ranks_give_the_tokens_of_the_file():
    own = alignment.Tokenizers(*alignment_tokenizers(), alignment.ranked(alignment_tokenizers()[0]))
    assert own.fast is not None
    plain_file = alignment.Tokenizers(*alignment_tokenizers(), None)
    # Every character, among letters, digits, signs and white space.
    for first in range(0, 0x110000, 4096):
        characters = [chr(c) for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c} {c}.{c}" for c in characters)
        assert all(own.encode_a(t) == plain_file.encode_a(t) for t in (text[:30_000], text[30_000:])), hex(first)
    for seed in range(300):
        rng = random.Random(seed)
        text = "".join(rng.choices("aaabcdet'  \n\t.1é日ñth", k=200))
        assert own.encode_a(text) == plain_file.encode_a(text)


def test_a_file_whose_ranks_do_not_tell_its_merges():
    content = json.loads(alignment_tokenizers()[0])
    content["model"]["merges"] = content["model"]["merges"][1:]
    assert alignment.ranked(json.dumps(content).encode()) is None


def test_table_of_possible_links(spark, sf_dir):
    own = alignment.tokenizers(*alignment_tokenizers())
    bound = own.possible_links()
    some = range(0, len(own.a_bytes), 997)
    ends = lambda x, y: x.endswith(y) or y.endswith(x)
    assert bound > sum(ends(own.a_bytes[i], y) for i in some for y in own.b_bytes)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = alignment.link_counts(alignment.align(docs, *alignment_tokenizers())).collect()
    assert 0 < len(pairs) <= bound
    assert all(ends(own.a_bytes[r["a_id"]], own.b_bytes[r["b_id"]]) for r in pairs)


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, sf_dir).collect()]
    assert plain(got) == plain(brute(rows))


def by_dictionaries(a_sizes, b_sizes):
    """End-to-index dictionaries of Python; of tokens without bytes the last one counts."""
    a, b = (dict(zip(np.cumsum(x).tolist(), range(1, len(x) + 1))) for x in (a_sizes, b_sizes))
    ends = sorted(a.keys() & b.keys())
    return [np.diff([0, *(own[e] for e in ends)]).tolist() for own in (a, b)]


def test_cuts_are_those_of_dictionaries_in_less_time():
    rng = np.random.default_rng(5)

    def sizes(total, n):
        return np.diff(np.unique(np.concatenate(([0, total], rng.integers(0, total + 1, n)))))

    cases = [(sizes(t, n), sizes(t, m)) for t, n, m in rng.integers(1, 40, (500, 3))]
    cases += [(np.array([0, 2, 0, 3]), np.array([2, 3])), (np.array([], int), np.array([], int))]
    for a, b in cases:
        assert [c.tolist() for c in alignment.common_cuts(a, b)] == by_dictionaries(a, b)
    long = sizes(40_000, 10_000), sizes(40_000, 10_000)

    def least(cut):
        times = []
        for _ in range(7):
            began = time.perf_counter()
            cut(*long)
            times.append(time.perf_counter() - began)
        return min(times)

    assert least(alignment.common_cuts) < 0.6 * least(by_dictionaries)
