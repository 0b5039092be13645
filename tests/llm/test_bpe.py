import hashlib

import pytest
from fixtures import DOC, clashing, documents, plain

from effortlens.llm import bpe
from effortlens.llm.queries import QUERIES, tokenizer


def whole(rows):
    own = bpe.encoding(*tokenizer())
    out = []
    for doc, text in rows:
        ids = own.encode_ordinary(text or "")
        out.append((doc, ids, (text or "").encode()))
    return out


def found(docs, **sizes):
    return [(r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.encode(docs, *tokenizer(), **sizes).collect()]


HARD = [
    (501, "a" * 500, "", "", 0), (502, "word " * 80 + "   \n\n  tail  ", "", "", 0), (503, "it's we'll they've 'll's " * 30, "", "", 0),
    (504, " " * 300 + "x" + " " * 300, "", "", 0), (505, "".join(chr(0x4E00 + i) for i in range(300)), "", "", 0),
    (506, "ab" * 100 + " " + "12345 " * 60 + "!" * 90, "", "", 0), (507, "😀👍🏽" * 70 + " <|endoftext|> end", "", "", 0),
    (507, "😀👍🏽" * 70 + " <|endoftext|> end", "", "", 0), (508, ("x" * 90 + " y ") * 8, "", "", 0),
]


@pytest.mark.parametrize("chunk,overlap", [(7, 7), (16, 12), (64, 32), (100_000, 50)])
def test_chunks_give_the_tokens_of_the_whole(spark, chunk, overlap):
    docs = documents(spark, extra=HARD).where("doc_id is null or length(coalesce(text, '')) < 5000")
    wanted = whole([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(found(docs, chunk=chunk, overlap=overlap)) == plain(wanted)


def test_long_texts_other_columns_and_no_rows(spark):
    docs = documents(spark, extra=[(600, "the and of " * 30_000, "", "", 0)])
    wanted = whole([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert plain(found(clashing(docs))) == plain(wanted)
    assert found(spark.createDataFrame([], DOC)) == []


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [(d, len(i), sha(" ".join(map(str, i)).encode()), sha(t)) for d, i, t in whole(rows)]
    assert plain(QUERIES["op7_byte_bpe"](spark, sf_dir).collect()) == plain(wanted)
