import os
import random

import corpus_pipeline
import pytest
from effortlens.llm import bpe, queries, secrets, toxicity
from fixtures import DOC, documents, plain, prose
from pyspark.sql import functions as F
from test_secrets import spans_of
from test_simhash import brute as simhash_groups
from test_tiling import brute as covered

STAGES = dict(corpus_pipeline.STAGES)


def test_every_stage_on_what_the_one_before_kept(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    docs = read("documents")
    stage = lambda name, df: STAGES[name](spark, df, sf_dir)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    kept = stage("toxicity", docs).cache()
    machine = toxicity.fit(docs, read("labels"))
    wanted = docs.where(toxicity.score(machine, F.col("text")) < 0.5)
    assert plain(kept.collect()) == plain(wanted.collect()) and 0 < kept.count() < docs.count()

    given = rows(kept)
    single = stage("near_duplicates", kept).cache()
    groups = {}
    for doc, _, group in simhash_groups([(d, r["text"]) for d, r in given.items()]):
        groups.setdefault(group, []).append(doc)
    assert rows(single) == {min(g): given[min(g)] for g in groups.values()} and len(groups) < len(given)

    given = rows(single)
    clean = stage("decontamination", single).cache()
    leaks = {d for d, _, _ in covered([(d, r["text"]) for d, r in given.items()], [(r[0], r[1]) for r in read("benchmark").collect()])}
    assert rows(clean) == {d: r for d, r in given.items() if d not in leaks}

    given = rows(clean)
    safe = stage("secrets", clean).cache()
    assert safe.columns == docs.columns and set(rows(safe)) == set(given)
    model = secrets.fit(secrets.labelled_samples(clean, secrets.scan(clean)))
    text = F.col("text")
    spans = secrets.all_spans(secrets.base_spans(text), secrets.candidate_spans(text), model)
    marked = {r["doc_id"]: r["spans"] for r in clean.select("doc_id", spans.alias("spans")).collect()}
    for d, r in rows(safe).items():
        assert not spans_of(r["text"]) and r["n_chars"] == len(r["text"])
        out, at = "", 0
        for s in marked[d]:
            if s["start"] >= at:
                out += given[d]["text"][at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["text"] == out + given[d]["text"][at:]

    own = bpe.encoding(*queries.tokenizer())
    last = rows(stage("byte_bpe", safe))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last.values())
    assert {d: (*r[: len(docs.columns)], r["ids"]) for d, r in last.items()} == {d: (*r, own.encode_ordinary(r["text"])) for d, r in rows(safe).items()}
    assert plain(corpus_pipeline.run(spark, sf_dir).collect()) == plain(last.values())


def folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one item of a few words that no document has")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass(spark, tmp_path, empty):
    docs = spark.createDataFrame([], DOC) if empty else documents(spark)
    path = folder(spark, tmp_path / "in", docs)
    frame = spark.read.parquet(os.path.join(path, "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, path).collect()
    assert bool(rows) != empty
    texts = [r["text"] for r in rows]
    assert len(texts) == len(set(texts)) and all(r["round_trip"] for r in rows)


def test_rows_without_and_with_shared_ids(spark, tmp_path):
    rng = random.Random(7)
    item = "what is the name of the river that runs through the middle of the old town"
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [
        (1, a, "en", "s", 0), (1, f"{b} {item} {b}", "en", "s", 0),  # one id, a clean and a contaminated text
        (2, c, "en", "s", 0), (2, d, "en", "s", 0),  # one id, two clean texts
        (None, f"{e} {item}", None, None, None), (None, a, None, None, None),  # no id: contaminated, and a copy
        (None, e, None, None, None), (None, e, None, None, None), (3, c, "fr", "t", 1),
    ]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(99, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "round_trip"}
    assert plain([(r["doc_id"], r["text"]) for r in found]) == plain([(1, a), (2, c), (2, d), (None, e)])


def test_stages_hand_python_few_rows_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    try:
        for given, wanted in (("10000", 512), ("0", 512), ("100", 100)):
            spark.conf.set(name, given)
            found = corpus_pipeline.encode(spark, docs, "")
            assert int(spark.conf.get(name)) == wanted
        assert [r.round_trip for r in found.orderBy("doc_id").collect()] == [True, True]
    finally:
        spark.conf.set(name, before)
