import random
import zlib

import numpy as np
from fixtures import DOC, clashing, documents, prose

from effortlens.llm import toxicity
from effortlens.llm.queries import QUERIES
from pyspark.sql import functions as F

LABEL = "doc_id long, quality int, toxic int"


def score(docs, machine):
    return docs.select("doc_id", "text", toxicity.score(machine, F.col("text")).alias("score")).collect()


def test_pairs_decide_where_single_terms_cannot(spark):
    """Toxic only if an insult meets a group; a machine without factors can't tell."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = prose(rng, 12) + (" vermin " if insult else " tables ") + prose(rng, 5) + (" strangers " if group else " engines ") + prose(rng, 5)
        rows.append((i, text, "", "", 0))
        labels.append((i, 1, int(insult == group)))
    docs, known = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)
    machine = toxicity.fit(docs, known)
    held = {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = lambda m: np.mean([(r["score"] >= 0.5) == labels[r["doc_id"]][2] for r in score(docs, m) if r["doc_id"] in held])
    assert right(machine) > 0.95
    machine.factors = np.zeros_like(machine.factors)
    assert right(machine) < 0.7


def test_held_out_rows_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op4_toxicity_machine"](spark, sf_dir).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    held = [(got[d], t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 500 and all(r["held_out"] for r, _ in held)
    hits = sum(r["predicted"] for r, t in held if t)
    assert hits >= 0.85 * sum(t for _, t in held)
    assert hits >= 0.9 * sum(r["predicted"] for r, _ in held)


def test_labels_of_held_out_rows_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.in_training(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (sorted(score(docs, toxicity.fit(docs, x))) for x in (labels, turned))
    assert a == b


def test_an_id_of_many_rows_gives_one_row_to_learn_from(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 8) + (" vermin" if i % 2 else " tables"), "", "", 0) for i in range(60)]
    crowd = [(1, prose(rng, 8), "", "", 0) for _ in range(3000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], LABEL)
    seen = []
    learn = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda terms, learnt, known, *a: seen.append(len(learnt)) or learn(terms, learnt, known, *a))
    for extra in (rows + crowd, rows + crowd[::-1]):
        toxicity.fit(spark.createDataFrame(extra, DOC).repartition(7), labels, train_rows=20)
    assert seen == [20, 20]


def test_nulls_ties_clashes_and_no_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (4, None, None), (7, 1, 0), (None, 1, 1), (99_999, 1, 1), (10, 1, 1)], LABEL)
    machine = toxicity.fit(docs, labels)
    rows = score(docs, machine)
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sorted(score(clashing(docs), toxicity.fit(clashing(docs), clashing(labels))), key=str) == sorted(rows, key=str)
    none = toxicity.fit(docs, spark.createDataFrame([], LABEL))
    assert {round(r["score"], 3) for r in score(docs, none)} == {0.0}
    assert score(spark.createDataFrame([], DOC), toxicity.fit(spark.createDataFrame([], DOC), labels)) == []
