import zlib

import numpy as np
import pytest

from spendweave.llm import quality_classifier as q


def test_linear_time_identity():
    """The score is that of all pairs."""
    rng = np.random.default_rng(2)
    width = q.BUCKETS + len(q.STATISTICS)
    model = q.FactorisationMachine(0.3, rng.normal(size=width), rng.normal(size=(width, 3)), np.zeros(len(q.STATISTICS)), np.ones(len(q.STATISTICS)))
    found = [q.features("some words and some more words\nsome line", 41), q.features("", None), q.features(None, 3)]
    row, column, value = model.rows(found)
    for i, score in enumerate(model.score(found)):
        x, c = value[row == i], column[row == i]
        pairs = sum(model.v[c[a]] @ model.v[c[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a))
        assert score == pytest.approx(1 / (1 + np.exp(-(0.3 + model.w[c] @ x + pairs))))


def test_learns_an_interaction():
    rng = np.random.default_rng(1)
    texts = [(" ".join(["left"] * a + ["right"] * b + [f"w{n}" for n in rng.integers(0, 50, 5)]), a ^ b) for a, b in rng.integers(0, 2, (1500, 2)).tolist()]
    found, labels = [q.features(t, None) for t, _ in texts], np.array([y for _, y in texts], float)
    model = q.FactorisationMachine.fit(found[:1000], labels[:1000])
    assert ((model.score(found[1000:]) >= 0.5) == labels[1000:]).mean() > 0.95


def test_whole_text_counts():
    head = q.features("a b c " * 10_000, None)
    tail = q.features("a b c " * 10_000 + "### " * 500, None)
    assert tail[2][q.STATISTICS.index("symbol_share")] > head[2][q.STATISTICS.index("symbol_share")] == 0


def test_odd_rows(spark, odd, odd_rows, none, labels):
    rows = q.classify(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert q.classify(none, labels).count() == 0
    assert {r.score for r in q.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert [c for c in q.with_score(odd, q.train(none, labels), "size").columns] == [c for c in odd.columns if c != "size"] + ["size"]


def test_id_source_language_and_held_out_labels_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).cache()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F
    first = {r.doc_id: r.score for r in q.classify(docs, labels).collect()}
    changed = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id: r.score for r in q.classify(renamed, changed).collect()} == first


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = q.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    good = [r.predicted for r in rows if r.quality == 1]
    assert len(rows) > 1000 and right > 0.98 and sum(good) / len(good) > 0.99
