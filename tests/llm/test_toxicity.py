import zlib

import numpy as np
import pytest

from tessera.llm import toxicity
from tessera.llm.common import read

SF = "/root/testdata/sf0.1"


def rows_of(spark, path):
    docs = {r.doc_id: r.text for r in read(spark, path, "documents").collect()}
    return [(r.doc_id, docs[r.doc_id], r.toxic) for r in read(spark, path, "labels").collect() if r.doc_id in docs]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, path).collect()}
    labels = [(r.doc_id, r.toxic) for r in read(spark, path, "labels").collect() if r.doc_id in got]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in labels)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    caught = np.mean([p for p, y in held if y])
    wrong = np.mean([p for p, y in held if not y])
    print(caught, wrong, len(held))
    # Eight of the 144 hold no word that toxic texts have more often than others, so nine in ten are asked for.
    assert caught > 0.9 and wrong < 0.01


def test_odd_documents(spark, odd_docs):
    model = toxicity.learn([(i, ("you idiot " if i % 2 else "so fine ") + "word of a text " * 5, i % 2) for i in range(200)])
    docs = odd_docs.withColumn("score", odd_docs.doc_id)
    got = toxicity.score(docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert model.score(["what an idiot of a text"])[0] > 0.7 > model.score(["what a text of a word"])[0]
    assert model.score([None]) == model.score([""]) == model.score([" \n"])


def test_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(odd_docs, toxicity.train(odd_docs, none)).collect()}) == 1
    some = spark.createDataFrame([(0, 1), (4, 0), (5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    assert len(toxicity.score(odd_docs, toxicity.train(odd_docs, some)).collect()) == odd_docs.count()
    assert toxicity.score(no_docs, toxicity.train(no_docs, some)).collect() == []
    kept = toxicity.drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1] + 0.5)))).astype(float)
    assert toxicity.logistic(x, y) == pytest.approx([0.5, 2, -1], abs=0.3)
