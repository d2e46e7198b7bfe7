"""Memory that a task's Python takes."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tallyloom.llm import toxicity


def test_features_are_found_in_little_memory():
    drawn = np.random.RandomState(1).randint(97, 123, (2000, 1000), np.uint8)
    texts = pa.array([line.tobytes().decode() for line in drawn])
    list(toxicity.present(texts.slice(0, 1), None))  # tables that are kept
    tracemalloc.start()
    try:
        assert sum(n for _, n, _, _ in toxicity.present(texts, None)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()


def test_counts_come_back_in_small_batches():
    drawn = np.random.RandomState(2).randint(97, 123, (400, 1000), np.uint8)
    texts = pa.array([line.tobytes().decode() for line in drawn])
    batches = list(toxicity._counts(iter([pa.record_batch([texts, pa.array([0, 1] * 200)], names=["text", "toxic"])])))
    features = np.concatenate([batch.column(0).to_numpy() for batch in batches])
    assert len(features) > 1 << 18 and (np.diff(features) > 0).all()
    assert max(batch.num_rows for batch in batches) <= 1 << 16


def test_kept_texts_go_to_python_once(spark):
    texts = ["a fine day out", "you vile fool", None, "", "Vile! vile fool"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 8)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(coalesce(lower(text) like '%vile%', false) as int) as toxic")
    whole = toxicity.score_toxicity(docs, labels)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("coalesce(text") == 0
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, keep=["doc_id"]).collect()}
    assert {(r.doc_id, r.text, r.score) for r in whole.collect()} == {(i, t, scores[i]) for i, t in enumerate(texts * 8)}
