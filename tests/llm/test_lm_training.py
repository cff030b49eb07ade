"""The class weights of the language model against plain ascent on dense sums."""

import numpy as np
import pyarrow as pa
import pytest

from portica.llm import exchange, lm_scoring as lm, queries

from .test_lm_scoring import is_held
from .test_text_operators import SCHEMA, corpus


def dense(rows):
    """(feature rows, classes) of all training tokens, and their counts by class and row."""
    got = [lm.Tokens([(r[1] or "").encode()]).with_ends()[:2] for r in rows if not is_held(r[0])]
    features, kind = np.concatenate([f for f, _ in got], axis=1), np.concatenate([k for _, k in got])
    counts = np.zeros((lm.CLASSES + 1, lm.FEATURES))
    for r in features:
        np.add.at(counts, (kind, r), 1)
    return features, kind, counts


def objective(features, kind, weights, start, bias):
    z = weights[features].sum(axis=0) + bias
    top = z.max(axis=1)
    log = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
    value = (z[np.arange(kind.size), kind] - log).sum() - lm.SMOOTH / 2 * ((weights - start) ** 2).sum()
    return value, np.exp(z - log[:, None])


def test_training_ends_at_the_maximum(spark):
    rows = corpus(seed=5, n=150)
    features, kind, counts = dense(rows)
    start, bias = (x.astype(float) for x in lm.start_weights(counts))
    best = start.copy()
    for _ in range(150):
        _, p = objective(features, kind, best, start, bias)
        expected = np.zeros_like(best)
        for r in features:
            np.add.at(expected, r, p)
        best += 0.4 * (counts.T - expected - lm.SMOOTH * (best - start)) / (expected + lm.SMOOTH)
    top = objective(features, kind, best, start, bias)[0]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("held_out", lm.held_out(lm.F.col("doc_id")))
    reached = {k: objective(features, kind, lm.train(docs, counts, 4, k)[0].astype(float), start, bias)[0] for k in (1, None)}
    assert top - reached[None] < 5 * lm.GAIN * kind.size < top - reached[1]


@pytest.mark.parametrize("size", [1, 40])
def test_a_pass_sums_what_dense_sums_give(monkeypatch, size):
    """Weights of size 40 have scores whose exponentials overflow without a shift."""
    monkeypatch.setattr(lm, "BATCH", 300)
    monkeypatch.setattr(lm, "STEP", 70)
    rng = np.random.default_rng(3)
    weights = (size * rng.standard_normal((lm.FEATURES, lm.CLASSES + 1))).astype(np.float32)
    bias = rng.standard_normal(lm.CLASSES + 1).astype(np.float32)
    assert lm._tame(weights, bias) == (size == 1)
    rows = corpus(seed=6, n=40)
    texts = pa.RecordBatch.from_pydict({"text": [r[1] for r in rows]})
    got = [r for batch in lm._expect(lm._histories([texts]), weights, bias, 3) for r in batch.to_pylist()]
    features = np.concatenate([lm.Tokens([(r[1] or "").encode()]).with_ends()[0] for r in rows], axis=1)
    z = weights.astype(float)[features].sum(axis=0) + bias
    log = z.max(axis=1) + np.log(np.exp(z - z.max(axis=1)[:, None]).sum(axis=1))
    expected = np.zeros((lm.FEATURES, lm.CLASSES + 1))
    for r in features:
        np.add.at(expected, r, np.exp(z - log[:, None]))
    pieces = [(r["part"], lm._sum_pieces([r["payload"]]).tobytes()) for r in got if r["kind"] == 1]
    assert np.allclose(lm._from_pieces(pieces, 3).T, expected, rtol=1e-4, atol=1e-3)
    assert [exchange.unpack(r["payload"], np.float64)[0][0] for r in got if r["kind"] == 2] == pytest.approx([log.sum()], rel=1e-6)


def test_query_trains_to_the_end(spark, tmp_path):
    docs = spark.createDataFrame(corpus(seed=5, n=150), SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {"query": queries.op1_lm_scoring(spark, str(tmp_path)), "one": lm.score_texts(docs), "split": lm.score_texts(docs.repartition(11), rounds=None)}
    got = {name: {r["doc_id"]: r for r in df.collect()} for name, df in rows.items()}
    assert all(abs(got["query"][i]["score"] - got["split"][i]["score"]) < 1e-5 * r["n_tokens"] for i, r in got["query"].items())
    learnt = {name: sum(r["score"] for r in by.values() if not r["held_out"]) for name, by in got.items()}
    assert learnt["query"] > learnt["one"] + 0.001 * sum(r["n_tokens"] for r in got["one"].values())


def test_tables_without_training_rows(spark):
    held = next(i for i in range(100) if is_held(i))
    docs = spark.createDataFrame([(held, "a b a b")], "doc_id bigint, text string")
    row = lm.score_texts(docs, rounds=None).first()
    assert row["train_tokens"] == 0 and row["held_out"] and np.isfinite(row["score"])
    assert lm.score_texts(docs.where("doc_id < 0"), rounds=None).count() == 0
