"""Shingles and passages of a third of all rows, and labels whose ids repeat."""

import random

import pytest
from portica.llm import labelled, ngram_join, quality_net, suffix_dedup, toxicity
from pyspark.sql import functions as F

from .test_text_operators import SCHEMA, brute_repeats, lower_words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, whole = sentence(60), sentence(90)
    out = [(i, (shared + " " + sentence(30 + i % 50) if i % 3 == 0 else whole if i % 3 == 1 else sentence(80))) for i in range(300)]
    out += [(300 + i, whole.replace(" ", " x ", 1 + i % 3)) for i in range(20)]
    return [(i, t, "en", "s", len(t)) for i, t in out]


def test_components_with_common_shingles(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    profile = ngram_join._profile(docs.select(F.col("doc_id").alias("doc"), "text"), 5)
    assert ngram_join._common_shingles(profile).size > 50
    sets = {r[0]: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for r in rows for w in [lower_words(r[1])]}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == low


def test_repeats_with_a_shared_passage(spark, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = brute_repeats(rows)
    assert all(got[i][1] == want[i][1] and got[i][3] == want[i][3] for i in got)


def test_samples_stay_small_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "same id")] * 500 + [(1, "another text"), (2, "b"), (None, "n")], "doc bigint, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "doc bigint, y int")
    assert labelled.texts(chosen, docs).count() == 2
    assert [r["doc"] for r in labelled.texts(chosen, docs, 3).collect()] == [2]


def test_scores_with_odd_rows(spark):
    rows = [(i, ("vile slur here " if i % 2 else "kind word here ") * (1 + i % 7), "l", 1.0) for i in range(60)]
    rows += [(3, rows[3][1], "l", 1.0), (None, "kind word", "l", 1.0), (None, None, None, None), (70, "kind word " * 60_000, "l", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, score double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] * 2 + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for f in (toxicity.score_toxicity, quality_net.score_quality):
        got = f(docs, labels).collect()
        assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert f(docs.where("doc_id < 0"), labels).count() == 0 and f(docs, labels.where("doc_id < 0")).count() == len(rows)
