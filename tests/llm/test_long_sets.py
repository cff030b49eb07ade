"""Near copies of long texts meet in blocks and classes that are bounded by bytes."""

import random

import pytest

from portica.llm import ngram_join


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def _components(texts):
    sets, up = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up = [up[j] if u == up[i] else u for u in up]
    return {i: min(k for k, u in enumerate(up) if u == up[i]) for i in range(len(texts))}


@pytest.mark.parametrize("long,block", [(256, 2000), (1 << 16, 1), (1, 4000)])
def test_bounds_lose_no_link(spark, monkeypatch, long, block):
    rng, texts = random.Random(7), []
    for base in range(12):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([30, 60, 250, 500]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(copy + [f"y{base}{i}" for i in range(rng.randrange(len(words) // 8))]))
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == _components(texts)
