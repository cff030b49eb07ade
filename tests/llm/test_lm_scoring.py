"""The scores of the language model against a plain version with dictionaries and dense sums."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from portica.llm import lm_scoring as lm

from .test_text_operators import SCHEMA, corpus, lower_words


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute_scores(rows, head, hot):
    """Scores by (id, text): class softmax after one gradient step, times pair model of the class."""
    words = [lower_words(t) for _, t in rows]
    learn = [not is_held(i) for i, _ in rows]
    tokens = [lm.Tokens([(t or "").encode()]) for _, t in rows]
    kind_of = {w: k for ws, t in zip(words, tokens, strict=True) for w, k in zip(ws, t.kind.tolist(), strict=True)}
    count = Counter(w for ws, ok in zip(words, learn, strict=True) if ok for w in ws)
    ends = sum(learn)
    total = sum(count.values()) + ends
    n, v = Counter(), Counter()
    for w, c in count.items():
        n[kind_of[w]] += c
        v[kind_of[w]] += 1
    heads = {w for w, c in count.items() if c >= max(head * total, 1)}
    hots = {w for w in heads if count[w] >= hot * total}
    share = lambda w: (count[w] + 1) / (n[kind_of[w]] + v[kind_of[w]] + 1)
    groups, pairs = Counter(), Counter()
    for ws, ok in zip(words, learn, strict=True):
        for a, b in zip([None, *ws], ws) if ok else []:
            if a is None or a in heads:
                groups[a, kind_of[b]] += 1
                if b in heads and not ((a is None or a in hots) and b not in hots):
                    pairs[a, b] += 1
    own = {p: c - lm.DISCOUNT for p, c in pairs.items() if c >= lm.MIN_PAIR}
    left = Counter()
    for (a, b), c in own.items():
        left[a, kind_of[b]] += c

    def word(a, b):
        if not groups[a, kind_of[b]]:
            return share(b)
        g = groups[a, kind_of[b]]
        return own.get((a, b), 0) / g + (1 - left[a, kind_of[b]] / g) * share(b)

    counts = np.zeros((lm.CLASSES + 1, lm.FEATURES))
    features = [t.with_ends()[:2] for t in tokens]
    for (f, k), ok in zip(features, learn, strict=True):
        for j in range(k.size if ok else 0):
            np.add.at(counts, (k[j], f[:, j]), 1)
    weights, bias = lm.start_weights(counts)
    expected = np.zeros_like(counts)
    for (f, k), ok in zip(features, learn, strict=True):
        p = lm._forward(weights, bias, f)
        for j in range(k.size if ok else 0):
            np.add.at(expected.T, f[:, j], p[j].astype(float))
    weights = weights + (lm.RATE * (counts - expected) / (expected + lm.SMOOTH)).T
    out = {}
    for (i, t), ws, (f, k) in zip(rows, words, features, strict=True):
        p = lm._forward(weights, bias, f)
        s = sum(math.log10(p[j, k[j]]) for j in range(k.size))
        out[i, t] = s + sum(math.log10(word(a, b)) for a, b in zip([None, *ws], ws))
    return out


@pytest.mark.parametrize("head, hot", [(1e-6, 1e-3), (0.004, 0.01), (0.9, 0.95)])
def test_scores_match_brute_force(spark, monkeypatch, head, hot):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "HOT", hot)
    rows = [(r[0], r[1]) for r in corpus()] + [(None, "one two three one two"), (3, "other text of this id"), (400, "one two three one two")]
    rows += [(5, rows[5][1])] * 2
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    want = brute_scores(rows, head, hot)
    by_score = sorted((repr(i), s) for (i, t) in rows for s in [want[i, t]])
    found = sorted((repr(r["doc_id"]), r["score"]) for r in got)
    assert len(got) == len(rows)
    for (a, x), (b, y) in zip(by_score, found, strict=True):
        assert a == b and abs(x - y) <= 1e-5 * max(1, abs(x))


def test_score_does_not_depend_on_the_split(spark):
    docs = spark.createDataFrame(corpus(seed=3, n=120), SCHEMA)
    one, many = ({r["doc_id"]: r for r in lm.score_texts(docs.repartition(k)).collect()} for k in (1, 17))
    assert all(abs(one[i]["score"] - many[i]["score"]) < 1e-6 * one[i]["n_tokens"] for i in one)


def test_words_of_a_history_sum_to_one():
    code = np.array([(5 << 21) | w for w in (0, 1, 2, 3)], dtype=np.uint64)
    share = np.array([1.0, 0.5, 0.2, 0.2])  # 0.1 is left to rarer words and one unseen
    move = 10 ** lm.pair_corrections(code, np.array([3.0, 4.0, 1.0, 2.0]), share)
    assert math.isclose(sum(move[1:] * share[1:]) + move[0] * 0.1, 1.0)


def test_columns_with_other_uses_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b a b", "x", 5), (2, None, "y", 6)], "doc_id bigint, text string, uid string, kind int")
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    assert got[1]["n_tokens"] == 5 and got[2]["n_tokens"] == 1 and got[2]["score"] <= 0


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "lang wort " * 150_000), (2, "kurz")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    assert got[1]["n_tokens"] == 300_001 and math.isfinite(got[1]["score"])
