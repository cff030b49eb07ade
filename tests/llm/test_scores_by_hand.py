"""Toxicity and quality scores of whole tables against plain loops over words."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from portica.llm import quality_net, quality_rules, toxicity, wordscan

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    good = ["river", "stone", "paper", "window", "garden", "music", "letter", "été"]
    bad = ["vilest", "scum", "filth"]
    texts = []
    for i in range(160):
        words = [rng.choice(good) for _ in range(rng.randint(0, 7))]
        if i % 4 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        texts.append(" ".join(words).capitalize() + ("." if i % 3 else "!!"))
    return [(i, t, int(i % 4 == 0)) for i, t in enumerate([*texts, None, "", " \n"])]


def frames(spark, rows, label):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(3)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id bigint, {label} int")


def test_toxicity_by_all_paths(spark, rows):
    docs, labels = frames(spark, rows, "toxic")
    chain = toxicity.fit_documents(docs, labels, "toxic", toxicity.PER_CLASS, "doc_id", "text")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and sum(r["predicted"] for r in got.values()) > 20
    for i, text, _ in rows:
        raw = (text or "").encode()
        words = [(m.start(), m.end()) for m in RUN.finditer(raw)]
        hashes = [toxicity.base_features(wordscan.Words([raw[a:b]], breaks=wordscan.PUNCTUATION))[0] for a, b in words]
        e = []
        for j, h in enumerate(hashes):
            before, after = (hashes[j - 1][0] if j else np.uint32(0)), (hashes[j + 1][0] if j + 1 < len(hashes) else np.uint32(0))
            own = [int(x) for x in h] + [(int(before) * 0x9E3779B1 + 1) % 2**32, (int(after) * 0x85EBCA77 + 2) % 2**32]
            e.append(sum(chain.weights[x % toxicity.BUCKETS] for x in own) + chain.bias)
        total, on = 0.0, [0.0] * len(e)
        for path in itertools.product((0, 1), repeat=len(e)):
            weight = math.exp(sum(x for x, s in zip(e, path, strict=True) if s) + sum(chain.move[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            on = [m + weight * s for m, s in zip(on, path, strict=True)]
        marginal = [m / total for m in on]
        z = np.dot([1.0, max(marginal, default=0.0), math.log1p(sum(marginal))], chain.calibration)
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6) and got[i]["held_out"] == held_out(i)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        tagged = [w for w, m in zip(words, marginal, strict=True) if m >= 0.5]
        inside = {(a, b) for s in got[i]["spans"] for a, b in words if s["start"] <= a and b <= s["end"]}
        assert inside == set(tagged)


def test_quality_by_hand(spark, rows):
    docs, labels = frames(spark, rows, "quality")
    split = {i: WORD.findall((t or "").encode().lower()) for i, t, _ in rows}
    table = np.zeros((quality_net.SLOTS, quality_net.DIMS))

    def slot(word):
        h = wordscan.Words([word]).hash
        return int(h[0] >> np.uint64(48)) % quality_net.SLOTS, quality_net._index(h)

    for words in split.values():
        for j, w in enumerate(words):
            for k in range(max(0, j - quality_net.REACH), min(len(words), j + quality_net.REACH + 1)):
                if k != j:
                    places, signs = slot(words[k])[1]
                    for p, s in zip(places, signs, strict=True):
                        table[slot(w)[0], p[0]] += s[0]
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    np.testing.assert_allclose(quality_net.context_vectors(docs), table, atol=1e-6)
    x = {}
    for i, t, _ in rows:
        words, many = split[i], max(len(split[i]), 1)
        m = {k: v[0] for k, v in quality_rules._measure([(t or "").encode()]).items()}
        pooled = sum((table[slot(w)[0]].astype(float) for w in words), np.zeros(quality_net.DIMS)) / many
        chars = sum(len(w.decode()) for w in words)
        ratio = [math.log1p(len(words)) / 5, chars / many / 10, min(m["n_symbols"] / many, 2), m["n_dup_lines"] / max(m["n_lines"], 1), m["n_repeat_words"] / many, m["n_upper"] / max(chars, 1), min((t or "").count("!") / many, 2)]
        x[i] = np.concatenate([pooled, ratio])
    known = [i for i, *_ in rows if not held_out(i)]
    net = quality_net.fit(np.array([x[i] for i in known]), np.array([float(rows[i][2]) for i in known]), np.ones(len(known)), np.array([str(i) for i in known]))
    got = {r["doc_id"]: r for r in quality_net.score_quality(docs, labels).collect()}
    for i, *_ in rows:
        h = np.tanh(np.clip((x[i] - net.mean) / net.scale, -8, 8) @ net.w1 + net.b1)
        want = 1 / (1 + math.exp(-(h @ net.w2 + net.b2) / net.temperature))
        assert abs(got[i]["score"] - want) < 1e-4 and got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == held_out(i)
