"""SimHash components against brute force: texts, and points in dense and hot groups."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from portica.llm import simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_labels(fps, most=4):
    """The place of the first point that each point reaches."""
    fp, label = np.array(fps, dtype=np.uint64), np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= most)
        groups = np.unique(label[near])
        if groups.size > 1:
            label[np.isin(label, groups)] = groups.min()
    return label


def texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    out = list(base)
    for t in base[:20]:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "Changed"
            out.append("\t".join(w) if rng.random() < 0.2 else " ".join(w).upper())
    return [*out, None, "", " \n ", "One", "one", base[0], base[0], "x y z", "É é"]


def test_texts(spark):
    some = texts()
    rows = [(i if i % 11 else None, t) for i, t in enumerate(some)] + [(5, some[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("label", F.lit(1)).repartition(3)
    fps = [plain_fingerprint(t) for _, t in rows]
    label = plain_labels(fps)
    least = {k: min((r[0] for r, x in zip(rows, label, strict=True) if x == k and r[0] is not None), default=None) for k in set(label.tolist())}
    want = Counter((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, label.tolist(), strict=True))
    got = simhash.simhash_components(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.simhash_components(docs.where("false")).count() == 0
    assert simhash.simhash_components(docs.where("text = ''")).first()["fingerprint"] == "0" * 16


def as_signed(fps):
    return np.array(fps, dtype=np.uint64).view(np.int64).tolist()


def components_of(spark, fps):
    points = spark.createDataFrame([(x,) for x in as_signed(fps)], "fp bigint").repartition(4)
    found = simhash.point_components(points)
    named = {} if found is None else {r["node"]: r["label"] for r in found.collect()}
    return [named.get(x, x) for x in as_signed(fps)]


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("kind", ["random", "dense", "low", "chain"])
def test_points(spark, kind):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    if kind == "dense":  # a large group whose members differ in some of 18 bits, and points a little further away
        spots = np.uint64(1) << rng.choice(64, 18, replace=False).astype(np.uint64)
        flips = np.array([np.bitwise_xor.reduce(rng.choice(spots, rng.integers(0, 9), replace=False), initial=np.uint64(0)) for _ in range(6000)])
        away = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 7, replace=False).astype(np.uint64)) for _ in range(300)])
        fps = np.concatenate([fps, fps[0] ^ flips, fps[0] ^ away])
    elif kind == "low":  # many points that share most bits but are no group
        fps = np.concatenate([fps, rng.choice(1 << 26, 5000, replace=False).astype(np.uint64) << np.uint64(20)])
    elif kind == "chain":
        chain = [fps[0]]
        for _ in range(200):
            chain.append(chain[-1] ^ np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64)))
        fps = np.concatenate([fps, np.array(chain, dtype=np.uint64)])
    fps = np.unique(fps)
    assert same_groups(components_of(spark, fps), plain_labels(fps).tolist())


def test_every_near_pair_meets():
    rng = np.random.default_rng(1)
    atoms = rng.permutation(64).reshape(-1, simhash.ATOM)
    apart = np.tile(np.array([1, 4, 6, 4, 1]) / 16, (len(atoms), 1))
    for n in (10, 10**5, 10**8, 10**10):
        cuts = simhash.allocate(n, apart)
        assert sum(t + 1 for *_, t in cuts) == simhash.MOST + 1
        masks = simhash.bucket_masks(atoms, cuts)
        diff = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64)) for _ in range(2000)], dtype=np.uint64)
        assert all((masks & d == 0).any() for d in diff)
    assert len(simhash.bucket_masks(atoms, simhash.allocate(10**8, apart))) > len(simhash.bucket_masks(atoms, simhash.allocate(100, apart)))


def test_buckets_longer_than_a_task_holds(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 300)
    monkeypatch.setattr(simhash, "BLOCK", 200)
    fp = np.sort(np.random.default_rng(2).choice(1 << 12, 1000, replace=False)).astype(np.uint64)
    bucket = np.concatenate([np.full(20, 1), np.full(900, 7), np.full(80, 9)]).astype(np.uint64)
    batches = [simhash._rows(bucket[i : i + 90], bucket[i : i + 90], fp[i : i + 90]) for i in range(0, 1000, 90)]
    told = Counter()
    for b in simhash._linked(iter(batches)):
        for a, other, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            told[a] += n if other is None else 0
    assert told[7] > 200 and told[1] == 20 and told[9] == 80
    assert isinstance(next(simhash._linked(iter(batches))), pa.RecordBatch)
