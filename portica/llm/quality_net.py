"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a sparse ternary index vector that follows from its hash. One pass over all documents sums
the index vectors of a word's neighbours into its context vector (words share `SLOTS` hashed rows), so the
tables stay small and sum across tasks. A document is the mean of its words' normalised context vectors
with a few surface ratios; a numpy network scores it, with a temperature fitted on rows that it did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange, labelled, quality_rules, wordscan

SLOTS, DIMS, NONZERO, REACH = 1 << 13, 32, 3, 2
#: Labelled rows of each class to fit on, at most about.
PER_CLASS = 6000
HIDDEN, EPOCHS, BATCH = 24, 40, 256
THRESHOLD = 0.7


def _index(h: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    places, signs = [], []
    for k in range(NONZERO):
        bits = h >> np.uint64(16 * k)
        places.append((bits % np.uint64(DIMS)).astype(np.int64))
        signs.append(1.0 - 2.0 * ((bits >> np.uint64(12)) & np.uint64(1)).astype(np.float64))
    return places, signs


def _accumulate(table: np.ndarray, w: wordscan.Words) -> None:
    """Adds the index vectors of each word's neighbours (same text, up to REACH apart) to its slot."""
    slot = (w.hash >> np.uint64(48)).astype(np.int64) % SLOTS
    places, signs = _index(w.hash)
    for gap in range(1, REACH + 1):
        n = w.hash.size - gap
        if n <= 0:
            return
        same = (w.doc[gap:] == w.doc[:n]).astype(np.float64)
        for k in range(NONZERO):
            table += np.bincount(slot[gap:] * DIMS + places[k][:n], signs[k][:n] * same, SLOTS * DIMS)
            table += np.bincount(slot[:n] * DIMS + places[k][gap:], signs[k][gap:] * same, SLOTS * DIMS)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The (SLOTS, DIMS) context vectors of a corpus, rows of unit length; a fixed size for any input."""

    n_parts = exchange.targets(docs.sparkSession)  # as many sums as buckets, so none meets more as the corpus grows

    def count(batches):
        table = np.zeros(SLOTS * DIMS)
        for _, texts in wordscan.groups(batches, "text"):
            _accumulate(table, wordscan.Words(texts))
        if table.any():
            yield exchange.rows(list(range(n_parts)), [b.astype(np.float32).tobytes() for b in np.array_split(table, n_parts)])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0.0) + np.frombuffer(payload, np.float32).astype(np.float64)
        if sums:
            yield exchange.rows(list(sums), [v.tobytes() for v in sums.values()])

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(count, exchange.SCHEMA)
    segments = np.array_split(np.zeros(SLOTS * DIMS), n_parts)
    for row in exchange.deal(counted, n_parts).mapInArrow(total, exchange.SCHEMA).collect():
        segments[row["part"]] = np.frombuffer(row["payload"], np.float64)
    table = np.concatenate(segments).reshape(SLOTS, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Pooled vectors and surface ratios, a row for each text; zeros where there are no words."""
    w = wordscan.Words(texts)
    slot = (w.hash >> np.uint64(48)).astype(np.int64) % SLOTS
    many = np.maximum(w.counts, 1)
    pooled = np.zeros((len(texts), DIMS))
    if slot.size:
        full = np.flatnonzero(w.counts)
        pooled[full] = np.add.reduceat(table[slot], w.first[:-1][full], axis=0)
    pooled /= many[:, None]
    m = quality_rules._measure(texts)
    ratio = [
        np.log1p(m["n_words"]) / 5,
        m["word_chars"] / many / 10,
        np.minimum(m["n_symbols"] / many, 2),
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        m["n_repeat_words"] / many,
        m["n_upper"] / np.maximum(m["word_chars"], 1),
        np.minimum(m["n_exclaim"] / many, 2),
    ]
    return np.column_stack([pooled, *ratio])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _weighted_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) / np.sum(weight))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, key: np.ndarray, seed: int = 5) -> Network:
    """Adam on weighted cross-entropy; every fifth row by key is kept for the temperature."""
    order = np.argsort(key)
    x, y, weight = x[order], y[order], weight[order]
    rng = np.random.default_rng(seed)
    apart = np.arange(y.size) % 5 == 4
    xt, yt, wt = (x[~apart], y[~apart], weight[~apart]) if y.size >= 25 else (x, y, weight)
    d = x.shape[1]
    net = Network(
        xt.mean(axis=0) if yt.size else np.zeros(d), (xt.std(axis=0) if yt.size else np.ones(d)) + 1e-6,
        rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0,
    )
    if not yt.size:
        return net
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = np.clip((xt - net.mean) / net.scale, -8, 8)
    for _ in range(EPOCHS):
        turn = rng.permutation(yt.size)
        for at in range(0, yt.size, BATCH):
            rows = turn[at : at + BATCH]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - yt[rows]) * wt[rows] / wt[rows].sum()
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            step += 1
            for i, gr in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr * gr
                params[i] -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if y.size >= 25:
        zc = net.logits(x[apart])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(min(grid, key=lambda t: _weighted_loss(zc / t, y[apart], weight[apart])))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each document.

    Corpus vectors come from all documents; the network is fitted on a bounded sample of labelled rows that
    are not held out. Null and empty texts are scored from zero features. Without usable labels the score is
    that of an untrained network. Repeated rows are each scored; null ids are not held out and have no label. An
    empty table gives no rows. Other columns are not read, so their names may clash with any of these.
    """
    table = context_vectors(docs, text_col)
    narrow = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = narrow.schema["doc"].dataType.simpleString()
    rows, share = labelled.sample(labels, label, {0: per_class, 1: per_class})
    known = labelled.texts(rows, narrow)

    def measure(batches):
        for part, texts in wordscan.groups(batches, "text"):
            x = features(texts, table)
            key = [str(d) for d in part.column("doc").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc", "y", "x"])

    fitted = known.mapInArrow(measure, "doc string, y int, x array<double>").toPandas()
    y = fitted["y"].to_numpy(dtype=float)
    x = np.array(fitted["x"].tolist()).reshape(len(y), -1) if len(y) else np.zeros((0, DIMS + 7))
    weight = np.array([1 / share[int(v)] for v in y])
    net = fit(x, y, weight, fitted["doc"].to_numpy(dtype=str))

    def score(batches):
        for part, texts in wordscan.groups(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(net.scores(features(texts, table)), pa.float64())], names=["doc", "score"])

    scored = narrow.mapInArrow(score, f"doc {kind}, score double")
    return scored.select(F.col("doc").alias(id_col), labelled.held_out(F.col("doc")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
