"""Toxic spans by a linear-chain conditional random field.

Token labels come from the labelled documents: in a bounded sample, words and word beginnings that stand
almost only in toxic documents mark their tokens. A two-state chain is fitted to those token labels by
gradient steps on the conditional likelihood, with hashed features of the word and its neighbours.
Forward-backward marginals give spans with offsets; they aggregate to a calibrated document score.

With two states, the messages of forward-backward are log-odds, one number for each token, so whole
batches of documents are updated at once until every message is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import labelled, wordscan

#: Labelled toxic rows to fit on, at most about; of the others CLEAN times as many, every CLEAN-th of them for the chain.
PER_CLASS, CLEAN = 800, 6
#: Rows to fit on have texts of at most so many bytes, which bounds what the fit holds; every text is scored whole.
FIT_BYTES = 20_000
BUCKETS = 1 << 18
STEPS, RATE = 30, 0.7
THRESHOLD = 0.3
#: Marks: at least this share of their documents' weight is toxic, and so many toxic ones would not come by chance.
MARK_SHARE, MARK_MARGIN = 0.97, 3.0

TEMPLATES = 5


def base_features(w: wordscan.Words) -> np.ndarray:
    """(tokens, 3) hashes: the word, its first four and its first five bytes."""
    cols = [w.hash]
    for k in (4, 5):
        whole = (w.end - w.start <= k).astype(np.uint64)  # a word is not the beginning of a longer one
        cols.append(w.prefix.ranges(w.start, np.minimum(w.start + k, w.end)) ^ (np.uint64(k) << np.uint64(40)) ^ (whole << np.uint64(48)))
    return np.stack([(c >> np.uint64(32)).astype(np.uint32) for c in cols], axis=1)


def _first(doc: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], doc[1:] != doc[:-1])) if doc.size else np.zeros(0, bool)


def _columns(base: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(tokens, TEMPLATES) buckets: the base features, the word before and the word after."""
    n = base.shape[0]
    before, after = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    before[1:] = np.where(first[1:], 0, base[:-1, 0])
    after[:-1] = np.where(first[1:], 0, base[1:, 0])
    cols = [*base.T, before * np.uint32(0x9E3779B1) + np.uint32(1), after * np.uint32(0x85EBCA77) + np.uint32(2)]
    return np.stack([(c % np.uint32(BUCKETS)).astype(np.int32) for c in cols], axis=1)


@dataclass
class Chain:
    """Log-odds weights of the toxic state, by bucket and template, and the 2 x 2 transition scores."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -4.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0]))

    def emissions(self, cols: np.ndarray) -> np.ndarray:
        return self.weights[cols].sum(axis=1) + self.bias

    def messages(self, e: np.ndarray, stop: np.ndarray, forward: bool, tolerance: float) -> np.ndarray:
        """Log-odds that reach each token from its past (or future), exact to rounding.

        Every round recomputes only tokens whose neighbour changed; after k rounds all chains of up to k
        tokens are exact, so it ends within the length of the longest text and mostly after a few rounds.
        """
        m = self.move if forward else self.move.T
        inc = np.zeros(e.size)
        todo = np.flatnonzero(~stop)
        step = 1 if forward else -1
        while todo.size:
            x = e[todo - step] + inc[todo - step]
            new = np.logaddexp(m[0, 1], m[1, 1] + x) - np.logaddexp(m[0, 0], m[1, 0] + x)
            moved = np.abs(new - inc[todo]) > tolerance
            inc[todo] = new
            nxt = todo[moved] + step
            nxt = nxt[(nxt >= 0) & (nxt < e.size)]
            todo = nxt[~stop[nxt]]
        return inc

    def marginals(self, e: np.ndarray, first: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(toxic marginals, forward and backward messages)."""
        last = np.concatenate((first[1:], [True])) if e.size else first
        f, b = self.messages(e, first, True, tolerance), self.messages(e, last, False, tolerance)
        return 1 / (1 + np.exp(-np.clip(e + f + b, -500, 500))), f, b

    def document_scores(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_pooled(p, doc, n) @ self.calibration, -40, 40)))


def _pooled(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(1, highest marginal, log of one plus the summed marginals) for each document."""
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    return np.column_stack([np.ones(n), top, np.log1p(np.bincount(doc, p, n))])


def token_labels(base: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """1 for the tokens of toxic documents whose word or beginning stands almost only in toxic documents."""
    out = np.zeros(doc.size, dtype=np.int8)
    before = np.zeros(doc.size, dtype=np.uint64)
    before[1:] = np.where(doc[1:] == doc[:-1], base[:-1, 0], 0)
    bad = y[doc] == 1
    surprise = -np.log(max(y.mean(), 1e-9))
    for col in range(3):
        pairs = np.unique(base[:, col].astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64))
        kind, where = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        values, group = np.unique(kind, return_inverse=True)
        toxic = np.bincount(group, y[where])
        # Copies of one document are no further evidence: occurrences count by the word before them.
        contexts = np.unique(base[bad, col].astype(np.uint64) << np.uint64(32) | before[bad])
        toxic = np.minimum(toxic, np.bincount(np.searchsorted(values, (contexts >> np.uint64(32)).astype(np.uint32)), minlength=values.size))
        share = np.bincount(group, y[where] * weight[where]) / np.bincount(group, weight[where])
        marks = values[(toxic * surprise >= np.log(values.size) + MARK_MARGIN) & (share >= MARK_SHARE)]
        out |= np.isin(base[:, col], marks).astype(np.int8)
    return out * y[doc].astype(np.int8)


def fit(base: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Chain:
    """A chain for sampled documents: tokens in order with their document numbers; labels by document."""
    chain = Chain()
    if not doc.size or not y.any():
        return chain
    gold = token_labels(base, doc, y, weight).astype(float)
    use = (y == 1) | (np.arange(y.size) % CLEAN == 0)
    weight = np.where(y == 1, weight, weight * (y == 0).sum() / max((use & (y == 0)).sum(), 1))[use]
    within = use[doc]
    gold, base, doc, y = gold[within], base[within], (np.cumsum(use) - 1)[doc[within]], y[use]
    first = _first(doc)
    cols = _columns(base, first)
    history, bias_history, move_history = np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    inner = ~first
    counts = np.zeros((2, 2))
    prev = gold[np.flatnonzero(inner) - 1].astype(int)
    np.add.at(counts, (prev, gold[inner].astype(int)), 1)
    flat = cols.reshape(-1)
    for _ in range(STEPS):
        e = chain.emissions(cols)
        p, f, b = chain.marginals(e, first, 1e-4)
        g = gold - p
        grad = np.bincount(flat, np.repeat(g, TEMPLATES), BUCKETS) - 0.05 * chain.weights
        # Pairs of neighbours: the joint follows from both sides' log-odds and the transition scores.
        at = np.flatnonzero(inner)
        a, c = (e + f)[at - 1], (e + b)[at]
        joint = np.stack([np.full(at.size, chain.move[0, 0]), c + chain.move[0, 1], a + chain.move[1, 0], a + c + chain.move[1, 1]], axis=1)
        joint = np.exp(joint - joint.max(axis=1, keepdims=True))
        move_grad = counts - (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2) - 0.05 * chain.move
        history += grad**2
        bias_history += g.sum() ** 2
        move_history += move_grad**2
        chain.weights += RATE * grad / np.sqrt(history)
        chain.bias += RATE * g.sum() / np.sqrt(bias_history)
        chain.move += 0.3 * RATE * move_grad / np.sqrt(move_history)
    p, _, _ = chain.marginals(chain.emissions(cols), first)
    x, beta = _pooled(p, doc, y.size), np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic regression, weighted to the labels' own shares
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(3) * 0.5
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.5 * beta)
    chain.calibration = beta
    return chain


def fit_documents(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str, text_col: str) -> Chain:
    narrow = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    rows, share = labelled.sample(labels, label, {0: CLEAN * per_class, 1: per_class})
    known = labelled.texts(rows, narrow, FIT_BYTES).select(F.col("doc").cast("string").alias("doc"), "y", "text")

    def features(batches):
        for part, texts in wordscan.groups(batches, "text"):
            w = wordscan.Words(texts, breaks=wordscan.PUNCTUATION)
            base = base_features(w)
            cells = [base[a:b].tobytes() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("y"), pa.array(cells, pa.binary())], names=["doc", "y", "base"])

    got = sorted(known.mapInArrow(features, "doc string, y int, base binary").collect(), key=lambda r: (r["doc"], r["y"]))
    base = np.frombuffer(b"".join(bytes(r["base"]) for r in got), np.uint32).reshape(-1, 3)
    doc = np.repeat(np.arange(len(got)), [len(r["base"]) // 12 for r in got])
    y = np.array([r["y"] for r in got], dtype=float)
    return fit(base, doc, y, np.array([1 / share[int(v)] for v in y]))


def _tag(chain: Chain, texts: list[bytes]) -> tuple[wordscan.Words, np.ndarray]:
    w = wordscan.Words(texts, breaks=wordscan.PUNCTUATION)
    first = _first(w.doc)
    return w, chain.marginals(chain.emissions(_columns(base_features(w), first)), first)[0]


def _spans(w: wordscan.Words, p: np.ndarray, n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        d = int(w.doc[i])
        begin, end = int(w.start[i] - w.text_start[d]), int(w.end[i] - w.text_start[d])
        if last == i - 1 and out[d]:
            out[d][-1] |= {"end": end, "marginal": max(out[d][-1]["marginal"], float(p[i]))}
        else:
            out[d].append({"start": begin, "end": end, "marginal": float(p[i])})
        last = i
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, spans) for each document; spans are byte offsets with marginals.

    The chain is fitted on a bounded sample of labelled rows that are not held out, then scores every whole
    text beside its row. Null and empty texts have no spans and the score of a text without marks. Without
    usable labels all scores are low. Repeated rows are each scored; null ids are not held out and have no label.
    An empty table gives no rows. Other columns are not read, so their names may clash with any of these.
    """
    chain = fit_documents(docs, labels, label, per_class, id_col, text_col)
    narrow = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = narrow.schema["doc"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        for part, texts in wordscan.groups(batches, "text"):
            w, p = _tag(chain, texts)
            scores = chain.document_scores(p, w.doc, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(scores, pa.float64()), pa.array(_spans(w, p, len(texts)), span_type)], names=["doc", "score", "spans"])

    scored = narrow.mapInArrow(run, f"doc {kind}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")
    return scored.select(
        F.col("doc").alias(id_col), labelled.held_out(F.col("doc")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"
    )
