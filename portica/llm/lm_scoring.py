"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, word before). A word's class follows from its last
bytes; the end of text is a class of its own.

* The first factor is a softmax over classes whose scores are sums of weights for hashed features of the
  history: the words one, two and three back (skips) and the pair before (n-gram). The weights start from the
  counts of feature and class over all training texts, then climb the log-likelihood less a Gaussian prior
  around that start, which has one maximum: every task sums the gradient of all its histories at the shared
  weights, Spark adds the tasks up, one step of L-BFGS follows, until a step gains less than `GAIN` nats a
  token. Each history of a task is held once, with how often it stands. So the result does not depend on how
  the table is split. `rounds` asks for so many steps instead.
* The second factor is the maximum-entropy model of a class with one feature for each pair of words: its
  constraints are the counts of pairs seen twice or more, less a discount, and the word's share of its class.
  The weights of pairs then have a closed form. Their table grows with the corpus and stays in hash buckets.

Words of at least `HEAD` of the training tokens have ids (so they are a million at most), which tasks hold.
Rarer words and pairs of ids travel packed to hash buckets, which count them and send back sums for each
document. Pairs of words that both have `HOT` of the tokens (a thousand words at most) are counted in tasks
instead, so no key of a bucket has more than that share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import exchange, wordscan
from .exchange import saved

CLASSES = 15  # of words; the end of text is one more
FEATURES = 1 << 16
TEMPLATES = 4
ROUNDS = 1
RATE = 0.5
#: Steps that L-BFGS remembers; the gain in nats a token below which a step is the last.
MEMORY, GAIN = 6, 1e-4
#: Pseudo-counts of a feature's class shares, which are the prior's precision too, and the share of their
#: log-odds that weights start from.
SMOOTH, START = 30.0, 0.5
#: Taken from the count of each pair that is seen MIN_PAIR times or more.
DISCOUNT, MIN_PAIR = 1.0, 2
HEAD, HOT = 1e-6, 1e-3
#: Histories whose shares are added to the cells at once; tokens whose class scores are held at once, which a
#: core's cache has room for.
BATCH, STEP = 1 << 18, 1 << 12
#: No sum of exponentials of 32-bit scores overflows or vanishes below.
TAME = 80.0
_K = CLASSES + 1
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_RARE, _PRESENT = np.uint64(1 << 63), np.uint64(1 << 62)
_ROWS = "part int, kind int, payload binary"


def held_out(doc_id: Column) -> Column:
    """True for documents that are scored but not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class Tokens:
    """The words of several texts in order: hash (its last four bits are the class), text number."""

    def __init__(self, texts: list[bytes]):
        w = wordscan.Words(texts)
        tail = w.prefix.ranges(np.maximum(w.end - 2, w.start), w.end)
        self.kind = ((tail >> np.uint64(32)) % np.uint64(CLASSES)).astype(np.int64)
        self.hash = (w.hash & ~np.uint64(15)) | self.kind.astype(np.uint64)
        self.doc, self.counts, self.first, self.n_texts = w.doc, w.counts, w.first, len(texts)

    def with_ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature rows by template, class, text number) of all tokens, an end after each text."""
        n = self.hash.size + self.n_texts
        end_at = self.first[1:] + np.arange(self.n_texts)
        word = np.ones(n, dtype=bool)
        word[end_at] = False
        h = np.zeros(n, dtype=np.uint64)
        h[word] = self.hash
        kind = np.full(n, CLASSES, dtype=np.int64)
        kind[word] = self.kind
        doc = np.repeat(np.arange(self.n_texts), self.counts + 1)
        back = []
        for gap in (1, 2, 3):
            b = np.zeros(n, dtype=np.uint64)
            b[gap:] = np.where(doc[gap:] == doc[:-gap], h[:-gap], np.uint64(0))
            back.append(b)
        keys = [*back, back[0] * _SALT[0] + back[1]]
        rows = np.stack([(wordscan.mix(k + s) >> np.uint64(40)).astype(np.int64) % FEATURES for k, s in zip(keys, _SALT, strict=True)])
        return rows, kind, doc


class Heads:
    """Ids of frequent words by falling count, their counts and shares of their class; looked up by slots."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_by_class: np.ndarray, v_by_class: np.ndarray, n_ends: int):
        order = np.lexsort((hashes, -counts))
        self.hash, self.count = hashes[order], counts[order]
        self.n_ends, self.total = n_ends, int(n_by_class.sum()) + n_ends
        self.distinct = int(v_by_class.sum()) + (n_ends > 0)
        self.by_class = np.log10(n_by_class + v_by_class + 1.0)
        self.log_count = np.log10(self.count + 1.0)
        self.share = (self.count + 1.0) / 10 ** self.by_class[(self.hash & np.uint64(15)).astype(np.int64)]
        self.n_hot = int((self.count >= HOT * self.total).sum())
        self.mask = np.uint64((1 << max(int(self.hash.size * 4).bit_length(), 8)) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        slot = self._slot(self.hash)
        self.slots[slot[::-1]] = np.arange(self.hash.size, dtype=np.int32)[::-1]
        crowded = self.slots[slot] != np.arange(self.hash.size)
        others = np.flatnonzero(crowded)
        self.others = others[np.argsort(self.hash[others])]
        self.other_hash = self.hash[self.others]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(20)) & self.mask).astype(np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The id of each word, -1 for rarer ones."""
        out = self.slots[self._slot(h)].astype(np.int64)
        if not self.hash.size:
            return out
        wrong = np.flatnonzero((out >= 0) & (self.hash[out] != h))
        out[wrong] = -1
        if wrong.size and self.others.size:
            at = np.minimum(np.searchsorted(self.other_hash, h[wrong]), self.others.size - 1)
            hit = self.other_hash[at] == h[wrong]
            out[wrong[hit]] = self.others[at[hit]]
        return out


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h, c = h[order], c[order]
    heads = np.concatenate(([0], np.flatnonzero(np.diff(h)) + 1))
    return h[heads], np.add.reduceat(c, heads)


def count_words(docs: DataFrame, n_parts: int) -> Heads:
    """Exact counts of all training words, summed in tasks before they travel; words of HEAD and more get ids."""

    def pieces(held):
        h, c = _merged(held)
        part = (h >> np.uint64(32)) % np.uint64(n_parts)
        order = np.argsort(part, kind="stable")
        h, c, part = h[order], c[order], part[order].astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [part.size]))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return exchange.rows([int(part[a]) for a, _ in spans], [exchange.pack(h[a:b], c[a:b].astype(np.uint32)) for a, b in spans])

    def send(batches):
        held, size = [], 0
        for _, texts in wordscan.groups(batches, "text"):
            h = np.sort(Tokens(texts).hash)
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if h.size else np.empty(0, np.int64)
            held.append((h[heads], np.diff(np.append(heads, h.size)).astype(np.int64)))
            size += heads.size
            if size > 2_000_000:
                held = [_merged(held)]
                size = held[0][0].size
                if size > 1_000_000:
                    yield pieces(held)
                    held, size = [], 0
        if size:
            yield pieces(held)

    def total(batches):
        held = [tuple(exchange.unpack(p, np.uint64, np.uint32)) for batch in batches for p in batch.column("payload").to_pylist()]
        if held:
            h, c = _merged([(h, c.astype(np.int64)) for h, c in held])
            kind = (h & np.uint64(15)).astype(np.int64)
            yield exchange.rows([0, 1], [exchange.pack(np.bincount(kind, c, CLASSES), np.bincount(kind, minlength=CLASSES)), exchange.pack(h, c)])

    learn = docs.where(~F.col("held_out"))
    counted = saved(exchange.deal(learn.select("text").mapInArrow(send, exchange.SCHEMA), n_parts).mapInArrow(total, exchange.SCHEMA))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counted.where("part = 0").collect():
        a, b = exchange.unpack(row["payload"], np.float64, np.int64)
        n, v = n + a, v + b
    n_ends = learn.count()
    least = max(HEAD * (n.sum() + n_ends), 1)

    def frequent(batches):
        for batch in batches:
            for p in batch.column("payload").to_pylist():
                h, c = exchange.unpack(p, np.uint64, np.int64)
                yield exchange.rows([0], [exchange.pack(h[c >= least], c[c >= least])])

    rows = [exchange.unpack(r["payload"], np.uint64, np.int64) for r in counted.where("part = 1").mapInArrow(frequent, exchange.SCHEMA).collect()]
    h, c = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return Heads(h, c, n, v, n_ends)


class _Table:
    """Sums by (class, feature row) over the texts of a task; sent in as many segments as there are buckets."""

    def __init__(self, n_parts: int):
        self.n_parts, self.cells, self.any = n_parts, np.zeros((_K, FEATURES)), False

    def add(self, rows: np.ndarray, weight: np.ndarray) -> None:
        """Adds weights by class to the rows of each template; those of the last template are in order."""
        last = rows[-1]
        heads = np.flatnonzero(np.diff(last, prepend=-1))
        for cells, w in zip(self.cells, weight, strict=True):
            for r in rows[:-1]:
                cells += np.bincount(r, w, FEATURES)
            cells[last[heads]] += np.add.reduceat(w, heads)
        self.any = True

    def count(self, rows: np.ndarray, kind: np.ndarray) -> None:
        self.cells += np.bincount((kind * FEATURES + rows).reshape(-1), minlength=_K * FEATURES).reshape(_K, FEATURES)
        self.any = True

    def pieces(self) -> list[tuple[int, bytes]]:
        pack = zstandard.ZstdCompressor(level=1)
        return [(i, pack.compress(x.tobytes())) for i, x in enumerate(np.array_split(self.cells.astype(np.float32).reshape(-1), self.n_parts)) if x.any()] if self.any else []


def _sum_pieces(payloads: list) -> np.ndarray:
    """The sum of pieces, some of them sums already."""
    undo = zstandard.ZstdDecompressor()
    return sum(p if isinstance(p, np.ndarray) else np.frombuffer(undo.decompress(p), np.float32).astype(np.float64) for p in payloads)


def _from_pieces(rows: list[tuple[int, bytes]], n_parts: int) -> np.ndarray:
    segments = np.array_split(np.zeros(_K * FEATURES), n_parts)
    for part, payload in rows:
        segments[part] = np.frombuffer(payload, np.float64)
    return np.concatenate(segments).reshape(_K, FEATURES)


def _pairs(t: Tokens, heads: Heads) -> tuple[np.ndarray, np.ndarray]:
    """(id of the word, id of the word before): -1 for rare words, `n_hot` less than -1 for none before."""
    ids = heads.ids(t.hash)
    before = np.full(ids.size, -2, dtype=np.int64)
    before[1:] = np.where(t.doc[1:] == t.doc[:-1], ids[:-1], -2)
    return ids, before


def _hot(ids: np.ndarray, before: np.ndarray, n_hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens after a hot word or at the start, row of the hot tables for each); the start is the last row."""
    at = np.flatnonzero((before == -2) | ((before >= 0) & (before < n_hot)))
    return at, np.where(before[at] == -2, n_hot, before[at])


def _send(batches, heads: Heads, n_parts: int):
    """Entries of rare words and of pairs to their buckets; counts of features and of hot pairs at the end."""
    sender, table, n_hot = exchange.Sender(n_parts), _Table(n_parts), heads.n_hot
    pairs, groups = np.zeros((n_hot + 1) * n_hot, dtype=np.int64), np.zeros((n_hot + 1) * _K, dtype=np.int64)
    for part, texts in wordscan.groups(batches, "text"):
        t = Tokens(texts)
        uid = np.array(part.column("uid").to_pylist(), dtype=np.int64)
        learn = np.array([not x for x in part.column("held_out").to_pylist()], dtype=bool)
        rows, kind, doc = t.with_ends()
        keep = learn[doc]
        table.count(rows[:, keep], kind[keep])
        ids, before = _pairs(t, heads)
        at, row = _hot(ids, before, n_hot)
        use = learn[t.doc[at]]
        at, row = at[use], row[use]
        groups += np.bincount(row * _K + t.kind[at], minlength=groups.size)
        both = (ids[at] >= 0) & (ids[at] < n_hot)
        if n_hot:
            pairs += np.bincount(row[both] * n_hot + ids[at][both], minlength=pairs.size)
        rare, paired = np.flatnonzero(ids < 0), np.flatnonzero(before >= n_hot)
        group = (before[paired].astype(np.uint64) << np.uint64(4)) | t.kind[paired].astype(np.uint64)
        code = np.concatenate((t.hash[rare] | _RARE, (group << np.uint64(21)) | (ids[paired] + 1).astype(np.uint64), np.full(uid.size, _PRESENT)))
        owner = np.concatenate((t.doc[rare], t.doc[paired], np.arange(uid.size)))
        target = np.concatenate(((t.hash[rare] >> np.uint64(32)) % np.uint64(n_parts), wordscan.mix(group) % np.uint64(n_parts), (uid % n_parts).astype(np.uint64)))
        order = np.argsort(owner, kind="stable")
        sender.add(target[order], owner[order], [code[order]], [uid, learn.astype(np.uint8)])
        if sender.full() and (out := sender.flush()):
            yield _kinded(out, 0)
    if out := sender.flush():
        yield _kinded(out, 0)
    if sent := table.pieces():
        yield _kinded(exchange.rows(*map(list, zip(*sent, strict=True))), 1)
    flat = np.concatenate((pairs, groups))
    cells = np.flatnonzero(flat)
    cuts = np.searchsorted(cells, -(-np.arange(n_parts + 1) * flat.size // n_parts))
    some = [(i, exchange.pack(cells[a:b], flat[cells[a:b]])) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
    if some:
        yield _kinded(exchange.rows(*map(list, zip(*some, strict=True))), 2)


def _kinded(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("part"), pa.array([kind] * batch.num_rows, pa.int32()), batch.column("payload")], names=["part", "kind", "payload"])


def pair_corrections(code: np.ndarray, count: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of P(word | class, word before) over the word's share, for distinct codes in order.

    A code is a group (word before, class) and the id of the word from 1, or 0 for a rarer one; `share` is the
    word's share of its class. Pairs keep their discounted share of the group; what they leave is dealt by `share`.
    """
    if not code.size:
        return np.empty(0)
    word = (code & np.uint64((1 << 21) - 1)).astype(np.int64)
    heads = np.concatenate(([True], np.diff(code >> np.uint64(21)) != 0))
    group = np.cumsum(heads) - 1
    n = np.bincount(group, count)[group]
    own = np.where((word > 0) & (count >= MIN_PAIR), count - DISCOUNT, 0.0)
    left = 1 - np.bincount(group, own)[group] / np.maximum(n, 1)
    return np.log10(left + own / np.maximum(n, 1) / share[word])


def _settle(batches, heads: Heads, n_parts: int):
    """Counts a bucket's entries; gives sums by document, and the sums of the tables."""
    entries, tables, hot, part = [], [], [], 0
    for batch in batches:
        for part, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload")), strict=True):
            if kind == 2:
                hot.append(tuple(exchange.unpack(payload, np.int64, np.int64)))
                if len(hot) == 64:
                    hot = [_merged(hot)]  # a bucket's cells are few, however many tasks send them
            elif kind == 1:
                tables.append(payload)
                if len(tables) == 64:
                    tables = [_sum_pieces(tables)]
            else:
                entries.append((part, payload))
    if tables:
        yield _kinded(exchange.rows([part], [_sum_pieces(tables).tobytes()]), 1)
    if hot:
        yield _kinded(exchange.rows([part], [exchange.pack(*_merged(hot))]), 2)
    if not entries:
        return
    cols = [np.concatenate(c) for c in zip(*(exchange.unpack(p, np.int64, np.uint8, np.uint32, np.uint64) for _, p in entries), strict=True)]
    uid, learn, per, code = cols
    owner = np.repeat(np.arange(uid.size), per)
    names, place = np.unique(code, return_inverse=True)
    count = np.bincount(place, learn[owner], names.size)
    rare, pair = names >= _RARE, names < _PRESENT
    value = np.zeros(names.size)
    value[rare] = np.log10(count[rare] + 1)
    value[pair] = pair_corrections(names[pair], count[pair], np.concatenate(([1.0], heads.share)))
    is_rare, is_pair, n = rare[place], pair[place], uid.size
    logs = np.bincount(owner, np.where(is_rare, value[place], 0), n)
    moved = np.bincount(owner, np.where(is_pair, value[place], 0), n)
    known = np.bincount(owner, is_rare & (count[place] > 0), n).astype(np.uint32)
    times = np.bincount(owner, ~(is_rare | is_pair), n).astype(np.uint32)
    order = np.argsort(uid % n_parts, kind="stable")
    sender = exchange.Sender(n_parts)
    sender.add(uid[order] % n_parts, order, [logs[order], moved[order], known[order], times[order]], [uid])
    if out := sender.flush():
        yield _kinded(out, 0)


def _sum_documents(batches):
    (uid,), per, (logs, moved, known, times) = exchange.read_all(batches, [np.int64], [np.float64, np.float64, np.uint32, np.uint32])
    if not uid.size:
        return
    owner = np.repeat(uid, per)
    order = np.lexsort((moved, logs, owner))
    owner, logs, moved, known, times = owner[order], logs[order], moved[order], known[order], times[order]
    heads = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    rows = np.add.reduceat(times, heads)  # rows that repeat share a uid, and each is present once
    sums = [np.add.reduceat(x.astype(np.float64), heads) / rows for x in (logs, moved, known)]
    yield pa.RecordBatch.from_arrays([pa.array(owner[heads]), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.rint(sums[2]).astype(np.int64))], names=["uid", "rare_logs", "moved", "rare_known"])


def start_weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights by row and class, bias by class) from the counts by class and row."""
    share = counts.sum(axis=1) + 1.0
    share /= share.sum()
    odds = np.log((counts + SMOOTH * share[:, None]) / ((counts.sum(axis=0) + SMOOTH) * share[:, None]))
    return np.ascontiguousarray((START * odds).T, dtype=np.float32), np.log(share).astype(np.float32)


def _halved(z: np.ndarray, join) -> np.ndarray:
    """The columns of z joined to one, half by half."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        odd = z[:, 2 * half :]
        z = join(z[:, :half], z[:, half : 2 * half])
        if odd.size:
            z[:, :1] = join(z[:, :1], odd)
    return z


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no class score can pass `TAME` either way, so that scores need no shift before exp."""
    return bool(TEMPLATES * np.abs(weights).max() + np.abs(bias).max() < TAME)


def _classes(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials of class scores, their sum, log of that before any shift) of tokens, of which `rows` has the feature rows by template."""
    z = np.take(weights, rows[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=more, mode="clip")
    z += bias
    top = np.zeros((1, 1), dtype=np.float32) if tame else _halved(z, np.maximum)
    if not tame:
        z -= top
    np.exp(z, out=z)
    total = np.einsum("ij->i", z)
    return z, total, top[:, 0] + np.log(total)


def _forward(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, tame: bool = False) -> np.ndarray:
    """Class probabilities of tokens."""
    z, total, _ = _classes(weights, bias, rows, tame)
    z /= total[:, None]
    return z


def _histories(batches):
    """The distinct histories of a task's texts as sorted feature rows, and how often each stands."""
    pack, places = zstandard.ZstdCompressor(level=1), [np.uint64(16 * i) for i in range(TEMPLATES)]

    def piece(keys):
        held, times = np.unique(np.concatenate(keys), return_counts=True)
        return pack.compress(exchange.pack(*((held >> i).astype(np.uint16) for i in places), times.astype(np.uint32)))

    keys, size = [], 0
    for _, texts in wordscan.groups(batches, "text"):
        rows = Tokens(texts).with_ends()[0].astype(np.uint64)
        keys.append(sum((r << i for r, i in zip(rows[1:], places[1:], strict=True)), start=rows[0]))
        size += keys[-1].size
        if size > 2_000_000:
            yield exchange.rows([0], [piece(keys)])
            keys, size = [], 0
    if size:
        yield exchange.rows([0], [piece(keys)])


def _expect(batches, weights: np.ndarray, bias: np.ndarray, n_parts: int):
    """What the model expects of each cell (kind 1), and the sum of the logs of its divisors (kind 2)."""
    table, logs, undo, tame = _Table(n_parts), 0.0, zstandard.ZstdDecompressor(), _tame(weights, bias)
    shares = np.empty((_K, BATCH))
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            *held, times = exchange.unpack(undo.decompress(payload), *[np.uint16] * TEMPLATES, np.uint32)
            for at in range(0, times.size, BATCH):
                rows, n = np.stack([x[at : at + BATCH] for x in held]).astype(np.int64), times[at : at + BATCH]
                for a in range(0, n.size, STEP):
                    some = n[a : a + STEP]
                    p, total, log = _classes(weights, bias, rows[:, a : a + STEP], tame)
                    logs += float(log.astype(np.float64) @ some)
                    p *= (some / total).astype(np.float32)[:, None]
                    shares[:, a : a + some.size] = p.T
                table.add(rows, shares[:, : n.size])
    if sent := table.pieces():
        yield _kinded(exchange.rows(*map(list, zip(*sent, strict=True))), 1)
        yield _kinded(exchange.rows([0], [exchange.pack(np.array([logs]))]), 2)


def _total(batches):
    tables, logs, part = [], [], 0
    for batch in batches:
        for part, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload")), strict=True):
            if kind == 2:
                logs.append(exchange.unpack(payload, np.float64)[0][0])
                continue
            tables.append(payload)
            if len(tables) == 64:
                tables = [_sum_pieces(tables)]
    if tables:
        yield _kinded(exchange.rows([part], [_sum_pieces(tables).tobytes()]), 1)
    if logs:
        yield _kinded(exchange.rows([part], [exchange.pack(np.array([sum(logs)]))]), 2)


def _ascent(slope: np.ndarray, scale: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The next step of L-BFGS: `past` holds steps and how much of the slope each took away, `scale` stands for the curvature."""
    step, shares = slope.copy(), []
    for s, y in reversed(past):
        shares.append((s * step).sum() / (s * y).sum())
        step -= shares[-1] * y
    step *= scale * ((past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2 * scale).sum() if past else RATE)
    for (s, y), share in zip(past, reversed(shares), strict=True):
        step += s * (share - (y * step).sum() / (s * y).sum())
    return step


def train(docs: DataFrame, counts: np.ndarray, n_parts: int, rounds: int | None = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the classes, by steps over all training texts from the weights of the counts.

    What is climbed is the log-likelihood less SMOOTH / 2 times the squared way from the start. The gradient of a
    cell is its count less what the model expects and the prior's pull; steps are scaled by the expected count.
    Without `rounds`, steps go on until one gains less than GAIN a token; one that would lose is halved.
    """
    start, bias = start_weights(counts)
    if rounds == 0:
        return start, bias
    wanted, by_class = counts.T, counts.sum(axis=1) / TEMPLATES
    least = GAIN * by_class.sum()
    held = saved(docs.where(~F.col("held_out")).select("text").mapInArrow(_histories, exchange.SCHEMA))
    # A task sends a table of one size whatever it holds, so few tasks with much each.
    held = held.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, held.rdd.getNumPartitions() // 8))

    def look(weights):
        sent = held.mapInArrow(lambda b: _expect(b, weights, bias, n_parts), _ROWS)
        got = exchange.deal(sent, n_parts).mapInArrow(_total, _ROWS).collect()
        expected = _from_pieces([(r["part"], r["payload"]) for r in got if r["kind"] == 1], n_parts).T
        logs = sum(exchange.unpack(r["payload"], np.float64)[0][0] for r in got if r["kind"] == 2)
        way = weights.astype(np.float64) - start
        value = (wanted * weights).sum() + by_class @ bias - logs - SMOOTH / 2 * (way**2).sum()
        return value, wanted - expected - SMOOTH * way, 1 / (expected + SMOOTH)

    weights, past, left = start, [], rounds
    value, slope, scale = look(weights)
    while True:
        step = _ascent(slope, scale, past)
        if left == 1:
            return np.ascontiguousarray(weights + step, dtype=np.float32), bias
        while True:
            ahead = np.ascontiguousarray(weights + step, dtype=np.float32)
            at, slope_at, scale_at = look(ahead)
            if at >= value:
                break
            step = step / 2
            if (slope * step).sum() < least:  # the objective is concave: no step this way gains more
                return weights, bias
        gained, left = at - value, left and left - 1
        past = [*past, (ahead.astype(np.float64) - weights, slope - slope_at)][-MEMORY:]
        weights, value, slope, scale = ahead, at, slope_at, scale_at
        if rounds is None and gained < least or gained <= 0:
            return weights, bias


class _Hot:
    """Corrections for words after a hot one or at the start of a text."""

    def __init__(self, heads: Heads, cells: np.ndarray, count: np.ndarray, groups: np.ndarray):
        n_hot = heads.n_hot
        row, word = np.divmod(cells, max(n_hot, 1))
        kind = (heads.hash[word] & np.uint64(15)).astype(np.int64)
        n = np.maximum(groups.reshape(n_hot + 1, _K), 1).astype(float)
        own = np.where(count >= MIN_PAIR, count - DISCOUNT, 0.0)
        left = 1 - np.bincount(row * _K + kind, own, n.size).reshape(n.shape) / n
        self.left = np.log10(left)
        self.pair = self.left[:, (heads.hash[:n_hot] & np.uint64(15)).astype(np.int64)] if n_hot else np.zeros((1, 1))
        self.pair[row, word] = np.log10(left[row, kind] + own / n[row, kind] / heads.share[word])
        self.n_hot = n_hot

    def moved(self, t: Tokens, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.zeros(ids.size)
        at, row = _hot(ids, before, self.n_hot)
        out[at] = self.left[row, t.kind[at]]
        both = (ids[at] >= 0) & (ids[at] < self.n_hot)
        out[at[both]] = self.pair[row[both], ids[at][both]]
        return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Scores are log10 probabilities of the whole text with its end. Without `rounds` the model is trained to the end. Null and empty texts are one end token.
    Rows that repeat count as often as they stand, and each is scored. A null id is not held out. If every row
    is held out the counts are zero and all words unseen. An empty table gives no rows. Other columns are not
    read, so their names may clash with any of these.
    """
    n_parts = exchange.targets(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).withColumn("held_out", held_out(F.col("doc")))
    rows = rows.withColumn("uid", F.xxhash64("doc", "text"))
    id_kind = rows.schema["doc"].dataType.simpleString()
    heads = count_words(rows, n_parts)
    sent = rows.select("uid", "held_out", "text").mapInArrow(lambda b: _send(b, heads, n_parts), _ROWS)
    settled = saved(exchange.deal(sent, n_parts).mapInArrow(lambda b: _settle(b, heads, n_parts), _ROWS))
    tables = settled.where("kind > 0").collect()
    counts = _from_pieces([(r["part"], r["payload"]) for r in tables if r["kind"] == 1], n_parts)
    none = np.empty(0, np.int64)
    got = [(none, none), *(tuple(exchange.unpack(r["payload"], np.int64, np.int64)) for r in tables if r["kind"] == 2)]
    cells, count = (np.concatenate(c) for c in zip(*got, strict=True))
    n_pairs = (heads.n_hot + 1) * heads.n_hot
    groups = np.zeros((heads.n_hot + 1) * _K, dtype=np.int64)
    groups[cells[cells >= n_pairs] - n_pairs] = count[cells >= n_pairs]
    hot = _Hot(heads, cells[cells < n_pairs], count[cells < n_pairs], groups)
    weights, bias = train(rows, counts, n_parts, rounds)
    by_class, tame = np.append(heads.by_class, 0.0), _tame(weights, bias)

    def score(batches):
        for part, texts in wordscan.groups(batches, "text"):
            t = Tokens(texts)
            features, kind, doc = t.with_ends()
            lm = -by_class[kind]
            for at in range(0, kind.size, STEP):
                p = _forward(weights, bias, features[:, at : at + STEP], tame)
                lm[at : at + STEP] += np.log10(p[np.arange(len(p)), kind[at : at + STEP]].astype(np.float64) + 1e-30)
            ids, before = _pairs(t, heads)
            known = ids >= 0
            logs = np.zeros(ids.size)
            logs[known] = heads.log_count[ids[known]]
            n = t.n_texts
            arrays = [
                pa.array((t.counts + 1).astype(np.int64)), pa.array(np.bincount(doc, lm, n) + np.bincount(t.doc, hot.moved(t, ids, before), n)),
                pa.array(np.bincount(t.doc, logs, n).astype(float)), pa.array(np.bincount(t.doc, known, n).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("uid"), part.column("held_out"), *arrays], names=["doc", "uid", "held_out", "n_tokens", "lm", "logs", "known"])

    scored = rows.mapInArrow(score, f"doc {id_kind}, uid bigint, held_out boolean, n_tokens bigint, lm double, logs double, known bigint")
    back = settled.where("kind = 0").select("part", "payload")
    sums = exchange.deal(back, n_parts).mapInArrow(_sum_documents, "uid bigint, rare_logs double, moved double, rare_known bigint")
    words = F.col("logs") + F.col("rare_logs")
    overall, end = float(np.log10(heads.total + heads.distinct + 1)), float(np.log10(heads.n_ends + 1))
    return scored.join(sums, "uid").select(
        F.col("doc").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known") + (1 if heads.n_ends else 0)).alias("n_known"),
        F.lit(heads.total).cast("long").alias("train_tokens"),
        (words + F.lit(end) - F.col("n_tokens") * F.lit(overall)).alias("base_score"),
        (words + F.col("lm") + F.col("moved")).alias("score"),
    )
