"""Suffix-array deduplication of byte strings that repeat anywhere in a corpus.

Removes every byte that a string of `width` bytes covers which also starts anywhere else. The suffixes to
sort are all starts of such strings, but most can be settled without their text:

1. Every window of `width` bytes has an anchor: the lowest-hashed run of `seed` bytes in it, leftmost on
   ties. Equal windows have equal anchors at equal offsets, so the windows of one anchor (a *stretch*, whose
   text spans them all) can only equal windows of anchors with the same bytes.
2. Anchors travel packed to hash buckets as hashes. An anchor alone settles its windows as unique; stretches
   of equal text settle all their windows as repeated. Equal stretches that meet in a task are settled there and
   one of them travels, so a passage that a third of all rows share does not fill one bucket. What is left are stretches whose anchors agree and
   whose texts differ: edges of shared passages, and near copies.
3. Those stretches are range-partitioned by their leading bytes from the anchor on, with splitters that
   Spark samples; ties split further by place, so a very common passage spreads over tasks. Every task sorts
   the suffixes it holds by multikey quicksort (eight bytes as one key) to the depth of a window; neighbours
   that agree to that depth are repeated.
4. An anchor that stands at a partition's edge may go on in the next: windows of such anchors are compared
   across boundaries by their hashes.

Texts travel compressed. Within a bucket of step 2, 48 bits of an anchor's hash are kept; anchors that agree by
chance only lead to step 3, which compares bytes. Stretches count as equal if their anchors and the 64-bit
hashes of their whole texts agree, so a false match needs a collision among the few texts of one anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import exchange, wordscan
from .exchange import saved

WIDTH = 200
#: Bytes of an anchor; a window holds WIDTH - SEED + 1 of them.
SEED = 100
#: Leading bytes from the anchor on by which stretches are range-partitioned.
LEAD = 24

#: Anchors that a task holds before it sends them.
HELD = 600_000

UNIQUE, OPEN, REPEATED, SPOKEN = 0, 1, 2, 3  # a stretch: settled as unique, to be sorted, settled as repeated, both of the last two


class Stretches:
    """The anchors of several texts: place of the anchor, first and last window start, text number."""

    def __init__(self, texts: list[bytes], width: int, seed: int):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.width = width
        self.prefix = None
        empty = np.empty(0, np.int64)
        self.anchor = self.low = self.high = self.doc = empty
        self.hash = np.empty(0, np.uint64)
        n = self.buf.size - width + 1
        if n <= 0:
            return
        self.prefix = wordscan.Prefix(self.buf)
        h = self.prefix.fixed(seed)
        span = width - seed + 1
        key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(h.size, dtype=np.uint64)
        best = _sliding_min(key, span)[:n]
        inside = np.zeros(self.buf.size + 1, dtype=np.int8)
        wide = lengths >= width
        np.add.at(inside, self.text_start[wide], 1)
        np.add.at(inside, self.text_start[wide] + lengths[wide] - width + 1, -1)
        start = np.flatnonzero(np.cumsum(inside[:-1])[:n] > 0)
        if not start.size:
            return
        at = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(start.size, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(new)
        self.anchor, self.low = at[heads], start[heads]
        self.high = start[np.concatenate((heads[1:], [start.size])) - 1]
        self.doc = np.searchsorted(self.text_start, self.low, side="right") - 1
        self.hash = h[self.anchor]

    def content(self) -> np.ndarray:
        """Hashes of the stretches' texts."""
        return self.prefix.ranges(self.low, self.high + self.width) if self.anchor.size else np.empty(0, np.uint64)


def _sliding_min(key: np.ndarray, span: int) -> np.ndarray:
    """Minimums of all runs of `span` values, by block prefixes and suffixes."""
    n = key.size
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def multikey_sort(buf: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices into starts, class): the suffixes that agree with another to `width` bytes, by class.

    Multikey quicksort: suffixes are split by one key of eight bytes at a time, and only within a group that
    agrees so far; a suffix that is alone in its group is done. `buf` must hold eight bytes past every window.
    """
    words = np.ndarray((buf.size - 7,), dtype=">u8", buffer=buf, strides=(1,))
    active = np.arange(starts.size)
    group = np.zeros(starts.size, dtype=np.int64)
    for depth in range(0, width, 8):
        key = words[starts[active] + depth].astype(np.uint64)
        if depth + 8 > width:
            key &= np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (depth + 8 - width))) & 0xFFFFFFFFFFFFFFFF)
        order = np.lexsort((key, group))
        active, group, key = active[order], group[order], key[order]
        new = np.ones(active.size, dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        name = np.cumsum(new) - 1
        more = np.bincount(name)[name] > 1
        active, group = active[more], name[more]
        if not active.size:
            break
    return active, group


def _send_anchors(batches, n_parts: int, width: int, seed: int):
    held, owners, size = [], 0, 0
    for part, texts in wordscan.groups(batches, "text"):
        s = Stretches(texts, width, seed)
        uid = np.array(part.column("uid").to_pylist(), dtype=np.int64)
        offset = (s.low - s.text_start[s.doc]).astype(np.uint32) if s.low.size else np.empty(0, np.uint32)
        held.append((s.hash, s.content(), offset, s.doc + owners, uid))
        owners += uid.size
        size += s.hash.size
        if size >= HELD:
            yield from _packed_anchors(held, n_parts)
            held, owners, size = [], 0, 0
    if size:
        yield from _packed_anchors(held, n_parts)


def _packed_anchors(held: list[tuple], n_parts: int):
    """The anchors of some texts, one of equal stretches for their bucket, the others for that of their text."""
    seeds, content, offset, owner, uid = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((content, seeds))
    new = np.ones(order.size, dtype=bool)
    new[1:] = (seeds[order][1:] != seeds[order][:-1]) | (content[order][1:] != content[order][:-1])
    copies = np.zeros(order.size, dtype=np.uint8)  # 0: settled here as repeated; else one, or 2 for more
    heads = np.flatnonzero(new)
    copies[order[heads]] = np.minimum(np.diff(np.append(heads, order.size)), 2)
    target = np.where(copies > 0, (seeds >> np.uint64(48)) % np.uint64(n_parts), (uid[owner] % n_parts).astype(np.uint64))
    sender = exchange.Sender(n_parts)
    sender.add(target, owner, [exchange.six(seeds).view("V6"), content, offset, copies], [uid])
    if out := sender.flush():
        yield out


def _settle(batches, n_parts: int):
    """Sends each stretch that is not unique back to its document with what is known of it."""
    (uid,), per, (seed6, content, offset, met) = exchange.read_all(batches, [np.int64], ["V6", np.uint64, np.uint32, np.uint8])
    if not offset.size:
        return
    seeds = exchange.from_six(np.frombuffer(seed6.tobytes(), np.uint8))
    owner = np.repeat(np.arange(uid.size), per)
    done = np.flatnonzero(met == 0)
    order = np.flatnonzero(met)
    order = order[np.lexsort((content[order], seeds[order]))]
    s, c = seeds[order], content[order]
    new_seed = np.ones(s.size, dtype=bool)
    new_seed[1:] = s[1:] != s[:-1]
    new_text = new_seed.copy()
    new_text[1:] |= c[1:] != c[:-1]
    seed_of, text_of = np.cumsum(new_seed) - 1, np.cumsum(new_text) - 1
    copies = np.bincount(text_of, met[order])[text_of]
    texts = np.bincount(seed_of, weights=new_text)[seed_of]
    # One of several equal stretches speaks for them where their anchor has other texts too.
    state = np.where(copies > 1, np.where((texts > 1) & new_text, SPOKEN, REPEATED), np.where(texts > 1, OPEN, UNIQUE))
    use = state != UNIQUE
    order, state = np.concatenate((order[use], done)), np.concatenate((state[use], np.full(done.size, REPEATED))).astype(np.uint8)
    back = np.argsort(owner[order], kind="stable")
    order, state = order[back], state[back]
    sender = exchange.Sender(n_parts)
    sender.add(uid[owner[order]] % n_parts, owner[order], [offset[order], state], [uid])
    if out := sender.flush():
        yield out


def _split(batches) -> tuple[list[tuple[int, int, bytes]], list[bytes], list[bytes], list[pa.Array]]:
    """The texts (uid, place, bytes) and payloads (settled, sorted) that met in a partition, and the rows' names."""
    texts, settled, sorted_, names, at = [], [], [], [], 0
    for batch in batches:
        if "doc" in batch.schema.names:
            names.append(batch.column("doc"))
        for kind, uid, body in zip(*(batch.column(c).to_pylist() for c in ("kind", "uid", "payload")), strict=True):
            if kind == 0:
                texts.append((uid, at, body))
            else:
                (settled if kind == 1 else sorted_).append(body)
            at += 1
    return texts, settled, sorted_, names


def _by_uid(payloads: list[bytes], *kinds) -> dict[int, list[np.ndarray]]:
    """Entry columns of each uid, over all payloads."""
    got = [exchange.unpack(p, np.int64, np.uint32, *kinds) for p in payloads]
    if not got:
        return {}
    uid, per, *entries = (np.concatenate(c) for c in zip(*got, strict=True))
    owner = np.repeat(uid, per)
    order = np.argsort(owner, kind="stable")
    owner, entries = owner[order], [e[order] for e in entries]
    names, begin = np.unique(owner, return_index=True)
    ends = np.append(begin[1:], owner.size)
    return {int(u): [e[a:b] for e in entries] for u, a, b in zip(names.tolist(), begin.tolist(), ends.tolist(), strict=True)}


def _text_chunks(texts: list[tuple[int, int, bytes]], wanted: dict):
    """(rows, plain texts) in chunks, for the uids that are wanted."""
    unpack = zstandard.ZstdDecompressor()
    rows, plain, size = [], [], 0
    for row in texts:
        if row[0] in wanted:
            rows.append(row)
            plain.append(unpack.decompress(row[2]))
            size += len(plain[-1])
            if size >= wordscan.CHUNK_BYTES:
                yield rows, plain
                rows, plain, size = [], [], 0
    if rows:
        yield rows, plain


def _state_of(s: Stretches, rows, settled: dict) -> np.ndarray:
    """The state of each stretch of a chunk."""
    state = np.zeros(s.low.size, dtype=np.uint8)
    offset = s.low - s.text_start[s.doc]
    first = np.searchsorted(s.doc, np.arange(len(rows) + 1))
    for i, row in enumerate(rows):
        known, states = settled[row[0]][:2]
        a, b = first[i], first[i + 1]
        # Rows that repeat share a uid: of their states for a stretch, that of the speaker holds.
        np.maximum.at(state, a + np.searchsorted(offset[a:b], known), states)
    return state


def _open_stretches(batches, width: int, seed: int):
    """Rows (lead, uid, low, shift, body) of the stretches to sort."""
    texts, settled_, *_ = _split(batches)
    settled = _by_uid(settled_, np.uint32, np.uint8)
    # Rows that repeat met here; one of them speaks for all.
    for rows, plain in _text_chunks(list({row[0]: row for row in texts}.values()), settled):
        s = Stretches(plain, width, seed)
        state = _state_of(s, rows, settled)
        pick = np.flatnonzero((state == OPEN) | (state == SPOKEN))
        raw = s.buf.tobytes()
        cols: tuple[list, ...] = ([], [], [], [], [])
        for i in pick.tolist():
            lo, anchor = int(s.low[i]), int(s.anchor[i])
            values = (raw[anchor : anchor + LEAD], rows[s.doc[i]][0], lo - int(s.text_start[s.doc[i]]), anchor - lo, raw[lo : int(s.high[i]) + width])
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        if cols[0]:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lead", "uid", "low", "shift", "body"])


def _sort_bucket(batches, n_parts: int, width: int):
    """Sorts a partition's suffixes; gives repeated windows and the hashes of those at its edges."""
    lead, uid, low, body = [], [], [], []
    for batch in batches:
        for out, name in ((lead, "lead"), (uid, "uid"), (low, "low"), (body, "body")):
            out += batch.column(name).to_pylist()
    if not body:
        return
    size = np.array([len(b) for b in body], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    buf = np.frombuffer(b"".join(body) + bytes(8), dtype=np.uint8)
    count = size - width + 1
    owner = np.repeat(np.arange(size.size), count)
    step = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
    starts = begin[owner] + step
    uids = np.array(uid, dtype=np.int64)
    window = np.array(low, dtype=np.int64)[owner] + step
    found, _ = multikey_sort(buf, starts, width)
    sender = exchange.Sender(n_parts)
    found.sort()
    sender.add(uids[owner[found]] % n_parts, owner[found], [window[found].astype(np.uint32)], [uids])
    if out := sender.flush():
        yield _kinded(out, 2)
    ends = {min(lead), max(lead)}
    edge = np.array([x in ends for x in lead])
    pick = np.flatnonzero(edge[owner])
    h = wordscan.Prefix(buf).ranges(starts[pick], starts[pick] + width)
    sender = exchange.Sender(n_parts)
    sender.add((h >> np.uint64(40)) % np.uint64(n_parts), owner[pick], [h, window[pick].astype(np.uint32)], [uids])
    if out := sender.flush():
        yield _kinded(out, 3)


def _across(batches, n_parts: int):
    """Windows at partition edges that another partition (or the same) holds too."""
    (uid,), per, (h, window) = exchange.read_all(batches, [np.int64], [np.uint64, np.uint32])
    if not h.size:
        return
    owner = np.repeat(np.arange(uid.size), per)
    _, name, count = np.unique(h, return_inverse=True, return_counts=True)
    use = np.flatnonzero(count[name] > 1)
    use = use[np.argsort(owner[use], kind="stable")]
    sender = exchange.Sender(n_parts)
    sender.add(uid[owner[use]] % n_parts, owner[use], [window[use]], [uid])
    if out := sender.flush():
        yield _kinded(out, 2)


_KIND = "kind int, part int, payload binary"


def _kinded(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * batch.num_rows, pa.int32()), batch.column("part"), batch.column("payload")], names=["kind", "part", "payload"])


def _compressed(rows: DataFrame, n_parts: int, named: bool) -> DataFrame:
    """(kind, part, uid, [doc,] payload): the texts, each for the bucket of its uid; `doc` in its own type."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for part, texts in wordscan.groups(batches, "text", 4 * wordscan.CHUNK_BYTES):
            uid = part.column("uid").to_pylist()
            doc = [part.column("doc")] if named else []
            arrays = [pa.array([0] * len(uid), pa.int32()), pa.array([u % n_parts for u in uid], pa.int32()), part.column("uid"), *doc, pa.array([pack.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    doc_field = [T.StructField("doc", rows.schema["doc"].dataType)] if named else []
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("uid", T.LongType()), *doc_field, T.StructField("payload", T.BinaryType())]
    schema = T.StructType(fields)
    return rows.select("uid", *(["doc"] if named else []), "text").mapInArrow(run, schema)


def _covered(texts: list[bytes], rows, settled: dict, sorted_: dict, width: int, seed: int) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each text."""
    s = Stretches(texts, width, seed)
    full = s.low[:0]
    offset = s.low - s.text_start[s.doc] if s.low.size else full
    first = np.searchsorted(s.doc, np.arange(len(rows) + 1))
    out = []
    for i, row in enumerate(rows):
        n = len(texts[i])
        edge = np.zeros(n + 1, dtype=np.int64)
        if row[0] in settled:
            known, states = settled[row[0]][:2]
            a, b = first[i], first[i + 1]
            at = a + np.searchsorted(offset[a:b], known)
            done = at[states >= REPEATED]
            base = int(s.text_start[i])
            np.add.at(edge, s.low[done] - base, 1)
            np.add.at(edge, s.high[done] - base + width, -1)
        if row[0] in sorted_:
            window = np.unique(sorted_[row[0]][0]).astype(np.int64)
            np.add.at(edge, window, 1)
            np.add.at(edge, window + width, -1)
        gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
        turn = np.flatnonzero(gone[1:] != gone[:-1])
        out.append(list(zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True)))
    return out


def find_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc, n_bytes, spans, kept): a row for each row of `docs(doc, text)`; `doc` names the row, in any type.

    `spans` are the removed byte runs [start, end) in order, `kept` the bytes that stay. Null and empty
    texts, and those shorter than `width`, keep all they have. Rows that repeat each lose what they share.
    """
    spark = docs.sparkSession
    n_parts = exchange.targets(spark)
    rows = docs.select("doc", "text").withColumn("uid", F.xxhash64(exchange.hashable(docs, "doc"), "text"))
    anchors = rows.select("uid", "text").mapInArrow(lambda b: _send_anchors(b, n_parts, width, seed), exchange.SCHEMA)
    settled = saved(exchange.deal(anchors, n_parts).mapInArrow(lambda b: _settle(b, n_parts), exchange.SCHEMA))
    settled = settled.withColumn("kind", F.lit(1))
    met = exchange.deal(_compressed(rows, n_parts, False).unionByName(settled, allowMissingColumns=True), n_parts)
    stretches = saved(met.mapInArrow(lambda b: _open_stretches(b, width, seed), "lead binary, uid bigint, low bigint, shift int, body binary"))
    ranged = stretches.repartitionByRange(n_parts, "lead", "uid", "low")
    sorted_ = saved(ranged.mapInArrow(lambda b: _sort_bucket(b, n_parts, width), _KIND))
    edges = sorted_.where("kind = 3").select("part", "payload")
    across = exchange.deal(edges, n_parts).mapInArrow(lambda b: _across(b, n_parts), _KIND)
    known = settled.unionByName(sorted_.where("kind = 2")).unionByName(across)
    out = T.StructType([rows.schema["doc"]]).add("n_bytes", T.LongType()).add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))).add("kept", T.BinaryType())

    def finish(batches):
        texts_, settled_p, sorted_p, names = _split(batches)
        named = pa.concat_arrays(names) if names else None
        settled_, sorted__ = _by_uid(settled_p, np.uint32, np.uint8), _by_uid(sorted_p, np.uint32)
        everything = {row[0] for row in texts_}
        for rows_, plain in _text_chunks(texts_, everything):
            spans = _covered(plain, rows_, settled_, sorted__, width, seed)
            kept = []
            for t, runs in zip(plain, spans, strict=True):
                at, parts = 0, []
                for a, b in runs:
                    parts.append(t[at:a])
                    at = b
                kept.append(b"".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays(
                [
                    named.take(pa.array([r[1] for r in rows_], pa.int64())),
                    pa.array([len(t) for t in plain], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc", "n_bytes", "spans", "kept"],
            )

    final = exchange.deal(_compressed(rows, n_parts, True).unionByName(known, allowMissingColumns=True), n_parts)
    return final.mapInArrow(finish, out)


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """`docs` with the repeated bytes taken out of the text, other columns as they were, in the same order.

    What is left of a character that a cut went through is dropped. `size_col`, if there, is counted again;
    null texts become ''. The other columns travel beside the text as one struct in their own types, whatever
    their names, so no join brings them back. Each row is judged by itself: null and repeated ids and rows that
    repeat all stay, and each loses what it shares. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in (text_col, size_col)]
    columns_of = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(0).alias("_"))
    rows = docs.select(columns_of.alias("doc"), docs[text_col].alias("text"))
    found = find_repeats(rows, width, seed).select(F.col("doc").alias("row"), "kept")
    # decode() would put replacement characters where a cut went through one.
    clean = found.select("row", F.try_validate_utf8(F.col("kept").cast("string")).alias("whole"), F.make_valid_utf8(F.col("kept").cast("string")).alias("marked"))
    text = F.coalesce("whole", F.replace("marked", F.lit("\ufffd"), F.lit("")))
    full = clean.select("row", text.alias(text_col))
    columns = {c: F.col("row").getField(c).alias(c) for c in others} | {text_col: F.col(text_col)}
    if size_col in docs.columns:
        columns[size_col] = F.length(text_col).cast(docs.schema[size_col].dataType).alias(size_col)
    return full.select(*(columns[c] for c in docs.columns))


def digest(docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    Null and empty texts have no bytes; null ids, repeated ids and repeated rows each give a row. An empty table
    gives no rows. Other columns are not read, so their names may clash with any of these.
    """
    found = find_repeats(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")), width, seed)
    return found.select(
        F.col("doc").alias(id_col),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
