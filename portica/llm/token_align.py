"""Cross-tokenizer alignment with exact-text deduplication.

A byte-level BPE (A) encodes a space and the text, a piece BPE with byte fallback (B) encodes the text, to which
it adds the space itself. Where tokens of both end at the same byte, the text is cut; the tokens between two
cuts are a group, and every A token of a group is linked with every B token of it.

1. Rows are shuffled by their full text, so that each distinct text is tokenised and aligned once; it keeps the
   number of its rows.
2. The distinct texts of a task go on as chunks of bounded size: measures, and for each text its distinct
   linked id pairs with their occurrences.
3. A pair's count is the number of rows that hold it: chunks send each of their pairs once, weighted by rows,
   and sums and the best count of each A id are aggregates. Chunks get back the counts of the pairs they have.
4. Measures of a distinct text are joined to the rows by the SHA-256 of the text, so a text that a third of all
   rows have is a large key on one side of a join only.

Long texts are encoded in parts, cut before a single space between two characters that are none: no token of
either vocabulary reaches over such a place.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import wordscan
from .exchange import pack, saved, unpack

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a chunk, about: what is looked up together and held by one task.
CHUNK_BYTES = 16 << 20
#: Characters in a part of a long text, about.
PART = 1 << 16
#: Groups with more links than this are counted by distinct ids.
LARGE_GROUP = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")
_KINDS = (np.uint8, np.int64, np.int64, np.int64, np.int64, np.int64, np.uint8, np.uint32, np.uint32, np.int64)
_loaded: dict[str, Tokenizers] = {}


class Tokenizers:
    """Both tokenizers of a folder, with the bytes of each id."""

    def __init__(self, folder: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{FILE_A}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(plain)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}
        self.bytes_a = [bytes(byte_of[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.in_parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.n_b = len(self.bytes_b)
        if len(self.bytes_a) * self.n_b >= 1 << 32:
            raise ValueError("pairs of ids need more than 32 bits")
        digits = [[str(i).encode() for i in range(n)] for n in (len(self.bytes_a), self.n_b)]
        self.more_a, self.more_b = (np.array([x + b"," for x in d], dtype=object) for d in digits)
        self.end_a, self.end_b = (np.array([x + end for x in d], dtype=object) for d, end in zip(digits, (b"|", b";"), strict=True))

    def parts(self, text: str) -> list[str]:
        if len(text) <= PART or not self.in_parts:
            return [text]
        out, begin = [], 0
        while len(text) - begin > PART and (cut := _CUT.search(text, begin + PART)):
            out.append(text[begin : cut.start()])
            begin = cut.end()
        return [*out, text[begin:]]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B by text."""
        parts = [self.parts(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in flat], add_special_tokens=False)]
        b = self.b.encode(flat, num_threads=1)
        if len(flat) == len(texts):
            return a, b
        at, out_a, out_b = 0, [], []
        for ps in parts:
            out_a.append([i for x in a[at : at + len(ps)] for i in x])
            out_b.append([i for x in b[at : at + len(ps)] for i in x])
            at += len(ps)
        return out_a, out_b


def load(folder: str) -> Tokenizers:
    """The tokenizers of a folder, once for each Python worker."""
    if folder not in _loaded:
        _loaded[folder] = Tokenizers(folder)
    return _loaded[folder]


def _ends(ids: list[list[int]], length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text number, end byte over all texts) of the tokens of several texts."""
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=sum(map(len, ids)))
    return flat, np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.cumsum(length[flat])


def _links(ids_a: np.ndarray, ids_b: np.ndarray, text_a: np.ndarray, group_a: np.ndarray, n_in_a: np.ndarray, n_in_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, occurrences) of the linked id pairs, distinct and sorted by text, then pair."""
    first_a, first_b = np.cumsum(n_in_a) - n_in_a, np.cumsum(n_in_b) - n_in_b
    large = n_in_a * n_in_b > LARGE_GROUP
    times = np.where(large, 0, n_in_b)[group_a]
    left = np.repeat(np.arange(ids_a.size), times)
    right = np.arange(left.size) - np.repeat(np.cumsum(times) - times, times) + first_b[group_a[left]]
    keys, weights = [(text_a[left] << 32) | (ids_a[left] * n_b + ids_b[right])], [np.ones(left.size, dtype=np.int64)]
    for g in np.flatnonzero(large).tolist():
        a, times_a = np.unique(ids_a[first_a[g] : first_a[g] + n_in_a[g]], return_counts=True)
        b, times_b = np.unique(ids_b[first_b[g] : first_b[g] + n_in_b[g]], return_counts=True)
        keys.append((text_a[first_a[g]] << 32) | (a[:, None] * n_b + b[None, :]).reshape(-1))
        weights.append(np.outer(times_a, times_b).reshape(-1))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    key, weight = key[heads], np.add.reduceat(weight, heads) if key.size else weight
    return key >> 32, key & 0xFFFFFFFF, weight


def align(both: Tokenizers, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Aligns texts of UTF-8 bytes.

    Gives a table (n_a, n_b, n_groups, n_links by text), the SHA-256 of each text's groups, and the rows (text
    number, pair, occurrences) of its links. A text that is empty, no UTF-8 or not spelt by its tokens has
    zeros, a digest of zero bytes and no links.
    """
    table, digests = np.zeros((len(texts), 4), dtype=np.int64), np.zeros((len(texts), 32), dtype=np.uint8)
    decoded, which = [], []
    for i, raw in enumerate(texts):
        try:
            if raw:
                decoded.append(raw.decode())
                which.append(i)
        except UnicodeDecodeError:
            pass
    a, b = both.encode(decoded)
    spelt = [
        b"".join(map(both.bytes_a.__getitem__, x)) == b" " + texts[i] and b"".join(map(both.bytes_b.__getitem__, y)) == b" " + texts[i]
        for i, x, y in zip(which, a, b, strict=True)
    ]
    a, b, which = ([x for x, ok in zip(c, spelt, strict=True) if ok] for c in (a, b, which))
    if not which:
        none = np.empty(0, np.int64)
        return table, digests, np.stack([none, none, none])
    ids_a, text_a, end_a = _ends(a, both.length_a)
    ids_b, text_b, end_b = _ends(b, both.length_b)
    cuts = end_a[np.isin(end_a, end_b, assume_unique=True)]
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    n_in_a, n_in_b = np.bincount(group_a, minlength=cuts.size), np.bincount(group_b, minlength=cuts.size)
    text_of = text_a[np.cumsum(n_in_a) - 1]  # a text ends with a cut, so no group has tokens of two
    n = len(which)
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, text_of, n_in_a * n_in_b)
    place = np.array(which)
    table[place] = np.stack([np.bincount(text_a, minlength=n), np.bincount(text_b, minlength=n), np.bincount(text_of, minlength=n), links], axis=1)
    # Decimal ids in the order of groups, A before B, each with what follows it.
    last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
    words = np.empty(ids_a.size + ids_b.size, dtype=object)
    words[np.arange(ids_a.size) + (np.cumsum(n_in_b) - n_in_b)[group_a]] = np.where(last_a, both.end_a[ids_a], both.more_a[ids_a])
    words[np.arange(ids_b.size) + np.cumsum(n_in_a)[group_b]] = np.where(last_b, both.end_b[ids_b], both.more_b[ids_b])
    begin = 0
    for i, count in zip(which, (table[place, 0] + table[place, 1]).tolist(), strict=True):
        digests[i] = np.frombuffer(hashlib.sha256(b"".join(words[begin : begin + count].tolist())[:-1]).digest(), np.uint8)
        begin += count
    text, pair, times = _links(ids_a, ids_b, text_a, group_a, n_in_a, n_in_b, both.n_b)
    return table, digests, np.stack([place[text], pair, times])


def _chunks(distinct: DataFrame, folder: str) -> DataFrame:
    """(chunk, size, payload) of `distinct(text, copies)`; a payload has measures and links of many texts, compressed."""

    def run(batches):
        both, parts, held, number = load(folder), [], 0, TaskContext.get().partitionId() << 32

        def row():
            columns = [np.concatenate([np.asarray(c).reshape(-1) for c in cols]).astype(kind) for cols, kind in zip(zip(*parts, strict=True), _KINDS, strict=True)]
            raw = pack(*columns)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(raw)]), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], names=["chunk", "size", "payload"])

        for part, texts in wordscan.groups(batches, "text"):
            table, digests, links = align(both, texts)
            keys = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), np.uint8)
            parts.append([keys, part.column("copies").to_numpy(zero_copy_only=False), *table.T, digests, np.bincount(links[0], minlength=len(texts)), links[1], links[2]])
            held += sum(map(len, texts))
            if held >= CHUNK_BYTES:
                yield row()
                parts, held, number = [], 0, number + 1
        if parts:
            yield row()

    return distinct.mapInArrow(run, "chunk bigint, size bigint, payload binary")


def _open(payload: bytes, size: int) -> list[np.ndarray]:
    return unpack(pa.decompress(payload, size, "zstd", asbytes=True), *_KINDS)


def _asked(chunks: DataFrame) -> DataFrame:
    """(chunk, pair, n): each pair of a chunk once, with the number of rows that hold it."""

    def run(batches):
        for batch in batches:
            for chunk, size, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "size", "payload")), strict=True):
                _, copies, _, _, _, _, _, per, pair, _ = _open(payload, size)
                order = np.argsort(pair, kind="stable")
                pairs, rows = pair[order].astype(np.int64), np.repeat(copies, per)[order]
                heads = np.flatnonzero(np.diff(pairs, prepend=-1))
                n = np.add.reduceat(rows, heads) if heads.size else rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(heads.size, chunk)), pa.array(pairs[heads]), pa.array(n)], names=["chunk", "pair", "n"])

    return chunks.mapInArrow(run, "chunk bigint, pair bigint, n bigint")


_MEASURES = pa.schema([("key", pa.binary()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _answer(chunk: pa.Table, replies: pa.Table) -> pa.Table:
    """Measures of the texts of one chunk, given the counts of its pairs."""
    if not chunk.num_rows:
        return _MEASURES.empty_table()
    keys, _, n_a, n_b, n_groups, n_links, digests, per, pair, times = _open(chunk.column("payload")[0].as_py(), chunk.column("size")[0].as_py())
    known, n, top = (replies.column(c).to_numpy() for c in ("pair", "n", "top"))
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], pair)]
    ends = np.cumsum(per.astype(np.int64))
    sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))]) for x in (times * top[at], times * n[at])]
    shas = ["" if not count else x.tobytes().hex() for count, x in zip(n_a.tolist(), digests.reshape(-1, 32), strict=True)]
    raw = keys.tobytes()
    return pa.table([pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), *map(pa.array, (n_a, n_b, n_groups, n_links, *sums)), pa.array(shas, pa.string())], schema=_MEASURES)


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    `folder` holds the tokenizers' files, on every machine. n_best counts links whose pair has the highest count
    of its A id, ties included; count_sum adds the counts of all links; groups_sha256 digests
    `a1,a2|b1;a3|b2,b3`. Null and empty texts, and those that the tokens of A or B do not spell (white space that
    B rewrites, bytes that are no UTF-8), have zeros and '' and hold no pair. Rows are judged by their text
    alone: null and repeated ids stay, repeated rows all count. Other columns are not read.
    """
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    chunks = saved(_chunks(rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")), folder))
    asked = _asked(chunks)
    totals = saved(asked.groupBy("pair").agg(F.sum("n").alias("n")))
    by_a = totals.withColumn("a", F.floor(F.col("pair") / F.lit(load(folder).n_b)))
    best = by_a.groupBy("a").agg(F.max("n").alias("best"))
    counts = by_a.join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).cast("bigint").alias("top"))
    replies = asked.select("chunk", "pair").join(counts, "pair")
    schema = "key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    measured = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_answer, schema)
    keyed = rows.select(id_col, F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("key"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return keyed.join(measured, "key", "left").select(id_col, *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
