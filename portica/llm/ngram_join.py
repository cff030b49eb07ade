"""N-gram Jaccard join: T-occurrence search over inverted lists.

A document is the set of its distinct word shingles; two documents link when their sets overlap enough. A
document with n shingles needs an overlap of at least T = ceil(t * n) with any partner, so

1. shingles travel packed to hash buckets, where their document frequencies are counted over the corpus;
   only shingles of two or more different sets can add to an overlap, and a set with fewer than T of them
   has no partner. Shingles that tasks find in a good part of their sets are known to be shared and are put last
   in the order of frequencies, without being counted, so that no bucket holds one of them for every set;
2. sets that are left meet in runs that share a sampled shingle. A run is cut into blocks; in a block the
   lists of a query set are searched with DivideSkip: the short lists are merged in order and runs of one
   document counted, documents that
   reach T less the number of long lists are looked up in the long ones by binary search;
3. links join sets into components. Sets in the same component need no further search, so what is left are
   pairs of different components that share one of the T-th rarest shingles (the prefix), which every linked
   pair does. Those are searched the same way, the candidates of a query set forming its lists.

Sets that are equal are one class from the start, and a large class or a large run of near copies costs
its size, not its square. Shingles are 64-bit hashes; within a bucket 48 bits are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import exchange, wordscan
from .exchange import saved
from .graph import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Sets in a block of step 2; a block's lists are held by one task.
BLOCK = 256
#: Bytes of sets in a block of steps 2 and 3, if there are two or more sets in it.
BLOCK_BYTES = 8 << 20
#: In step 2 sets of LONG bytes and more meet by themselves, in classes of doubling length and tasks of about
#: BLOCK_BYTES, as ranges of rows would put many long sets into one task. Links across classes are left to step 3.
LONG = 1 << 16
#: Hashes of step 2 by which sets meet; more leave fewer queries to step 3.
SAMPLES = 2
#: Query sets and indexed sets, about, that meet in a unit of step 3.
UNIT = 64
#: A shingle is common if the chunks of text that have it in CHUNK_SHARE of their sets hold COMMON of all sets.
CHUNK_SHARE, COMMON = 0.02, 0.005
_LAST = np.uint32(0xFFFFFFFF)
#: DivideSkip's weight of list lengths in the choice of long lists.
MU = 0.02


def shingle_sets(w: wordscan.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number), distinct and sorted by text then hash; a shorter text is one shingle."""
    h, doc = w.shingles(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if short.size:
        extra = np.array([xxhash.xxh3_64_intdigest(w.hash[w.first[i] : w.first[i + 1]].tobytes(), seed=k) for i in short.tolist()], dtype=np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(h.size, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _signatures(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set size) by text; an empty set has signature 0."""
    size = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(size)))
    raw = h.tobytes()
    sig = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) >> 1 if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return np.array(sig, dtype=np.int64), size


def need(n: np.ndarray) -> np.ndarray:
    """The overlap that a set of n shingles needs with any partner."""
    return -((-NUMERATOR * n) // DENOMINATOR)


class Lists:
    """The inverted lists of some sets, and DivideSkip over them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        token = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(self.n), [s.size for s in sets])
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.tokens, self.begin, self.length = np.unique(token[order], return_index=True, return_counts=True)
        rank = np.repeat(np.arange(self.tokens.size), self.length)
        self.place = rank * max(self.n, 1) + self.owner  # rising: the lists one after another

    def search(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlap) of the sets that share at least `least` tokens with the query."""
        at = np.searchsorted(self.tokens, query)
        query, at = query[at < self.tokens.size], at[at < self.tokens.size]
        at = at[self.tokens[at] == query]
        at = at[np.argsort(self.length[at], kind="stable")]
        longest = int(self.length[at[-1]]) if at.size else 0
        n_long = min(int(least / (MU * np.log2(longest + 1) + 1)), max(least - 1, 0), at.size) if longest > 8 else 0
        short, long_ = at[: at.size - n_long], at[at.size - n_long :]
        some, seen = self._merge(short)
        enough = seen >= max(least - n_long, 1)
        some, seen = some[enough], seen[enough]
        if n_long and some.size:
            probe = (long_[:, None] * self.n + some[None, :]).reshape(-1)
            hit = np.searchsorted(self.place, probe)
            found = self.place[np.minimum(hit, self.place.size - 1)] == probe
            seen = seen + found.reshape(n_long, -1).sum(axis=0)
        return some[seen >= least], seen[seen >= least]

    def _merge(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sets, number of lists that hold each) of some lists.

        The lists are rising runs, which a stable sort merges as runs; it stands for the heap.
        """
        runs = [self.owner[b : b + c] for b, c in zip(self.begin[lists].tolist(), self.length[lists].tolist(), strict=True)]
        if not runs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        merged = np.concatenate(runs)
        merged.sort(kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        return merged[heads], np.diff(np.append(heads, merged.size))


def _linked(na: int, nb, overlap):
    return DENOMINATOR * overlap >= NUMERATOR * (na + nb - overlap)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """(doc, sig, n, common): a row for each row of docs, and rows (common, n) for shingles that chunks have often."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        often: dict[int, int] = {}
        for part, texts in wordscan.groups(batches, "text"):
            h, doc = shingle_sets(wordscan.Words(texts), k)
            sig, size = _signatures(h, doc, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sig), pa.array(size.astype(np.int64)), pa.nulls(len(texts), pa.int64())], names=["doc", "sig", "n", "common"])
            fresh = np.zeros(len(texts), dtype=bool)
            fresh[np.unique(sig, return_index=True)[1]] = True
            token, seen = np.unique(h[fresh[doc]], return_counts=True)
            some = seen >= max(CHUNK_SHARE * fresh.sum(), 2)
            for t, c in zip(token[some].tolist(), seen[some].tolist(), strict=True):
                often[t] = often.get(t, 0) + c
        if often:
            tokens = np.array(list(often), dtype=np.uint64).view(np.int64)
            none = pa.nulls(tokens.size, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(tokens.size, part.column("doc").type), none, pa.array(list(often.values()), pa.int64()), pa.array(tokens)], names=["doc", "sig", "n", "common"])

    return docs.mapInArrow(run, f"doc {kind}, sig bigint, n bigint, common bigint")


def _common_shingles(profile: DataFrame) -> np.ndarray:
    """Hashes of shingles that at least COMMON of the rows hold; their number is bounded by the mean set size / COMMON."""
    rows = profile.where("common IS NULL").count()
    often = profile.where("common IS NOT NULL").groupBy("common").agg(F.sum("n").alias("n")).where(F.col("n") >= max(COMMON * rows, 64))
    return np.sort(np.array([r["common"] for r in often.collect()], dtype=np.int64).view(np.uint64))


def _survivors(docs: DataFrame, k: int, common: np.ndarray) -> DataFrame:
    """(sig, n, shared, prefix): the sets that can have a partner, once each; arrays of token ids.

    `shared` holds all tokens of other sets too (sorted), `prefix` the rarest that any partner must meet. Tokens
    of `common` are known to be shared and count as the most frequent.
    """
    n_parts = exchange.targets(docs.sparkSession)

    def is_common(h: np.ndarray) -> np.ndarray:
        return common[np.minimum(np.searchsorted(common, h), common.size - 1)] == h if common.size else np.zeros(h.size, bool)

    def send(batches):
        sender, sent = exchange.Sender(n_parts), set()
        for _, texts in wordscan.groups(batches, "text"):
            h, doc = shingle_sets(wordscan.Words(texts), k)
            sig, size = _signatures(h, doc, len(texts))
            fresh = np.zeros(len(texts), dtype=bool)
            for i, s in enumerate(sig.tolist()):
                if s and s not in sent:
                    sent.add(s)
                    fresh[i] = True
            use = fresh[doc]
            h, doc = h[use], doc[use]
            # Entries of an owner must stand together in each payload; texts are in order already.
            six = exchange.six(h).reshape(-1, 6)
            often = is_common(h)
            target = np.where(often, (sig[doc] % n_parts).astype(np.uint64), (h >> np.uint64(48)) % np.uint64(n_parts))
            sender.add(target, doc, [six.view("V6").reshape(-1), often.astype(np.uint8)], [sig, size.astype(np.uint32)])
            if sender.full() and (out := sender.flush()):
                yield out
                if len(sent) > 2_000_000:  # forgetting only sends a set twice
                    sent.clear()
        if out := sender.flush():
            yield out

    def count(batches):
        (sig, size), per, (token, often) = exchange.read_all(batches, [np.int64, np.uint32], ["V6", np.uint8])
        if not sig.size:
            return
        # Back to more than 48 bits: the bucket is known here and is part of the token, that of a common one is its own.
        often = often == 1
        token = exchange.from_six(np.frombuffer(token.tobytes(), np.uint8))
        token |= np.where(often, np.uint64(0xFFFF << 48), np.uint64(TaskContext.get().partitionId() % 65535 << 48))
        owner = np.repeat(np.arange(sig.size), per)
        order = np.lexsort((sig[owner], token))
        token, owner = token[order], owner[order]
        again = np.zeros(token.size, dtype=bool)  # the same set, sent by two tasks
        again[1:] = (token[1:] == token[:-1]) & (sig[owner[1:]] == sig[owner[:-1]])
        token, owner = token[~again], owner[~again]
        _, group, df = np.unique(token, return_inverse=True, return_counts=True)
        df = np.where(token >= np.uint64(0xFFFF << 48), _LAST, df[group].astype(np.uint32))
        use = df > 1
        token, owner, df = token[use], owner[use], df[use]
        order = np.argsort(owner, kind="stable")
        token, owner, df = token[order], owner[order], df[order]
        sender = exchange.Sender(n_parts)
        sender.add(sig[owner] % n_parts, owner, [token, df.astype(np.uint32)], [sig, size])
        if out := sender.flush():
            yield out

    def gather(batches):
        (sig, size), per, (token, df) = exchange.read_all(batches, [np.int64, np.uint32], [np.uint64, np.uint32])
        if not sig.size:
            return
        owner_sig = np.repeat(sig, per)
        order = np.lexsort((token, df, owner_sig))
        owner_sig, token = owner_sig[order], token[order]
        sizes = dict(zip(sig.tolist(), size.tolist(), strict=True))
        heads = np.concatenate(([0], np.flatnonzero(np.diff(owner_sig)) + 1, [owner_sig.size]))
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            s = int(owner_sig[a])
            n = sizes[s]
            t = int(need(np.int64(n)))
            if b - a < t:
                continue
            ids = token[a:b].astype(np.int64)
            for column, value in zip(rows, (s, n, np.sort(ids), ids[: b - a - t + 1]), strict=True):
                column.append(value)
        for at in range(0, len(rows[0]), 2000):
            s, n, shared, prefix = (c[at : at + 2000] for c in rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in shared], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["sig", "n", "shared", "prefix"],
            )

    counted = exchange.deal(docs.select("text").mapInArrow(send, exchange.SCHEMA), n_parts).mapInArrow(count, exchange.SCHEMA)
    return saved(exchange.deal(counted, n_parts).mapInArrow(gather, "sig bigint, n bigint, shared binary, prefix array<bigint>"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _block_links(sigs: list[int], sizes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all linked sets of one block, as (set, root of its tree)."""
    forest, lists = _Forest(len(sigs)), None
    for i in range(1, len(sigs)):
        # A neighbour that links settles the set with one intersection.
        if _linked(sizes[i], sizes[i - 1], _common(sets[i], sets[i - 1])):
            forest.up[forest.root(i)] = forest.root(i - 1)
    if len({forest.root(i) for i in range(len(sigs))}) > 1:
        lists = Lists(sets)
        for i in range(len(sigs)):
            others, overlap = lists.search(sets[i], int(need(np.int64(sizes[i]))))
            for j, c in zip(others.tolist(), overlap.tolist(), strict=True):
                if forest.root(i) != forest.root(j) and _linked(sizes[i], sizes[j], c):
                    forest.up[forest.root(i)] = forest.root(j)
    return [(sigs[i], sigs[forest.root(i)]) for i in range(len(sigs)) if forest.root(i) != i]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _sampled_links(sets: DataFrame) -> DataFrame:
    """Edges between sets that share the smallest token under one of SAMPLES hashes."""
    n_parts, most = exchange.targets(sets.sparkSession), BLOCK_BYTES

    def keyed(batches):
        for batch in batches:
            keys = []
            for raw in batch.column("shared").to_pylist():
                ids = np.frombuffer(raw, np.uint64)
                keys.append([int(ids[np.argmin(wordscan.mix(ids + np.uint64(k * 0x9E3779B9)))] >> np.uint64(1)) for k in range(SAMPLES)])
            for k in range(SAMPLES):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in keys], pa.int64()), *(batch.column(c) for c in ("n", "sig", "shared"))], names=["key", "n", "sig", "shared"])

    def link(batches):
        key, held, held_bytes = None, ([], [], []), 0
        for batch in batches:
            for k, n, s, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "sig", "shared")), strict=True):
                full = len(held[0]) == BLOCK or (len(held[0]) > 1 and held_bytes + len(raw) > most)
                if k != key or full:
                    if len(held[0]) > 1 and (found := _block_links(*held)):
                        yield _edges(found)
                    # The last set of a full block starts the next one, so a long run stays in one piece.
                    held = tuple([c[-1]] for c in held) if k == key else ([], [], [])
                    key, held_bytes = k, sum(x.nbytes for x in held[2])
                held_bytes += len(raw)
                for column, value in zip(held, (s, n, np.frombuffer(raw, np.uint64)), strict=True):
                    column.append(value)
        if len(held[0]) > 1 and (found := _block_links(*held)):
            yield _edges(found)

    def met(some: DataFrame, parts: int) -> DataFrame:
        rows = some.mapInArrow(keyed, "key bigint, n bigint, sig bigint, shared binary")
        ranged = rows.repartitionByRange(parts, "key", "n", "sig").sortWithinPartitions("key", "n", "sig")
        return ranged.mapInArrow(link, "a bigint, b bigint")

    length = F.length("shared")
    doubling = F.floor(F.log2(length / LONG)).cast("int")
    edges = met(sets.where(length < LONG), n_parts)
    for row in sets.where(length >= LONG).groupBy(doubling.alias("doubling")).agg(F.sum(length).alias("bytes")).collect():
        edges = edges.union(met(sets.where((length >= LONG) & (doubling == row["doubling"])), SAMPLES * row["bytes"] // BLOCK_BYTES + 1))
    return edges


def _remaining(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Edges between sets of different components that share a prefix token.

    In a token's list, all sets but those of the largest component there are queries. Lists with the same
    largest component are searched together, queries against all sets, in units of some queries and some indexed
    sets; sizes decide how many units there are, so no task holds a whole list.
    """
    n_parts = exchange.targets(sets.sparkSession)
    if labels is None:
        named = sets.select("sig", "prefix", F.length("shared").alias("bytes"), F.col("sig").alias("label"), F.lit(1).cast("long").alias("size"))
    else:
        sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
        named = sets.select("sig", "prefix", F.length("shared").alias("bytes")).join(sized, F.col("sig") == F.col("node"), "left").select("sig", "prefix", "bytes", F.coalesce("label", "sig").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    postings = saved(named.select("sig", "bytes", "label", "size", F.explode("prefix").alias("token")))
    lists = postings.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("size", "label")).alias("top"))
    mixed = saved(lists.where("lo < hi").select("token", F.col("top.label").alias("hub")))
    members = saved(postings.join(mixed, "token").select("sig", "bytes", "label", "hub").distinct())
    room = F.greatest(F.count("*"), F.ceil(F.sum("bytes") * UNIT / BLOCK_BYTES))  # long sets take more room in a block
    sizes = saved(members.groupBy("hub").agg(room.alias("all"), F.sum(F.when(F.col("label") != F.col("hub"), 1).otherwise(0)).alias("asking")))
    slots = lambda c: F.ceil(F.col(c) / UNIT).cast("int")
    placed = members.join(sizes, "hub").select(
        "sig", "label", F.col("hub").alias("meeting"), (F.col("label") != F.col("hub")).alias("asks"), slots("all").alias("blocks"), slots("asking").alias("turns"),
        F.pmod(F.xxhash64("sig", F.lit(1)), slots("all")).cast("int").alias("block"), F.pmod(F.xxhash64("sig", F.lit(2)), slots("asking")).cast("int").alias("turn"),
    )
    held = placed.join(sets.select("sig", "n", "shared"), "sig")
    columns = ["meeting", "block", "turn", "query", "sig", "n", "label", "shared"]
    indexed = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("query", F.lit(False))
    asked = held.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    units = indexed.select(*columns).union(asked.select(*columns)).repartition(n_parts, "meeting", "block", "turn").sortWithinPartitions("meeting", "block", "turn", "query", "sig")

    def link(batches):
        unit, lists, found = None, None, []
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for m, blk, turn, query, sig, n, label, raw in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (m, blk, turn) != unit:
                    unit, lists, held = (m, blk, turn), None, ([], [], [], [])
                ids = np.frombuffer(raw, np.uint64)
                if not query:
                    for column, value in zip(held, (sig, n, label, ids), strict=True):
                        column.append(value)
                    continue
                if not held[0]:
                    continue
                if lists is None:
                    lists = Lists(held[3])
                others, overlap = lists.search(ids, int(need(np.int64(n))))
                found += [(sig, held[0][j]) for j, c in zip(others.tolist(), overlap.tolist(), strict=True) if held[2][j] != label and _linked(n, held[1][j], c)]
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return units.mapInArrow(link, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row.

    Null and empty texts have no shingles, link with nothing and are their own component. Rows with equal
    sets are one class; the component is the smallest id over all linked rows. Repeated ids share nothing by
    their id alone. A null id stays null and never names a component that has another id.
    """
    classes = _classes(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")), k)
    smallest = saved(classes.where("n > 0").groupBy("label").agg(F.min("doc").alias("component")))
    joined = classes.join(smallest, (classes["label"] == smallest["label"]) & (classes["n"] > 0), "left")
    return joined.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _classes(narrow: DataFrame, k: int) -> DataFrame:
    """(doc, n, label) for each row of `narrow(doc, text)`: rows with shingles and the same label are one component."""
    profile = saved(_profile(narrow, k))
    sets = _survivors(narrow, k, _common_shingles(profile))
    profile = profile.where("common IS NULL").drop("common")
    edges = saved(_sampled_links(sets.select("sig", "n", "shared")))
    labels = None if edges.isEmpty() else saved(components(edges))
    edges = saved(edges.union(_remaining(sets, labels)))
    if edges.isEmpty():
        classes = profile.withColumn("label", F.col("sig"))
    else:
        found = components(edges)
        classes = profile.join(found, profile["sig"] == found["node"], "left").withColumn("label", F.coalesce("label", "sig"))
    return saved(classes.select("doc", "n", "label"))


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns; nulls count by their place."""
    values = [exchange.hashable(docs, name) for name in docs.columns]
    return F.xxhash64(*values, *(v.isNull() for v in values))


def keep_representatives(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: that of the smallest id, then of the smallest row hash.

    Rows are judged by themselves, whatever their ids: null ids come last in a component and repeated ids share
    nothing. Of rows that are equal in all columns one stays. Rows without shingles all stay.
    """
    row = F.struct(docs[id_col].isNull().alias("last"), docs[id_col].alias("id"), _row_key(docs).alias("key"))
    linked = _classes(docs.select(row.alias("doc"), docs[text_col].alias("text")), k).where("n > 0")
    counted = saved(linked.groupBy("label", "doc").agg(F.count("*").alias("copies")))
    kept = saved(counted.groupBy("label").agg(F.min("doc").alias("kept")))
    judged = counted.join(kept, "label").select("doc.id", "doc.key", (F.col("doc") != F.col("kept")).alias("lost"), "copies")
    marks = saved(judged.where("lost or copies > 1"))
    lost, several = marks.where("lost"), marks.where("not lost")

    def is_in(side: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(side["id"]) & (_row_key(docs) == side["key"])

    if several.isEmpty():
        return docs.join(lost, is_in(lost), "left_anti")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    once = docs.join(several, is_in(several), "left_semi").select(docs[id_col].alias("id"), _row_key(docs).alias("key"), whole)
    once = once.dropDuplicates(["id", "key"]).select("row.*")
    return docs.join(marks, is_in(marks), "left_anti").union(once)
