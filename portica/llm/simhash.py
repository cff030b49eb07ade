"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit for each majority among the 64-bit hashes of a text's word shingles. Texts link when their
fingerprints differ in MOST bits or fewer. Equal fingerprints are one point; only distinct points are searched.

1. Means and joint counts of all bits over all points give correlations, by which bits are grouped into small
   atoms, and histograms of the atoms' values give the chance that two points differ in d bits of an atom.
2. Atoms are cut into partitions and each partition gets a threshold of its own, -1 for none. If the thresholds plus
   one sum to MOST + 1, two points within MOST bits are within the threshold of some partition. A dynamic program
   over atoms finds the cut and the thresholds of least cost: rows to deal plus estimated candidate pairs.
3. Points that are within a partition's threshold meet in a bucket: a bucket is a partition without as many bits as
   the threshold says, and the values of its other bits. Buckets are dealt by range of (bucket, point), so a hot
   one is cut; candidates of a bucket are verified on all 64 bits in blocks.
4. A bucket of more than BLOCK points only links neighbours at first. If its points are then of several
   components, it is dealt again by the same principle over the bits in which its points may still differ, until
   buckets are small. Each round fixes more bits, so it ends, and no pair of a large group is written.

Links join points into components; rows get the smallest id of theirs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import exchange, wordscan
from .exchange import saved
from .graph import components

SHINGLE = 4
SEED = 42
BITS, MOST = 64, 4
#: Bits of an atom.
ATOM = 4
#: Points of a bucket that are compared pair by pair, and buckets whose pairs are found together.
BLOCK, SMALL = 2048, 48
#: Neighbours in order to which the points of a larger bucket are linked.
NEAR = 16
#: Rows that a task holds while it looks for pairs, about.
HELD = 1 << 18
#: What a row of a bucket costs to deal, in pairs to verify; the most buckets of one point in a partition.
ROW_COST, VARIANTS = 100.0, 5000


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """A fingerprint for each text; without words it is 0."""
    h, counts = [], []
    for text in texts:
        words = text.lower().split()
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        begins = np.concatenate(([0], ends + 1))[: ends.size]
        if 0 < ends.size < k:
            begins, ends = begins[:1], ends[-1:]
        elif ends.size:
            begins, ends = begins[: ends.size - k + 1], ends[k - 1 :]
        counts.append(ends.size)
        h += [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    n, out = np.array(counts, dtype=np.int64), np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(n)
    if some.size:
        set_bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(set_bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _marked(docs: DataFrame, k: int) -> DataFrame:
    """(doc, fp) for each row of `docs(doc, text)`."""

    def run(batches):
        for part, texts in wordscan.groups(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(fingerprints(texts, k).view(np.int64))], names=["doc", "fp"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, fp bigint")


def _points(batch: pa.RecordBatch, column: str = "fp") -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)


def _bit_counts(points: DataFrame) -> tuple[int, np.ndarray]:
    """(points, joint counts of set bits): each task sends one matrix, sums are an aggregate."""

    def run(batches):
        n, joint = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(_points(batch).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, joint = n + len(x), joint + (x.T @ x)
        cells = np.append(joint.reshape(-1), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size)), pa.array(cells.astype(np.int64))], names=["cell", "n"])

    cells = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in points.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_atoms(n: int, joint: np.ndarray) -> np.ndarray:
    """Bits in atoms of ATOM, a row each: an atom takes the bits that vary most with those it has, atoms next to each other too."""
    mean = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(joint / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, order = set(range(BITS)), []
    while left:
        near = order[-(len(order) % ATOM or ATOM) :]
        weigh = (lambda b: tie[b, near].sum()) if near else (lambda b: tie[b].sum())
        order.append(max(sorted(left), key=weigh))
        left.remove(order[-1])
    return np.array(order).reshape(-1, ATOM)


def _atom_distances(points: DataFrame, atoms: np.ndarray, n: int) -> np.ndarray:
    """Chance that two points differ in d bits of an atom, by atom and d, from histograms over all points."""
    values = 1 << ATOM

    def run(batches):
        seen = np.zeros((len(atoms), values), dtype=np.int64)
        for batch in batches:
            fp = _points(batch)
            for i, bits in enumerate(atoms):
                value = sum(((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j) for j, b in enumerate(bits.tolist()))
                seen[i] += np.bincount(value.astype(np.int64), minlength=values)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(seen.size)), pa.array(seen.reshape(-1))], names=["cell", "n"])

    seen = np.zeros(len(atoms) * values)
    for r in points.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        seen[r["cell"]] = r["n"] / n
    apart = np.bitwise_count(np.arange(values)[:, None] ^ np.arange(values)[None, :])
    return np.array([[np.outer(p, p)[apart == d].sum() for d in range(ATOM + 1)] for p in seen.reshape(len(atoms), values)])


def allocate(n: int, apart: np.ndarray, most: int = MOST) -> list[tuple[int, int, int]]:
    """(first atom, atom after the last, threshold) of each partition that is used: the cut of least cost.

    A partition of w bits with threshold t costs C(w, t) rows a point, and a pair that differs there in d <= t bits
    meets in C(w - d, t - d) of its buckets.
    """
    size, memo = len(apart), {}

    def cost(a: int, b: int, t: int) -> float:
        w = ATOM * (b - a)
        if t > w or comb(w, t) > VARIANTS:
            return np.inf
        chance = np.ones(1)
        for i in range(a, b):
            chance = np.convolve(chance, apart[i])
        return n * comb(w, t) * ROW_COST + n * n / 2 * sum(chance[d] * comb(w - d, t - d) for d in range(t + 1))

    def best(a: int, budget: int) -> tuple[float, list]:
        if a == size:
            return (0.0, []) if budget == 0 else (np.inf, [])
        if (a, budget) not in memo:
            found = best(a + 1, budget)
            for b in range(a + 1, size + 1):
                for t in range(budget):
                    rest, cuts = best(b, budget - t - 1)
                    if rest < np.inf and (c := cost(a, b, t) + rest) < found[0]:
                        found = (c, [(a, b, t), *cuts])
            memo[a, budget] = found
        return memo[a, budget]

    return best(0, most + 1)[1]


def bucket_masks(atoms: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """The bits that the points of a bucket agree in, for each kind of bucket."""
    out = []
    for a, b, t in cuts:
        bits = atoms[a:b].reshape(-1).tolist()
        out += [sum(1 << x for x in bits) - sum(1 << x for x in gone) for gone in combinations(bits, t)]
    return np.array(out, dtype=np.uint64)


_ROW = "bucket bigint, free bigint, fp bigint"


def _rows(bucket: np.ndarray, free: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in (bucket, free, fp)], names=["bucket", "free", "fp"])


def _first_buckets(points: DataFrame, masks: np.ndarray) -> DataFrame:
    """(bucket, free, fp): each point in each of its buckets; `free` are the bits in which a bucket's points may differ."""

    def run(batches):
        for batch in batches:
            fp = _points(batch)
            for i, mask in enumerate(masks.tolist()):
                key = wordscan.mix(wordscan.mix(fp & np.uint64(mask)) + np.uint64(i + 1))
                yield _rows(key, np.full(fp.size, ~mask & (1 << BITS) - 1, dtype=np.uint64), fp)

    return points.mapInArrow(run, _ROW)


def _finer_buckets(rows: DataFrame) -> DataFrame:
    """Each row in MOST + 1 buckets that also agree in a part of the bits that were free."""

    def run(batches):
        for batch in batches:
            bucket, free, fp = (_points(batch, c) for c in ("bucket", "free", "fp"))
            for mask in np.unique(free).tolist():
                at = free == np.uint64(mask)
                bits = [b for b in range(BITS) if mask >> b & 1]
                for j, part in enumerate(np.array_split(bits, MOST + 1)):
                    fixed = sum(1 << int(b) for b in part)
                    key = wordscan.mix(wordscan.mix(bucket[at] + wordscan.mix(fp[at] & np.uint64(fixed))) + np.uint64(j + 1))
                    yield _rows(key, np.full(key.size, mask & ~fixed, dtype=np.uint64), fp[at])

    return rows.mapInArrow(run, _ROW)


class _Trees:
    """A forest over places of an array; `links` has a pair for each union."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Unites pairs of places; those that are of one tree cost a comparison."""
        apart = self.up[left] != self.up[right]
        if not apart.any():
            return
        for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]


def _link_by_shifts(fp: np.ndarray, ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of places less than `most` + 1 apart in the same bucket; `ends` has the end of each place's bucket."""
    trees, at = _Trees(fp.size), np.arange(fp.size)
    for shift in range(1, most + 1):
        at = at[at + shift < ends[at]]
        if not at.size:
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= MOST]
        trees.join(near, near + shift)
    return trees.links


def _link_all(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all linked pairs of one bucket."""
    trees = _Trees(fp.size)
    for i in range(1, min(fp.size, 4)):
        near = np.flatnonzero(np.bitwise_count(fp[i:] ^ fp[:-i]) <= MOST)
        trees.join(near, near + i)
    for begin in range(0, fp.size, 256):
        if (trees.up == trees.up[0]).all():
            break
        rows = np.arange(begin, min(begin + 256, fp.size))
        i, j = np.nonzero((np.bitwise_count(fp[rows, None] ^ fp[None, :]) <= MOST) & (trees.up[rows, None] != trees.up[None, :]))
        trees.join(rows[i], j)
    return trees.links


def _linked(batches):
    """Edges (a, b) of rows in order of buckets, and (bucket, n) of buckets that may not be whole or are large."""

    def done(bucket, fp, last: bool):
        """Results of rows whose buckets are complete as far as this task goes, but for the first and last of all."""
        nonlocal first
        heads = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
        sizes = np.diff(np.append(heads, bucket.size))
        pairs, ends = [], np.repeat(heads + sizes, sizes)
        of_size = np.repeat(sizes, sizes)
        for keep, most in ((of_size <= SMALL, SMALL), (of_size > BLOCK, NEAR)):
            at = np.flatnonzero(keep)
            if at.size:
                inner = np.searchsorted(at, ends[at])
                pairs += [(at[i], at[j]) for i, j in _link_by_shifts(fp[at], inner, most)]
        for h, s in zip(heads.tolist(), sizes.tolist(), strict=True):
            if SMALL < s <= BLOCK:
                pairs += [(h + i, h + j) for i, j in _link_all(fp[h : h + s])]
        tell = sizes > BLOCK
        tell[0] |= first
        tell[-1] |= last
        first = False
        a, b = (fp[np.array([p[k] for p in pairs], dtype=np.int64)].view(np.int64) for k in (0, 1))
        none = pa.nulls(int(tell.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(a.size, pa.int64())], names=["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads[tell]].view(np.int64)), none, pa.array(sizes[tell].astype(np.int64))], names=["a", "b", "n"])

    first, held, size = True, [], 0
    for batch in batches:
        held.append((_points(batch, "bucket"), _points(batch, "fp")))
        size += batch.num_rows
        if size < HELD:
            continue
        bucket, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        begin = int(np.searchsorted(bucket.view(np.int64), bucket[-1].view(np.int64)))
        if begin == 0 and bucket.size > BLOCK:
            # A bucket that fills the task's room is large; its last points go on, so that neighbours meet.
            yield from done(bucket, fp, True)
            begin = bucket.size - NEAR
        elif begin:
            yield from done(bucket[:begin], fp[:begin], False)
        held, size = [(bucket[begin:], fp[begin:])], bucket.size - begin
    if size:
        bucket, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        yield from done(bucket, fp, True)


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that join the linked points of all buckets but large ones, large buckets (bucket)).

    Buckets that a range cuts are few, and small ones are dealt once more, whole.
    """
    n = exchange.targets(rows.sparkSession)
    schema = "a bigint, b bigint, n bigint"
    found = saved(rows.repartitionByRange(n, "bucket", "fp").sortWithinPartitions("bucket", "fp").mapInArrow(_linked, schema))
    told = saved(found.where("b IS NULL").groupBy(F.col("a").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("pieces")))
    edges = found.where("b IS NOT NULL").select("a", "b")
    cut = told.where(f"n <= {BLOCK} AND pieces > 1").select("bucket")
    if not cut.isEmpty():
        whole = rows.join(cut, "bucket", "left_semi").repartition(n, "bucket").sortWithinPartitions("bucket", "fp")
        edges = edges.union(whole.mapInArrow(_linked, schema).where("b IS NOT NULL").select("a", "b"))
    return edges, told.where(f"n > {BLOCK}").select("bucket")


def _mixed(rows: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the large buckets whose points are of two components or more."""
    held = rows.join(large, "bucket", "left_semi")
    named = held.join(labels, held["fp"] == labels["node"], "left").select("bucket", "free", "fp", F.coalesce("label", "fp").alias("label"))
    lists = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return held.join(lists.where("lo < hi").select("bucket"), "bucket", "left_semi")


def point_components(points: DataFrame) -> DataFrame | None:
    """(node, label) of the points of `points(fp)`, distinct, that link with another; None if there are none."""
    n, joint = _bit_counts(points)
    if n < 2:
        return None
    atoms = correlated_atoms(n, joint)
    masks = bucket_masks(atoms, allocate(n, _atom_distances(points, atoms, n)))
    rows = _first_buckets(points, masks)
    edges, large = _pairs(rows)
    edges = saved(edges)
    while not large.isEmpty():
        rows = saved(_finer_buckets(_mixed(rows, large, components(edges))))
        more, large = _pairs(rows)
        edges = saved(edges.union(more))
    return None if edges.isEmpty() else components(edges)


def simhash_components(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row; the fingerprint is 16 lowercase hex digits.

    Null and empty texts and those without words have fingerprint 0 and link like any other. Rows are judged by
    their texts: repeated rows all stay and are of one component. A null id stays null and never names a component
    that has another id. An empty table gives no rows; other columns are not read.
    """
    marked = saved(_marked(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")), k))
    points = saved(marked.groupBy("fp").agg(F.min("doc").alias("least")))
    found = point_components(points.select("fp"))
    if found is None:
        named = points.withColumnRenamed("least", "component")
    else:
        labelled = saved(points.join(found, points["fp"] == found["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
        least = labelled.groupBy("label").agg(F.min("least").alias("component"))
        named = labelled.join(least, "label").select("fp", "component")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(F.col("doc").alias(id_col), digits.alias("fingerprint"), F.col("component").alias("component_id"))
