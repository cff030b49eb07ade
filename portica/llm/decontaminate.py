"""Benchmark decontamination with DataFrame functions only.

The normalised word windows of the benchmark form a hash set: a filter of bits of bounded size, which travels as a
literal inside the plan. Every training window is looked up in place, two bits each, and only those that may be in
the set are met with the benchmark's windows, by a join on their words, which verifies them. The plan is the
same for a benchmark of any size; the fuller the filter, the more windows are left to the join. Hits give
spans and items per document, or the documents to drop.

Rows are named by their id and two hashes of their text, so that rows which share an id, or have none, are judged apart.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .exchange import saved

WINDOW = 10
#: Bits of the filter for each distinct benchmark window, and at most: 2 MB.
BITS_EACH, BITS_MOST = 64, 1 << 24
#: Names of contaminated texts, 20 bytes each, up to which they go to every task; more are joined by shuffle.
FEW = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def text_key(text: Column) -> Column:
    """A name of a text of 128 bits and its length; null has one of its own."""
    return F.struct(F.xxhash64(text).alias("hash"), F.xxhash64(F.lit("second"), text).alias("second"), F.octet_length(text).alias("bytes"))


class BitFilter:
    """A set of 64-bit hashes as bits, two for each, in an array literal."""

    def __init__(self, hashes: DataFrame):
        """`hashes` has a bigint column h. What is collected is at most BITS_MOST / 64 numbers."""
        n = hashes.count()
        self.bits = 1 << 10
        while self.bits < min(BITS_EACH * n, BITS_MOST):
            self.bits <<= 1
        spots = hashes.select(F.explode(F.array(*self._spots(F.col("h")))).alias("at"))
        words = spots.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("ones"))
        held = [0] * (self.bits // 64)
        for r in words.collect():
            held[r["word"]] = r["ones"]
        self.words = F.from_json(F.lit(json.dumps(held)), "array<bigint>")

    def _spots(self, h: Column) -> list[Column]:
        mask = F.lit(self.bits - 1).cast("long")
        return [h.bitwiseAND(mask), F.shiftright(h, 32).bitwiseAND(mask)]

    def may_hold(self, h: Column) -> Column:
        a, b = self._spots(h)
        has = lambda at: F.getbit(F.element_at(self.words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        return has(a) & has(b)


def _likely(words: Column, sizes: list[int], seen: BitFilter) -> Column:
    """(start, size) of the windows that may be in the set."""
    def of_size(size: int) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))
        places = F.transform(hashes, lambda h, i: F.when(seen.may_hold(h), F.struct((i + 1).alias("start"), F.lit(size).alias("size"))))
        return F.coalesce(F.filter(places, lambda x: x.isNotNull()), F.array().cast("array<struct<start:int,size:int>>"))

    return F.concat(*map(of_size, sizes))


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, gram): every window of each item; an item with fewer words is one window."""
    words = words_of(benchmark[text_col])
    items = benchmark.select(benchmark[id_col].alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    return (
        items.withColumn("size", size)
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
        .select("item_id", "size", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("gram"))
        .distinct()
    )


def _gram(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _filter_of(grams: DataFrame) -> tuple[list[int], BitFilter | None]:
    """The sizes of windows that occur and the filter of their hashes."""
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())
    return sizes, BitFilter(grams.select(F.xxhash64(F.split("gram", " ")).alias("h")).distinct()) if sizes else None


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, grams): documents(doc, n_words), verified hits(doc, start, size, gram), grams(item_id, size, gram).

    `docs` has `doc`, of any type, and `text`; `benchmark` has `item_id` and `text`; other columns are not read.
    `start` counts words from 1. Null and empty texts have no words and no hits; repeated rows of `doc` each
    appear in documents. Items that share a window do not multiply hits.
    """
    grams = benchmark_windows(benchmark, window, "item_id", "text")
    worded = docs.select("doc", words_of(F.col("text")).alias("words"))
    documents = worded.select("doc", F.size("words").cast("long").alias("n_words"))
    sizes, seen = _filter_of(grams)
    if seen is None:
        return documents, documents.where("1 = 0").select("doc", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("gram")), grams
    found = worded.withColumn("place", F.explode(_likely(F.col("words"), sizes, seen))).select("doc", "place.start", "place.size", _gram(F.col("words"), F.col("place.start"), F.col("place.size")).alias("gram"))
    return documents, found.join(grams.select("size", "gram"), ["size", "gram"], "left_semi").select("doc", "start", "size", "gram"), grams


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a benchmark window counts as hit. Null or empty texts give
    zeros. Rows that repeat an id are judged apart, by their own texts; null ids too. An empty benchmark leaves
    every document clean, an empty table gives no rows. Other columns are not read.
    """
    row = F.struct(docs[id_col].alias("id"), text_key(docs[text_col]).alias("key"))
    bench = benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].alias("text"))
    documents, hits, grams = find_hits(docs.select(row.alias("doc"), docs[text_col].alias("text")), bench, window)
    hits = saved(hits)  # spans and items both read them
    spans = hits.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"))
    items = hits.select("doc", "size", "gram").distinct().join(grams, ["size", "gram"]).groupBy("doc").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("next")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["next"], s["start"].cast("long")))).cast("long").alias("n"),
            F.greatest(acc["next"], (s["start"] + s["size"]).cast("long")).alias("next"),
        ),
        lambda acc: acc["n"],
    )
    found = spans.select(F.col("doc").alias("hit_doc"), covered.alias("n_hit")).join(items, F.col("hit_doc").eqNullSafe(items["doc"])).select(
        "hit_doc", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    return documents.join(found, F.col("doc").eqNullSafe(F.col("hit_doc")), "left").select(
        F.col("doc.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any benchmark window, all columns kept.

    Rows with a window that may be in the set are verified by a join, which gives the names of the texts that go; rows
    travel only if those are many. A row is judged by its text, whatever its id: null and repeated ids, repeated rows and
    null texts stay unless their own text has a window. Columns of any type and name come through.
    """
    grams = benchmark_windows(benchmark.select("item_id", "text"), window, "item_id", "text").select("size", "gram").distinct()
    sizes, seen = _filter_of(grams)
    if seen is None:
        return docs
    text = docs[text_col]
    # The words are bound by a lambda, so that they are split once for a row and not once for a window.
    places = F.flatten(F.transform(F.array(words_of(text)), lambda words: F.transform(_likely(words, sizes, seen), lambda x: F.struct(x["size"].alias("size"), _gram(words, x["start"], x["size"]).alias("gram")))))
    doubtful = docs.select(text_key(text).alias("key"), F.explode(places).alias("place")).select("key", "place.size", "place.gram")
    bad = saved(doubtful.join(grams, ["size", "gram"], "left_semi").select("key").distinct())
    if bad.count() <= FEW:
        bad = F.broadcast(bad)
    return docs.join(bad, text_key(text) == bad["key"], "left_anti")
