"""Temperature mixing of sources to a token budget.

Token shares p of the sources are raised to an exponent a and normalised; a is bisected until the mixture
has the wanted share of the greatest entropy, or until no source repeats more often than allowed. The
weights are then realised as block permutations: every source passes through all its documents in an order
of its own for each block, and stops where its part of the budget is spent.

A document's place in its block is a running sum of tokens. It is taken over hash buckets first and within
a bucket second, so that no task sorts a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .exchange import saved

#: Bisection steps; after 60 the exponent is exact to rounding.
STEPS = 60
#: Hex digits of the hash that form a bucket: 4096 buckets for each source and block.
BUCKET_DIGITS = 3
#: Sources that the driver will hold (a name and a number each).
MAX_SOURCES = 1_000_000


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, source, n_tokens): words by row; null source is '' and null text has no tokens."""
    words = F.filter(F.split(F.coalesce(docs[text_col], F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(docs[id_col].alias("doc"), F.coalesce(docs[source_col], F.lit("")).alias("source"), F.size(words).cast("long").alias("n_tokens"))


def weights_at(shares: dict[str, float], exponent: float) -> dict[str, float]:
    top = max(shares.values())
    raised = {s: (p / top) ** exponent for s, p in shares.items()}
    total = math.fsum(raised.values())
    return {s: v / total for s, v in raised.items()}


def entropy_share(weights: dict[str, float]) -> float:
    """Entropy as a share of the greatest possible; 1 for a single source."""
    h = -math.fsum(w * math.log(w) for w in weights.values() if w > 0)
    return h / math.log(len(weights)) if len(weights) > 1 else 1.0


def find_exponent(tokens: dict[str, int], budget: int, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent in [0, 1]: smaller is flatter.

    With `target_entropy`, the largest exponent whose entropy share reaches it (0 if none does). With
    `max_repeats`, the smallest exponent at which no source is read more often than that; both together give
    the larger of the two exponents, as the limit on repeats binds first.
    """
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}

    def bisect(low_side) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_side(weights_at(shares, mid)) else (lo, mid)
        return lo

    exponent = 1.0
    if target_entropy is not None:
        exponent = 1.0 if entropy_share(weights_at(shares, 1.0)) >= target_entropy else bisect(lambda w: entropy_share(w) >= target_entropy)
    elif max_repeats is not None:
        exponent = 0.0
    if max_repeats is not None:
        worst = lambda w: max(w[s] * budget / tokens[s] for s in w)
        if worst(weights_at(shares, exponent)) > max_repeats:
            exponent = max(exponent, bisect(lambda w: worst(w) > max_repeats))
    return exponent


def mix_sources(
    docs: DataFrame, budget: float = 1.0, target_entropy: float | None = 0.95, max_repeats: float | None = 4.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id, source, n_tokens, block, offset, weight): a row for each time that a document is read.

    `budget` is a multiple of the corpus tokens. Block b of a source is its b-th pass, in a permutation of
    its own; `offset` counts the source's tokens before the document in that block. The last block ends with
    the document that reaches the source's part of the budget. Documents without tokens are never read;
    an empty table gives no rows. Null sources are the source ''. Rows with equal ids follow each other in the
    order of their token counts, each read as often as the others; null ids are an id of their own. Other columns
    are not read, so their names may clash with any of these.
    """
    counted = saved(token_counts(docs, id_col, text_col, source_col).where("n_tokens > 0"))
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["source"]: int(r["n"]) for r in sorted(sums, key=lambda r: r["source"])}
    spend = int(sum(tokens.values()) * budget)
    plan = []
    if tokens:
        total = sum(tokens.values())
        w = weights_at({s: n / total for s, n in tokens.items()}, find_exponent(tokens, spend, target_entropy, max_repeats))
        plan = [(s, n, round(w[s] * spend), w[s]) for s, n in tokens.items()]
    parts = docs.sparkSession.createDataFrame(plan, "source string, n long, part long, weight double").where("part > 0")
    # A row for each source, MAX_SOURCES at most; documents of a hot source stay where they are.
    read = counted.join(F.broadcast(parts), "source").withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("part") / F.col("n")).cast("int") - 1)))
    read = read.withColumn("quota", F.least("n", F.col("part") - F.col("block") * F.col("n"))).withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), F.col("block").cast("string"), F.col("doc").cast("string"))))
    read = read.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    heads = read.groupBy("source", "block", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "block", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "block", "bucket").orderBy("order", "doc", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(heads, ["source", "block", "bucket"])
    return placed.withColumn("offset", F.col("base") + F.col("inner")).where("offset < quota").select(
        F.col("doc").alias(id_col), "source", "n_tokens", "block", "offset", "weight"
    )
