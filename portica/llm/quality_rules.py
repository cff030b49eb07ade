"""Quality rules: a ledger of rule bits and measurements per document, and policies over it.

Every rule is evaluated once.  The ledger holds a bitmask of failed rules next to the measurements, so a
policy is a mask, applying it is one bitwise AND, and ablations come from a count per bit pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordscan

#: Rules by bit. All compare whole numbers, so that SQL gives the same bits.
RULES = {
    "few_words": 0,  # n_words < 20
    "repeated_windows": 1,  # 100 * n_repeat_words > 30 * n_words
    "symbols": 2,  # 10 * n_symbols > n_words
    "duplicate_lines": 3,  # n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines
    "shouting": 4,  # 10 * n_upper > 4 * word_chars
    "exclamations": 5,  # 10 * n_exclaim > n_words
    "word_length": 6,  # word_chars < 2 * n_words or word_chars > 15 * n_words
}
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim")
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def mask_of(policy: str) -> int:
    return sum(1 << RULES[name] for name in POLICIES[policy])


def _repeat_words(words: wordscan.Words) -> np.ndarray:
    """Words by text that stand in a window of eight found twice or more in that text."""
    out = np.zeros(words.counts.size, dtype=np.int64)
    h, doc = words.shingles(WINDOW)
    if not h.size:
        return out
    key = h ^ wordscan.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(h.size, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    n = words.hash.size - WINDOW + 1
    at = np.flatnonzero(words.doc[:n] == words.doc[WINDOW - 1 :])[twice]
    cover = np.zeros(words.hash.size + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=out.size)


def _lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = wordscan.Words(texts, lower=False)
    lines = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    point = (w.buf & 0xC0) != 0x80
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": wordscan.sum_by_text(w.inside & point, w),
        "n_symbols": wordscan.sum_by_text(_SYMBOL[w.buf], w),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _repeat_words(w),
        "n_upper": wordscan.sum_by_text((w.buf >= 65) & (w.buf <= 90), w),
        "n_exclaim": wordscan.sum_by_text(w.buf == 33, w),
    }


def failed_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    fails = {
        "few_words": m["n_words"] < 20,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"]),
        "shouting": 10 * m["n_upper"] > 4 * m["word_chars"],
        "exclamations": 10 * m["n_exclaim"] > m["n_words"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    }
    return sum(fails[name].astype(np.int64) << bit for name, bit in RULES.items())


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measurements, failed) for each row; no shuffle.

    Null or empty text measures zero throughout and fails `few_words`. Repeated rows and null ids pass
    through as they are; other columns are ignored.
    """
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        for part, texts in wordscan.groups(batches, "text"):
            m = _measure(texts)
            arrays = [part.column("id"), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(failed_bits(m), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *MEASURES, "failed"])

    schema = f"id {kind}, " + ", ".join(f"{k} bigint" for k in MEASURES) + ", failed bigint"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept`: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, those that only it rejects, and those kept without it.

    Aggregates once to a row per bit pattern (at most 2 ** rules), then works on the patterns.
    """
    mask = mask_of(policy)
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    counts = []
    for name in POLICIES[policy]:
        bit = 1 << RULES[name]
        counts.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only"),
                F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
            )
        )
    return patterns.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def filter_documents(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that a policy keeps, unchanged; evaluated beside the row, without a join."""
    names = docs.columns
    mask = mask_of(policy)

    def run(batches):
        for part, texts in wordscan.groups(batches, text_col):
            keep = (failed_bits(_measure(texts)) & mask) == 0
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema).select(*names)
