"""A bounded sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels must not be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, label: str, per_class: dict[int, int], id_col: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """(rows (doc, y), kept fraction by class): about `per_class[y]` labelled rows of class y.

    Give it to `texts` for the documents of those rows. Rows are chosen by a hash of the id, so the choice is the same on every run; held-out documents and
    null labels are left out. Its size is bounded by `per_class`, not by the table, so it can be broadcast.
    """
    rows = (
        labels.select(F.col(id_col).alias("doc"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc").isNotNull() & ~held_out(F.col("doc")))
        .groupBy("doc")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, per_class[y] / counts[y]) for y in counts}
    draw = F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(1 << 20))
    chosen = F.lit(False)
    for y, f in share.items():
        chosen = chosen | ((F.col("y") == y) & (draw < int(f * (1 << 20))))
    return rows.where(chosen), share


def texts(chosen: DataFrame, docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(doc, y, text): one document of `docs(doc, text)` for each row of a sample, of at most `max_bytes` if given.

    Of rows that repeat an id the text of the smallest hash counts, so the sample stays as small as it is.
    """
    small = docs if max_bytes is None else docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    met = small.join(F.broadcast(chosen), "doc").withColumn("order", F.xxhash64("text"))
    return met.groupBy("doc", "y").agg(F.min_by("text", "order").alias("text"))
