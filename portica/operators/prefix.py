"""Running sums of keys that are too long for one task: sums inside buckets of time, and what the buckets before add."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def time_bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (days * 86_400_000_000))


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], bucket: Column | None) -> DataFrame:
    """`rows` with a running sum for each of `sums`, over its key in `order`; `bucket` rises with the order.

    A key is sorted in pieces, one for each of its buckets, and only the totals of its buckets meet in one task.
    Without buckets a key is sorted in one task, but rows that lie by (some of) the keys are not dealt out again.
    """
    if bucket is None:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(c).over(so_far) for name, c in sums.items()})
    parts = {f"_part_{name}": c for name, c in sums.items()}
    dealt = rows.withColumns({"_bucket": bucket, **parts})
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_bucket").agg(*[F.sum(p).alias(p) for p in parts])
    before = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_bucket").alias("_of"), *[F.sum(p).over(earlier).alias(f"_before{p}") for p in parts])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(before, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_bucket").eqNullSafe(F.col("_of"))))
    out = met.withColumns({name: F.sum(f"_part_{name}").over(inside) + F.coalesce(f"_before_part_{name}", F.lit(0)) for name in sums})
    return out.drop(*parts, "_bucket", "_of", *[f"_key_{k}" for k in keys], *[f"_before{p}" for p in parts])
