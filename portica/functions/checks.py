"""Check tables: one row for each rule that a row breaks. Nothing is dropped or repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class CheckFailed(ValueError):
    """Rows break a rule and the caller asked for strictness."""


def check_rows(df: DataFrame, rules: dict[str, Column], show: list[str]) -> DataFrame:
    """(show.., rule): a row for each row and rule that fails; a rule that is null counts as failed."""
    failed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(*show, F.explode(failed).alias("rule"))


def check_numeric(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]], show: list[str]) -> DataFrame:
    """Finite numbers within bounds (inclusive, None for open); a boolean column is not numeric."""
    rules: dict[str, Column] = {}
    kinds = dict(df.dtypes)
    for name, (low, high) in bounds.items():
        if kinds[name] == "boolean":
            rules[f"{name}:not_numeric"] = F.lit(True)
            continue
        x = F.col(name).cast("double")
        rules[f"{name}:not_finite"] = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        finite = ~(x.isNull() | F.isnan(x))
        if low is not None:
            rules[f"{name}:too_low"] = finite & (x < low)
        if high is not None:
            rules[f"{name}:too_high"] = finite & (x > high)
    return check_rows(df, {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}, show)


def check_keys(df: DataFrame, cols: list[str], ignore_case: bool = False) -> DataFrame:
    """(cols.., n, rule): keys that stand more than once."""
    named = [F.lower(F.col(c)).alias(c) if ignore_case else F.col(c) for c in cols]
    return df.select(*named).groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").withColumn("rule", F.lit("duplicate_key"))


def check_identifier(df: DataFrame, col: str, show: list[str]) -> DataFrame:
    """Identifiers must be nonblank and without white space at either end."""
    x = F.col(col).cast("string")
    return check_rows(df, {f"{col}:blank": x.isNull() | (F.trim(x) == ""), f"{col}:padded": x.isNotNull() & (F.trim(x) != "") & x.rlike(r"^\s|\s$")}, show)


def require(checks: DataFrame, what: str = "check") -> None:
    """Raises with a few of the broken rules if the check table has rows; one action."""
    rows = checks.limit(5).collect()
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def digest_rows(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """(keys.., rows, digest): a hash of the rows of each key that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
    # Sums of the hash's quarters do not depend on order and add up map-side, so a large key is never gathered.
    quarters = [F.conv(F.substring(row, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)") for i in range(4)]
    sums = df.select(*keys, *[q.alias(f"_q{i}") for i, q in enumerate(quarters)]).groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(f"_q{i}").alias(f"_q{i}") for i in range(4)])
    return sums.select(*keys, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"_q{i}").cast("string") for i in range(4)]), 256).alias("digest"))
