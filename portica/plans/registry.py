"""Registered queries: one or more for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship
from .prep import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OFF_HALF = 0.00371


def query(name: str, text: str = "", whole: str = "", real: str = "", sql: str = "", digits: int = 6):
    """Registers a function of the tables. Columns: `text` as they are, `whole` as bigint, `real` rounded.

    The same selection is put around the oracle's SQL. Rounding is a little off the half, since values that are
    halves in decimal differ in their last bit between engines.
    """
    scale = 10.0**digits
    as_is, whole_, real_ = text.split(), whole.split(), real.split()

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(ship(spark), sf_dir))
            return df.select(*as_is, *[F.col(c).cast("bigint").alias(c) for c in whole_], *[(F.round(F.col(c).cast("double") * scale + OFF_HALF) / scale + F.lit(0.0)).alias(c) for c in real_])

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            cols = [*as_is, *[f"CAST({c} AS BIGINT) AS {c}" for c in whole_], *[f"ROUND(CAST({c} AS DOUBLE) * CAST({scale} AS DOUBLE) + CAST({OFF_HALF} AS DOUBLE)) / CAST({scale} AS DOUBLE) + 0.0 AS {c}" for c in real_]]
            ORACLES[name] = oracle(_wrap(sql, ", ".join(cols)))
        return f

    return register


def _wrap(sql: str, cols: str) -> str:
    head = sql.strip()
    if head.upper().startswith("WITH"):
        at = head.rindex("\nSELECT")
        return f"{head[:at]}, final_rows AS ({head[at:].strip()}) SELECT {cols} FROM final_rows"
    return f"SELECT {cols} FROM ({head}) AS final_rows"
