"""Sinks: reports are published whole and never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish_json(df: DataFrame, path: str) -> str:
    """Writes JSON to a path that must not exist; Spark's commit makes it visible only when complete."""
    df.write.mode("errorifexists").json(path)
    return path


def write_artifacts(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Writes a result as csv (with a header), json or parquet; replaces what was there."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    writer.format(fmt).save(path)
    return path


def publish_documents(documents: DataFrame, path: str) -> str:
    """Writes each row of `documents(study_id, document)` to a file of its own under a path that must not exist.

    The readers of studies take one document a file; files of one id lie in one folder.
    """
    rows = documents.select(documents["study_id"].alias("doc"), documents["document"].alias("value"))
    rows.repartition("doc").write.mode("errorifexists").option("maxRecordsPerFile", 1).partitionBy("doc").text(path)
    return path
