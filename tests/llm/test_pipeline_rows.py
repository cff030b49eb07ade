"""Stages keep rows and columns as they are: nulls, repeats, types and clashing names."""

import datetime

import corpus_pipeline
import pytest
from portica.llm import suffix_dedup
from pyspark.sql import functions as F

from .test_text_operators import corpus

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, kind int, lost double, block timestamp, row binary, uid map<string,int>"
WHEN = datetime.datetime(2024, 1, 2, 3, 4, 5, 123456)


@pytest.fixture(scope="module")
def odd(spark):
    more = ("d", 1, float("nan"), WHEN, b"\x00\xff", {"a": 1})
    rows = [(*r, *more) for r in corpus(seed=8, n=40)]
    rows += [rows[20], (None, rows[21][1], *rows[21][2:]), (None, None, *rows[21][2:]), (rows[3][0], "words of another text " * 12, *rows[3][2:]), (9999, "x" * 300_000, *rows[4][2:])]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def test_stages_keep_extra_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
        got = out.collect()
        assert got and {r["block"] for r in got} == {WHEN} and {bytes(r["row"]) for r in got} == {b"\x00\xff"}, name
        assert all(r["lost"] != r["lost"] and r["uid"] == {"a": 1} and r["doc"] == "d" for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() > 0


def test_removal_keeps_every_row(odd):
    out = suffix_dedup.remove_repeats(odd)
    ids = lambda df: sorted((-1 if r[0] is None else r[0]) for r in df.select("doc_id").collect())
    assert ids(out) == ids(odd)
    assert out.where("text IS NULL").count() == 0 and out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_digest_of_repeated_and_null_ids(spark):
    a, b = "ab cd ef gh " * 40, "other words of a text that stands alone " * 8
    rows = [(1, a), (1, a), (None, a), (1, b), (None, None), (2, "short")]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("x"))).collect()]
    assert sorted(got, key=repr) == sorted([(1, 480, 480), (1, 480, 480), (None, 480, 480), (1, 320, 320), (None, 0, 0), (2, 5, 0)], key=repr)
