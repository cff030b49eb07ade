"""Decontamination judges rows by their text, whatever the size of the benchmark."""

import hashlib

import pytest

from portica.llm import decontaminate

from .test_text_operators import SCHEMA


@pytest.mark.parametrize("bits", [decontaminate.BITS_MOST, 1])
def test_null_and_repeated_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS_MOST", bits)
    leak = " ".join(f"leak{i}" for i in range(14))
    bench = spark.createDataFrame([(1, leak), (2, leak)], "item_id bigint, text string")
    rows = [(None, "clean one"), (None, "x " + leak), (None, None), (5, leak), (5, "clean two"), (5, "clean two"), (6, "clean three")]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in decontaminate.remove_documents(docs, bench).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if "leak" not in (r[1] or "")), key=str)


@pytest.mark.parametrize("bits", [decontaminate.BITS_MOST, 1])
def test_rows_of_one_id_report_their_own_hits(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS_MOST", bits)
    leak = " ".join(f"leak{i}" for i in range(14))
    bench = spark.createDataFrame([(1, leak, 0), (2, "short item", 0), (3, leak, 0)], "item_id bigint, text string, size int")
    rows = [(5, "a " + leak), (5, "a short item here"), (5, "clean"), (None, leak), (None, "clean"), (None, None), (7, leak), (7, leak), (8, "w " * 200_000 + leak)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, start int, gram int")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).collect()]
    want = [(5, 15, 14, 2), (5, 4, 2, 1), (5, 1, 0, 0), (None, 14, 14, 2), (None, 1, 0, 0), (None, 0, 0, 0), (7, 14, 14, 2), (7, 14, 14, 2), (8, 200_014, 14, 2)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_items_of_equal_text_are_not_broadcast(spark):
    bench = spark.range(50).selectExpr("id AS item_id", "'same short text' AS text")
    docs = spark.createDataFrame([(1, "the same short text")], "doc bigint, text string")
    plan = decontaminate.find_hits(docs, bench)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
    row = decontaminate.contamination(docs.withColumnRenamed("doc", "doc_id"), bench).first()
    assert (row["n_hit"], row["n_items"]) == (3, 50)
    assert row["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, range(50)))).encode()).hexdigest()
