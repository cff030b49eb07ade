"""Near copies and the pipeline over tables with null ids, repeated ids and repeated rows."""

import random

import corpus_pipeline
from portica.llm import ngram_join

from .test_text_operators import SCHEMA


def table():
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(80))
    near = lambda t: t + " tail"
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(None, near(a)), (1, a), (None, b)]  # a null id in the group of another id; a clean null id
    rows += [(3, c), (5, near(c)), (5, d)]  # a repeated id, of which one row is a near copy
    rows += [(6, e)] * 3  # the same row again
    rows += [(None, f), (None, near(f)), (None, f)]  # a group of null ids
    rows += [(7, g)]
    want = [(1, a), (None, b), (3, c), (5, d), (6, e), (7, g)]
    return [(i, t, "en", "s", len(t)) for i, t in rows], want, (f, near(f))


def test_one_row_of_each_group_stays(spark):
    rows, want, group = table()
    docs = spark.createDataFrame(rows + [(None, None, None, None, None)] * 2, SCHEMA).repartition(3)
    out = ngram_join.keep_representatives(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted((r for r in got if r[1] and r[1] not in group), key=str) == sorted(want, key=str)
    assert sum(r[1] in group for r in got) == 1 and sum(r[1] is None for r in got) == 2


def test_pipeline_keeps_one_row_of_each_group(spark, tmp_path):
    rows, want, group = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never seen words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).where("block = 0").collect()]
    assert len(got) == len(want) + 1 and all(80 <= n <= 81 for _, n in got)
    assert sorted((i for i, _ in got), key=str) == sorted([*(i for i, _ in want), None], key=str)
