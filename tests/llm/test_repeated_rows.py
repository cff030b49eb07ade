"""Suffix dedup: a row that stands twice still shows its passages to other documents."""

import random

from portica.llm import suffix_dedup

from .test_text_operators import SCHEMA, brute_repeats


def test_repeated_rows_speak_for_their_passages(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for size in (210, 250, 400):
        passage = text(size)
        twice, other, null = text(300) + passage + text(300), text(280) + passage + text(310), text(250) + passage + text(50)
        rows = [(1, twice, "", "", 0)] * 2 + [(2, other, "", "", 0)] + [(None, null, "", "", 0)] * 3
        want = {t: brute_repeats([(i, x, *r) for i, (_, x, *r) in enumerate(rows)])[j][:4] for j, (_, t, *_) in enumerate(rows)}
        names = {1: twice, 2: other, None: null}
        got = suffix_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert len(got) == 6 and all(tuple(r)[1:] == want[names[r["doc_id"]]] for r in got)
