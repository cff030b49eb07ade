"""License scans: cosines against a plain version, whole licence files, and rows as they are."""

import math
import re
from collections import Counter

import pytest
from portica.llm import license_scan, license_texts
from pyspark.sql import functions as F

TERM = re.compile(license_scan._TERM)
FILLER = "the quick brown fox jumps over the lazy dog of the village " * 6


def terms(text):
    return TERM.findall((text or "").lower())


def brute(texts, threshold):
    """{text number: best (similarity, license)} over all units of all texts, without any selection."""
    df = Counter(t for x in texts for t in set(terms(x)))
    idf = lambda t, d=None: math.log((len(texts) + 1) / ((df[t] if df[t] or d is None else d) + 1)) + 1
    vector = lambda ts: {t: n * idf(t) for t, n in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    notices = [(name, vector(terms(t))) for name, ts in license_texts.NOTICES.items() for t in ts]
    texts_ = [(name, vector(terms(t))) for name, t in license_texts.TEXTS.items()]
    out = {}
    for i, x in enumerate(texts):
        if not x:
            continue
        header = re.match(license_scan._COMMENT, x)
        units = [terms(u) for u in [*x.split("\n"), *(b for b in re.split(r"\n[ \t\r]*\n", x) if "\n" in b.strip(" ")), header[0] if header else ""]]
        pairs = [(vector(u), t) for u in units for t in notices + texts_] + [(vector(u), t) for u in (terms(x), terms(x)[: license_scan.OPENING]) for t in texts_]
        for v, (name, t) in pairs:
            c = round(sum(w * t.get(k, 0) for k, w in v.items()) / (norm(v) * norm(t)), 9) if v else 0
            if c >= threshold:
                out[i] = min(out.get(i, (1, "")), (-c, name))
    return out


@pytest.fixture(scope="module")
def texts():
    wrap = lambda t, k, mark="": "\n".join(mark + " ".join(t.split()[i : i + k]) for i in range(0, len(t.split()), k))
    apache = license_texts.NOTICES["Apache-2.0"][1]
    return [
        FILLER, None, "", "the license of poetry is broad", FILLER + "\nReleased under the MIT License.\n" + FILLER, "Copyright 2020 Some One\n\n" + wrap(license_texts.TEXTS["MIT"], 11),
        wrap(apache, 9, "# ") + "\nimport os\n" + FILLER, wrap(license_texts.TEXTS["BSD-3-Clause"], 10), FILLER + "\n\n" + wrap(license_texts.NOTICES["MPL-2.0"][0], 6) + "\n\n" + FILLER,
        "// SPDX-License-Identifier: MIT\n" + FILLER, "MIT MIT MIT", "permission is granted to the dog of the village", "die mit der und mit den", wrap(license_texts.TEXTS["GPL-3.0-only"], 8) + "\n" + FILLER * 30,
    ]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_matches_are_those_of_brute_force(spark, texts, threshold):
    docs = spark.createDataFrame(list(enumerate(texts)), "row int, text string").repartition(3)
    best = license_scan.similarities(docs, threshold).groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("b")).collect()
    got = {r["row"]: (r["b"]["less"], r["b"]["license"]) for r in best}
    want = brute(texts, threshold)
    assert set(got) == set(want) and len(got) >= 5
    assert all(abs(got[i][0] - want[i][0]) < 1e-8 and got[i][1] == want[i][1] for i in got)


def test_whole_licence_files_speak_for_their_directory(spark, texts):
    rows = [(5, texts[5], "a/LICENSE"), (7, texts[7], "a/b/LICENSE"), (6, texts[6], "c/x.py"), (13, texts[13], "d/COPYING"), (0, FILLER, "a/b/c/x"), (1, None, "a/y"), (2, FILLER, "c/z"), (3, FILLER, "d/e/f"), (4, FILLER, None)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id int, text string, path string, row string, kind int")
    got = {r["doc_id"]: (r["own_license"], r["is_license_file"], r["license"], r["inherited_from"]) for r in license_scan.scan(docs).collect()}
    assert got == {
        5: ("MIT", True, "MIT", None), 7: ("BSD-3-Clause", True, "BSD-3-Clause", None), 6: ("Apache-2.0", False, "Apache-2.0", None), 13: ("GPL-3.0-only", True, "GPL-3.0-only", None),
        0: (None, False, "BSD-3-Clause", "a/b"), 1: (None, False, "MIT", "a"), 2: (None, False, None, None), 3: (None, False, "GPL-3.0-only", "d"), 4: (None, False, None, None),
    }


def test_rows_are_judged_apart_and_ties_are_settled(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    rows = [(1, mit, "p/a"), (1, FILLER, "p/a"), (1, FILLER, "p/a"), (None, apache, "q/LICENSE"), (None, mit, "q/COPYING"), (None, FILLER, "q/z"), (2, FILLER + "word " * 100_000 + "\n" + mit, "r/long")]
    got = [(r["doc_id"], r["own_license"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string, path string")).collect()]
    want = [(1, "MIT", "MIT"), (1, None, "MIT"), (1, None, "MIT"), (None, "Apache-2.0", "Apache-2.0"), (None, "MIT", "MIT"), (None, None, "Apache-2.0"), (2, "MIT", "MIT")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
