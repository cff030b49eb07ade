"""Text operators against brute force, on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from portica.llm import decontaminate, html_render, license_scan, lm_scoring, mixing, ngram_join, quality_net, quality_rules, suffix_dedup, toxicity, wordscan

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = sentence(70)
    texts = [sentence(rng.randint(5, 160)) for _ in range(n)]
    for i in range(0, n, 6):
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], sentence(40) + " " + passage + " " + sentence(40), passage + "\n" + sentence(30), sentence(20) + "\t" + passage]
    texts += [None, "", "   \n\t ", "One", "one", "ab " * 400, "#### $$ %% && " * 30, ("Zeile eins\n" * 9) + sentence(20), "É" * 500]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower_words(text):
    return (text or "").encode().lower().split()


def test_word_hashes_follow_words():
    texts = [b"The cat\tthe CAT", b"", b" x "]
    w = wordscan.Words(texts)
    assert w.counts.tolist() == [4, 0, 1] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[0] != w.hash[1]
    assert wordscan.Words(texts, lower=False).hash[0] != wordscan.Words(texts, lower=False).hash[2]


def test_quality_ledger(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        lines = [x for x in (t or "").encode().split(b"\n") if x.strip()]
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {j + k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(8)}
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    entries = quality_rules.ledger(docs)
    kept = quality_rules.apply_policy(entries, "v2").where("kept").count()
    table = {r["rule"]: r for r in quality_rules.ablations(entries, "v2").collect()}
    assert set(table) == set(quality_rules.RULES) and all(r["n_kept_without"] == kept + r["n_only"] for r in table.values())
    clash = docs.withColumn("failed", F.lit("x")).withColumn("n_words", F.lit("y"))
    assert quality_rules.filter_documents(clash).columns == clash.columns and quality_rules.filter_documents(clash).count() == kept
    assert quality_rules.ledger(empty).count() == 0


def test_ngram_components(spark, docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {i: (len(sets[i]), root(i)) for i in sets}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in ngram_join.keep_representatives(docs).collect()}
    assert kept == {i for i in want if want[i][1] == i}
    assert ngram_join.jaccard_components(empty).count() == 0
    twice = spark.createDataFrame([rows[0], rows[0], (None, None, None, None, None)], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(twice).where("doc_id = 0").collect()) == [(0, 0), (0, 0)]


def test_divide_skip_counts_overlaps():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 250, replace=False), rng.integers(0, 1 << 60, 30).astype(np.uint64)])) for _ in range(40)]
    lists = ngram_join.Lists(sets)
    for q in sets[:5]:
        others, overlap = lists.search(q, 200)
        want = {j: len(np.intersect1d(q, s)) for j, s in enumerate(sets)}
        assert dict(zip(others.tolist(), overlap.tolist(), strict=True)) == {j: c for j, c in want.items() if c >= 200}


def brute_repeats(rows, width=200):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, dtype=bool)
        for j in range(len(b) - width + 1):
            if seen[b[j : j + width]] > 1:
                gone[j + 1 : j + 1 + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]]) if b else b""
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(spark, docs, rows, empty):
    want = brute_repeats(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    assert got == {i: w[:4] for i, w in want.items()}
    clean = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert all(clean[i]["text"] == want[i][4].decode(errors="ignore") and clean[i]["source"] == r[3] for i, r in enumerate(rows))
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns
    assert suffix_dedup.digest(empty).count() == 0
    twice = spark.createDataFrame([rows[2], rows[2]], SCHEMA)
    assert all(r["n_removed"] == r["n_bytes"] for r in suffix_dedup.digest(twice).collect())


def test_multikey_sort_finds_equal_windows():
    data = b"abcdefghij" * 30 + b"xyz" + b"abcdefghij" * 5
    buf = np.frombuffer(data + bytes(8), np.uint8)
    starts = np.arange(len(data) - 20 + 1)
    found, group = suffix_dedup.multikey_sort(buf, starts, 20)
    seen = Counter(data[i : i + 20] for i in starts)
    assert sorted(found.tolist()) == [i for i in starts.tolist() if seen[data[i : i + 20]] > 1]
    assert len({(int(g), data[i : i + 20]) for i, g in zip(found.tolist(), group.tolist(), strict=True)}) == len(set(group.tolist()))


def bench_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("bits", [decontaminate.BITS_MOST, 1])
def test_contamination(spark, docs, rows, empty, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS_MOST", bits)
    items = [(1, rows[3][1].upper()), (2, " ".join(rows[5][1].split()[2:16])), (3, "one"), (4, None), (5, "!!"), (6, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    grams = {}
    for i, t in items:
        w = bench_words(t)
        n = min(len(w), 10)
        for j in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    want = {}
    for i, t, *_ in rows:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found |= grams[tuple(w[j : j + n])]
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs.withColumn("words", F.lit(1)), bench).collect()}
    assert got == want
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i in want if not want[i][4]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("1 = 0")).where("contaminated").count() == 0


def test_language_model(docs, rows, empty):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    count = Counter()
    for i, t, *_ in rows:
        if not held[i]:
            count.update([*lower_words(t), None])
    n, v = sum(count.values()), len(count)
    got = lm_scoring.score_texts(docs, rounds=1).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [*lower_words(rows[r["doc_id"]][1]), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert abs(r["base_score"] - base) < 1e-6 and r["n_tokens"] == len(w) and r["n_known"] == sum(count[x] > 0 for x in w)
        assert r["train_tokens"] == n and r["held_out"] == held[r["doc_id"]] and r["score"] < 0
    assert lm_scoring.score_texts(empty).count() == 0


def test_language_model_learns(spark):
    texts = [(i, "red green blue " * 20 if i % 2 else "uno dos tres " * 20, "", "", 0) for i in range(80)]
    got = lm_scoring.score_texts(spark.createDataFrame(texts, SCHEMA)).collect()
    assert all(r["score"] > r["base_score"] for r in got)


def labelled(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(900):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) + str(rng.randint(0, 9)) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["grobnik", "grobnas", "zlokal"])
        junk = i % 5 == 0
        texts.append((i, " ".join(w + "###" if junk else w for w in words), "", "", 0))
        labels.append((i, int(not junk), int(bad)))
    texts += [(1000, None, "", "", 0), (1001, "", "", "", 0)]
    return spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_toxicity_and_quality_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark)
    tox = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in truth if tox[i]["held_out"]]
    assert held and all(tox[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert sum(tox[i]["predicted"] == truth[i][1] for i in held) >= 0.97 * len(held)
    bad = next(i for i in held if truth[i][1])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}[bad].encode()
    assert any(text[s["start"] : s["end"]].decode().startswith(("grob", "zlok")) for s in tox[bad]["spans"])
    assert all(tox[i]["predicted"] == 0 and 0 <= tox[i]["score"] <= 1 and not tox[i]["spans"] for i in (1000, 1001))
    q = {r["doc_id"]: r for r in quality_net.score_quality(docs, labels).collect()}
    assert sum(q[i]["predicted"] == truth[i][0] for i in held) >= 0.97 * len(held) and 0 <= q[1000]["score"] <= 1
    none = labels.where("1 = 0")
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0
    assert quality_net.score_quality(docs, none).count() == len(tox)
    assert toxicity.score_toxicity(empty, labels).count() == quality_net.score_quality(empty, labels).count() == 0


def test_chain_marginals_match_brute_force():
    chain = toxicity.Chain(move=np.array([[0.3, -0.7], [0.2, 0.9]]))
    e = np.array([0.4, -1.2, 0.8, 0.1, -0.5])
    first = np.array([True, False, False, True, False])
    p, _, _ = chain.marginals(e, first)
    for lo, hi in ((0, 3), (3, 5)):
        total = np.zeros(hi - lo)
        z = 0.0
        for m in range(1 << (hi - lo)):
            s = [(m >> k) & 1 for k in range(hi - lo)]
            w = math.exp(sum(e[lo + k] * s[k] for k in range(hi - lo)) + sum(chain.move[s[k - 1], s[k]] for k in range(1, hi - lo)))
            z += w
            total += w * np.array(s)
        assert np.allclose(p[lo:hi], total / z)


def test_mixing(spark, docs, rows, empty):
    out = mixing.mix_sources(docs, budget=2.0, target_entropy=0.99, max_repeats=None).collect()
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    by = {}
    for i, _, _, s, _ in rows:
        by.setdefault(s or "", []).append(i)
    tokens = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    total = sum(tokens.values())
    a = mixing.find_exponent(tokens, 2 * total, 0.99, None)
    w = mixing.weights_at({s: n / total for s, n in tokens.items()}, a)
    assert mixing.entropy_share(w) >= 0.99 - 1e-9
    want = []
    for s, ids in by.items():
        part, b = round(w[s] * 2 * total), 0
        while b * tokens[s] < part:
            at = 0
            for i in sorted((i for i in ids if size[i]), key=lambda i: hashlib.md5(f"mix|{b}|{i}".encode()).hexdigest()):
                if at < min(tokens[s], part - b * tokens[s]):
                    want.append((i, b, at))
                at += size[i]
            b += 1
    assert sorted((r["doc_id"], r["block"], r["offset"]) for r in out) == sorted(want)
    worst = {"a": 900, "b": 90, "c": 10}
    e = mixing.find_exponent(worst, 1000, None, 3.0)
    assert max(v * 1000 / worst[s] for s, v in mixing.weights_at({s: n / 1000 for s, n in worst.items()}, e).items()) <= 3.0 + 1e-6
    assert mixing.mix_sources(empty).count() == 0


def test_license_scan(spark, empty):
    filler = "word " * 30
    data = [
        ("p/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("p/a/b/x.txt", filler),
        ("p/a/b/c/y.txt", filler + "\nReleased under the MIT License.\n" + filler),
        ("p/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        ("p/d/z.txt", filler),
        ("q/z.txt", "the license of poetry is broad"),
        ("q/n.txt", None),
        (None, filler),
    ]
    docs = spark.createDataFrame([(i, t, p, "clash") for i, (p, t) in enumerate(data)], "doc_id bigint, text string, path string, license string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.scan(docs).collect()}
    assert got == {
        0: ("Apache-2.0", "Apache-2.0", None), 1: (None, "Apache-2.0", "p/a"), 2: ("MIT", "MIT", None), 3: ("GPL-3.0-only", "GPL-3.0-only", None),
        4: (None, "GPL-3.0-only", "p"), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None),
    }
    assert license_scan.scan(license_scan.placed(empty)).count() == 0


def test_html_rendering(spark):
    r = html_render.render
    assert r(None) == r("") == ""
    assert r("<ul><li>a<li>b<ol start=3><li>x</ol></ul>") == "- a\n- b\n  3. x"
    assert r("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>after") == "a    | bbb\ncccc | d\n\nafter"
    assert r("<p>one<p>two &amp; three<br>four") == "one\n\ntwo & three\nfour"
    assert r("<div hidden>no</div><script>x<b></script><style>y</style><p style='display: none'>z</p>yes<!-- c -->") == "yes"
    assert r("<pre>a\n  b</pre>c <b> d </b>e") == "a\n  b\n\nc d e"
    assert r("1 < 2 <b>unclosed") == "1 < 2 unclosed"
    assert r("<p>" * 2000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None)], "page_id bigint, url string, html string")
    assert [(x["page_id"], x["text"], x["n_lines"]) for x in html_render.extract_text(pages).orderBy("page_id").collect()] == [(1, "a", 1), (2, "", 0)]
