"""The pipeline against a brute-force version of its five stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from portica.llm import mixing

from .test_text_operators import SCHEMA, bench_words, brute_repeats, corpus, lower_words


def passes_rules(text):
    raw = (text or "").encode()
    w = raw.split()
    n = len(w)
    grams = Counter(tuple(w[j : j + 8]) for j in range(n - 7))
    repeated = len({j + k for j in range(n - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(8)})
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    chars = sum(len(x.decode()) for x in w)
    count = lambda s: sum(c in s for c in text or "")
    return not (
        n < 20 or 100 * repeated > 30 * n or 10 * count("#*$%&|<>") > n or (again >= 3 and 100 * again > 30 * len(lines))
        or 10 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 4 * chars or 10 * count("!") > n or chars < 2 * n or chars > 15 * n
    )


def brute(rows, items):
    rows = [r for r in rows if passes_rules(r[1])]
    sets = {r[0]: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for r in rows for w in [lower_words(r[1])]}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    rows = [r for r in rows if low[r[0]] == r[0]]
    kept = brute_repeats(rows)
    rows = [(r[0], kept[r[0]][4].decode(errors="ignore"), *r[2:]) for r in rows]
    grams = set()
    for _, t in items:
        w = bench_words(t)
        k = min(len(w), 10)
        grams |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    has = lambda w: any(tuple(w[j : j + k]) in grams for k in {len(g) for g in grams} for j in range(len(w) - k + 1))
    rows = [r for r in rows if not has(bench_words(r[1]))]
    size = {r[0]: len(r[1].encode().split()) for r in rows}
    tokens = {}
    for r in rows:
        if size[r[0]]:
            tokens[r[3] or ""] = tokens.get(r[3] or "", 0) + size[r[0]]
    total = sum(tokens.values())
    w = mixing.weights_at({s: n / total for s, n in tokens.items()}, mixing.find_exponent(tokens, total, 0.95, 4.0))
    out = []
    for s, n in tokens.items():
        part, b = round(w[s] * total), 0
        while b * n < part:
            at = 0
            for i in sorted((r[0] for r in rows if (r[3] or "") == s and size[r[0]]), key=lambda i: hashlib.md5(f"mix|{b}|{i}".encode()).hexdigest()):
                if at < min(n, part - b * n):
                    out.append((i, s, size[i], b, at))
                at += size[i]
            b += 1
    return sorted(out)


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus(seed=4, n=80)
    items = [(1, rows[9][1][:120]), (2, " ".join(rows[12][1].split()[1:14]))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["source"], r["n_tokens"], r["block"], r["offset"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows, items) and len(got) > 20


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([r for r in corpus(seed=1, n=30)], SCHEMA)
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.where("1 = 0")
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
