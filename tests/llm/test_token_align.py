"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from portica.llm import token_align

FOLDER = token_align.TOKENIZERS


def plain(texts):
    """Measures by text, straight from the definition."""
    both = token_align.load(FOLDER)
    out, held, links_of = [], Counter(), []
    for t in texts:
        ids = both.a.encode(" " + t, add_special_tokens=False).ids if t else []
        pieces = both.b.encode(t) if t else []
        a, b = [both.bytes_a[i] for i in ids], [both.bytes_b[i] for i in pieces]
        if not t or b"".join(a) != b" " + t.encode() or b"".join(b) != b" " + t.encode():
            out.append((0, 0, 0, 0, ""))
            links_of.append([])
            continue
        ea, eb = list(accumulate(map(len, a))), list(accumulate(map(len, b)))
        cuts = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for c in cuts:
            up_to, down_to = ea.index(c, i) + 1, eb.index(c, j) + 1
            ga, gb, i, j = ids[i:up_to], pieces[j:down_to], up_to, down_to
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links += [(x, y) for x in ga for y in gb]
        held.update(set(links))
        out.append((len(ids), len(pieces), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links_of.append(links)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return [(*m[:4], sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), m[4]) for m, links in zip(out, links_of, strict=True)]


TEXTS = [
    "The quick brown fox.", "The quick brown fox.", None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "Étage ça où für Straße", "日本語テキスト 🙂", "▁ mark", "<s> </s> <|endoftext|> <0x41>",
    "aaaa" * 400, "=" * 3000, "x" * 700 + " é" * 500, "ﬁ ½ ①", "\x00 null byte", "don't we'll I'm",
]


def test_against_definition(spark, monkeypatch):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    want = Counter(zip((r[0] for r in rows), plain(TEXTS), strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("x")).withColumn("copies", F.lit(None).cast("int")).repartition(3)
    got = token_align.align_tokens(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((r[0], tuple(r[1:])) for r in got.collect()) == want
    assert token_align.align_tokens(docs.where("false")).count() == 0
    assert token_align.align_tokens(docs.where("text = ''")).first()["n_links"] == 0


def test_large_groups_and_parts(monkeypatch):
    both = token_align.load(FOLDER)
    assert both.in_parts
    long_text = ("Some words, and 12 numbers — naïve. \n" * 60 + "a  b   c　d ▁ e " * 20).strip()
    whole = token_align.align(both, [long_text.encode(), b"=" * 3000])
    monkeypatch.setattr(token_align, "PART", 50)
    monkeypatch.setattr(token_align, "LARGE_GROUP", 1)
    parts = token_align.align(both, [long_text.encode(), b"=" * 3000])
    assert len(both.parts(long_text)) > 20
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))


def test_bytes_that_are_no_text():
    table, digests, links = token_align.align(token_align.load(FOLDER), [b"\xff\xfe", b"fine"])
    assert table[0].tolist() == [0, 0, 0, 0] and table[1, 0] == 1 and links[0].tolist() == [1] and not digests[0].any()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    from portica.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r[0] for r in docs), plain([r[1] for r in docs]), strict=True))
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op12_token_align"](spark, sf).collect()}
    assert got == want
