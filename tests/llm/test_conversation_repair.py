"""Conversation repair against all edit sequences, and the search of nodes against plain strings."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from portica.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0d]")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        rule = zlib.crc32(name.encode()) % 20
        out[conv]
        if rule:
            row = (turn, "user" if rule == 4 else role, "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text)
            out[conv] += [row] * (2 if rule == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def plain(rows):
    """The result of one conversation's rows after damage, by a search over (cost, audit) in order."""
    seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        symbols.append(fault)
        if fault:
            counts[fault] += 1
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # Dijkstra over (place, initials so far as state): entries leave the heap by cost, then audit.
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, closed = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        for role in ("user", "assistant"):
            if (to := follow.get((state, role[0]))) is not None:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if symbols[i] not in ("blank", "duplicate"):
                extra = 3 * (symbols[i] == "truncated")
                if (to := follow.get((state, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := follow.get((state, new[0]))) is not None:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, to, (*out, f"{new}:{text}")))
    raise AssertionError


def conversation(rng, n):
    texts = ["Hello there.", "What now?", "no end", "", " \n", "Yes!", "é fin.", "a. b", "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "used"]
    return [(rng.choice([i, i, i, i + 1, None]), rng.choice(roles), rng.choice([*texts, None, f"Line {i}.", f"Open {i}"])) for i in range(n)]


def rows_of(seed, sizes):
    rng = random.Random(seed)
    return [(c if c % 17 else None, *r) for c, n in enumerate(sizes) for r in conversation(rng, n)]


def check(spark, rows, n):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("later", F.lit(1)).repartition(n)
    got = cr.repair(docs)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {c: plain(v) for c, v in damage(rows).items()}
    found = got.collect()
    assert len(found) == len(want) and {r[0]: tuple(r[1:]) for r in found} == want
    return want


def test_many_conversations(spark):
    want = check(spark, rows_of(1, [random.Random(i).randint(1, 12) for i in range(400)]), 3)
    assert {"D", "I", "K", "R"} == set("".join(v[6] for v in want.values()))


def test_long_conversation_in_many_tasks(spark):
    rng = random.Random(9)
    rows = [(1, *r) for r in conversation(rng, 2500)] + [(None, 3, "user", "Same.")] * 40 + rows_of(3, [3] * 30) + [(1, 7, "user", "Again and again.")] * 300
    check(spark, rows, 4)


def test_empty_and_lost(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(empty).count() == 0
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (r,) = cr.repair(spark.createDataFrame([(5, lost, "user", "x.")], SCHEMA)).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_stretches_agree(seed, monkeypatch):
    rng = random.Random(seed)
    symbols = "".join(rng.choice("suaoSUAOxuaua") for _ in range(300))
    whole = [cr._search(symbols, q) for q in range(4)]
    monkeypatch.setattr(cr, "SPAN", 37)
    assert [cr.Stretches().table(symbols, q) for q in range(4)] == whole


def test_nodes_are_strings(monkeypatch):
    monkeypatch.setattr(cr, "_MODULUS", 61)  # collisions all over
    rng, audits = random.Random(2), cr.Audits()
    nodes = {"": 0}
    for _ in range(900):
        base = rng.choice(list(nodes))
        letter = rng.choice("DIKR")
        nodes[base + letter] = audits.child(nodes[base], letter)
    assert len(set(nodes.values())) == len(nodes) and all(audits.text(n) == s for s, n in nodes.items())
    some = rng.sample(sorted(nodes), 120)
    for a in some:
        for b in some:
            x, y = rng.choice("DIKR"), rng.choice("DIKR")
            assert audits.less((nodes[a], x), (nodes[b], y)) == (a + x < b + y)
