"""Conversation structure repair: the cheapest edits that make roles alternate, by a persistent audit DP.

Rows of a conversation are read in order; the DP keeps, for each state of the role pattern `(s?(ua)+)?`, the cheapest
edits that lead there and, of equally cheap ones, the ASCII-least audit. Audits are linked nodes that share their
prefixes: a node has its letter, its parent, its ancestors 2^k steps up and a rolling hash. Nodes are found by
their hash and checked for parent and letter, so equal audits are one node and a collision of hashes is no
error; ties are decided by a search for the longest common prefix along the ancestors.

Conversations are sorted by ranges of (conversation, turn), so one that holds a third of all rows lies in many
tasks. What a task holds of it is a *stretch*: for each state at its begin and end the cheapest edits. Stretches
are joined in order, where an audit is a chain of pieces; the states found go back to the stretches, which give
their repaired rows. Conversations that lie in one task, nearly all, need no second look.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from . import exchange
from .exchange import saved

KEEP, INSERT, REROLE, DELETE, CUT = 0, 3, 3, 4, 3
#: States of the pattern: nothing yet, after s, after u, after a. Where an initial, or an inserted or changed role, leads.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {b"s": {START: SYSTEM}, b"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, b"a": {USER: ASSISTANT}}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
#: Rows of a stretch that are searched at once, and how many results of short stretches a task remembers, of how many rows.
SPAN, REMEMBERED, SHORT = 4096, 100_000, 48
#: Bytes of repaired rows that travel together.
PIECE = 1 << 20
_MODULUS = (1 << 61) - 1
_BASE = 0x1B873593_CC9E2D51 % _MODULUS
_BOTTOM, _TOP = -(1 << 63), (1 << 63) - 1


class Audits:
    """Audit strings as nodes of a tree; node 0 is the empty one."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up, self.found = [""], [0], [1], [[0]], {}

    def child(self, node: int, letter: str) -> int:
        """The node of the audit with one more letter."""
        h = (self.hash[node] * _BASE + ord(letter)) % _MODULUS
        alike = self.found.setdefault(h, [])
        for known in alike:
            if self.up[known][0] == node and self.letter[known] == letter:
                return known  # else another audit of the same hash
        new = len(self.letter)
        alike.append(new)
        up, k = [node], 0
        while up[-1] and k < len(self.up[up[-1]]):
            up.append(self.up[up[-1]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(h)
        self.up.append(up)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        while (rise := self.depth[node] - depth) > 0:
            node = self.up[node][min(rise.bit_length(), len(self.up[node])) - 1]
        return node

    def _before(self, a: int, b: int) -> bool:
        """Whether the audit of a is less than that of b, another node of the same depth."""
        while self.up[a][0] != self.up[b][0]:
            for k in range(min(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
                # Longest common prefix: rise as far as the prefixes differ.
                x, y = self.up[a][k], self.up[b][k]
                if self.hash[x] != self.hash[y] or x != y:
                    a, b = x, y
                    break
        return self.letter[a] < self.letter[b]

    def less(self, a: tuple[int, str], b: tuple[int, str]) -> bool:
        """Whether one audit and letter is less than another; a proper prefix is less."""
        (node, letter), (other, another) = a, b
        if node == other:
            return letter < another
        if self.depth[node] == self.depth[other]:
            return self._before(node, other)
        if self.depth[node] > self.depth[other]:
            return not self.less(b, a)
        at = self.ancestor(other, self.depth[node])
        if at != node:
            return self._before(node, at)
        following = self.letter[self.ancestor(other, self.depth[node] + 1)]
        return letter <= following

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def moves(symbol: str, state: int):
    """(letter, cost, next state) of what may be done with a row: x must go, capitals are cut short."""
    yield "D", DELETE, state
    if symbol != "x":
        extra = CUT if symbol.isupper() else 0
        if state in (kept := KEPT.get(symbol.lower().encode(), {})):
            yield "K", KEEP + extra, kept[state]
        yield "R", REROLE + extra, TURN[state]


def _search(symbols: str, state: int) -> list[tuple[int, str] | None]:
    """By end state, the cheapest and then least edits of a stretch that begins in a state."""
    audits = Audits()

    def better(table: list, at: int, cost: int, node: int, letter: str) -> None:
        held = table[at]
        if held is None or cost < held[0] or (cost == held[0] and audits.less((node, letter), held[1:])):
            table[at] = (cost, node, letter)

    def grown(table: list) -> list:
        """Nodes of what was chosen, and what insertions reach from there."""
        out = [t and (t[0], audits.child(t[1], t[2])) for t in table]
        for origins, to in (((START, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
            chosen = [None]
            if out[to]:
                cost, node = out[to]
                chosen = [(cost, audits.up[node][0], audits.letter[node])]
            for q in origins:
                if out[q] and not (to == USER and q == to):
                    better(chosen, 0, out[q][0] + INSERT, out[q][1], "I")
            if chosen[0]:
                out[to] = (chosen[0][0], audits.child(chosen[0][1], chosen[0][2]))
        return out

    now: list = [None] * 4
    now[state] = (0, 0)
    first = [None if t is None else t for t in now]
    # Insertions before the first row: the empty audit has no last letter, so the states are filled by hand.
    if state == USER:
        first[ASSISTANT] = (INSERT, audits.child(0, "I"))
    else:
        first[USER] = (INSERT, audits.child(0, "I"))
        if state != ASSISTANT:
            first[ASSISTANT] = (2 * INSERT, audits.child(first[USER][1], "I"))
    now = first
    for symbol in symbols:
        table: list = [None] * 4
        for q, held in enumerate(now):
            if held:
                for letter, cost, to in moves(symbol, q):
                    better(table, to, held[0] + cost, held[1], letter)
        now = grown(table)
    return [t and (t[0], audits.text(t[1])) for t in now]


class Chain:
    """An audit as pieces, one for each stretch so far; chains of as many pieces share what they have in common."""

    __slots__ = ("piece", "states", "up")

    def __init__(self, up: Chain | None, piece: str, states: tuple[int, int]):
        self.up, self.piece, self.states = up, piece, states

    def less(self, other: Chain) -> bool:
        mine, theirs, a, b = [], [], self, other
        while a is not b:
            mine.append(a.piece)
            theirs.append(b.piece)
            a, b = a.up, b.up
        return "".join(reversed(mine)) < "".join(reversed(theirs))

    def links(self) -> list[Chain]:
        out, at = [], self
        while at:
            out.append(at)
            at = at.up
        return out[::-1]


def _followed(held: list, tables: dict[int, list]) -> list:
    """(cost, chain) by state after one more stretch, whose tables are by its begin state."""
    out: list = [None] * 4
    for q, before in enumerate(held):
        for to, step in enumerate(tables.get(q) or [None] * 4) if before else ():
            if step:
                cost, chain = before[0] + step[0], Chain(before[1], step[1], (q, to))
                if out[to] is None or cost < out[to][0] or (cost == out[to][0] and chain.less(out[to][1])):
                    out[to] = (cost, chain)
    return out


class Stretches:
    """Searches stretches of any length; what short ones give is remembered."""

    def __init__(self):
        self.known: dict[tuple[str, int], list] = {}

    def table(self, symbols: str, state: int) -> list:
        """By end state (cost, audit) or None."""
        if len(symbols) > SPAN:
            held: list = [None] * 4
            held[state] = (0, None)
            for at in range(0, len(symbols), SPAN):
                held = _followed(held, {q: self.table(symbols[at : at + SPAN], q) for q in range(4) if held[q]})
            return [t and (t[0], "".join(c.piece for c in t[1].links())) for t in held]
        if len(symbols) > SHORT:
            return _search(symbols, state)
        if (got := self.known.get((symbols, state))) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[symbols, state] = _search(symbols, state)
        return got


def least(held: list):
    """The better of the states in which a conversation may end; entries are (cost, audit) or (cost, chain)."""
    a, b = held[START], held[ASSISTANT]
    if a is None or b is None or a[0] != b[0]:
        return min((t for t in (a, b) if t), key=lambda t: t[0])
    first = a[1] < b[1] if isinstance(a[1], str) else a[1].less(b[1])
    return a if first else b


def repaired(rows: list[tuple[bytes, bytes, int]], audit: str, state: int = START):
    """The rows `role:text` that an audit leaves; rows are (role, text, copies)."""
    at = left = 0
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            yield ROLES[state] + b":"
            continue
        if not left:
            left = rows[at][2]
            at += 1
        left -= 1
        role, text, _ = rows[at - 1]
        if letter == "K":
            state = KEPT[role[:1]][state]
            yield role + b":" + text
        elif letter == "R":
            state = TURN[state]
            yield ROLES[state] + b":" + text


class Tally:
    """Counts and symbols of the rows of one stretch, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.symbols: list[str] = []
        self.low = self.high = self.first = self.last = None
        self.seen: set[tuple[bytes, bytes]] = set()

    def add(self, turn: int | None, role: bytes, text: bytes, copies: int, later: bool | None) -> None:
        """`later` says whether role and text came before; None: look at the rows of this tally."""
        if turn is not None:
            self.turns += turn != self.high  # turns rise
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in (b"su", b"ua", b"au")
        self.illegal += copies - 1
        self.last = initial
        body = text.rstrip()
        if not body:
            self.blank += copies
            self.symbols.append("x" * copies)
            return
        if later is None:
            later = (role, text) in self.seen
            self.seen.add((role, text))
        cut = body[-1:] not in (b".", b"!", b"?")
        self.duplicate += copies - 1 + later
        self.truncated += cut and not later
        symbol = initial.decode() if initial in KEPT else "o"
        self.symbols.append(("x" if later else symbol.upper() if cut else symbol) + "x" * (copies - 1))

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _TOP)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies): the rows after damage by checksum; equal rows are one with their number."""
    or_space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(or_space(conv), F.lit(":"), or_space(turn))) % 20
    rows = conversations.select(conversations[conv].alias("conv"), conversations[turn].cast("bigint").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"), draw.alias("draw"))
    rows = rows.where("draw <> 0").select(
        "conv", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by ranges; a conversation of many rows lies in many partitions. Ranges look at beginnings of texts only."""
    n = exchange.targets(rows.sparkSession)
    dealt = rows.repartitionByRange(n, "conv", "turn", F.left("role", F.lit(8)), F.left("text", F.lit(32)))
    return dealt.sortWithinPartitions("conv", "turn", "role", "text")


def _entries(batches, extra: tuple[str, ...] = ()):
    """(conv, turn, role, text, copies, ...) of each row, texts as bytes."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", *extra)]
        yield from zip(*columns, strict=True)


def _bytes(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("conv", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "copies", *extra)


def _whole(rows: DataFrame, kind: DataType) -> DataFrame:
    """A result for what each task holds of a conversation; `edge` if it is the first or last of its task."""

    def run(batches):
        stretches, out = Stretches(), []

        def close(conv, tally, held, edge):
            cost, audit = least(stretches.table("".join(tally.symbols), START))
            sha = hashlib.sha256(b"\n".join(repaired(held, audit))).hexdigest()
            out.append((conv, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, sha, edge))

        def batch():
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], arrow_kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string()), pa.array(columns[9], pa.bool_())]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv", *_COUNTS, "audit", "repaired_sha256", "edge"])

        conv, tally, held, first, arrow_kind = None, None, [], True, None

        def kept(batches):
            nonlocal arrow_kind
            for b in batches:
                arrow_kind = b.schema.field("conv").type
                yield b

        for c, turn, role, text, copies in _entries(kept(batches)):
            if tally is None or c != conv:
                if tally is not None:
                    close(conv, tally, held, first)
                    first = False
                conv, tally, held = c, Tally(), []
                if len(out) >= 5000:
                    yield batch()
            tally.add(turn, role, text, copies, None)
            held.append((role, text, copies))
        if tally is not None:
            close(conv, tally, held, True)
            yield batch()

    return _bytes(rows).mapInArrow(run, f"conv {kind.simpleString()}, {_RESULT}, edge boolean")


def _segments(rows: DataFrame, kind: DataType) -> DataFrame:
    """(conv, part, summary): counts of each stretch and its cheapest edits by begin and end state."""

    def run(batches):
        stretches, part = Stretches(), TaskContext.get().partitionId()

        def row(conv, tally, arrow_kind):
            symbols = "".join(tally.symbols)
            text = lambda b: None if b is None else b.hex()
            summary = {
                "counts": [tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.turns], "turns": [tally.low, tally.high],
                "initials": [text(tally.first), text(tally.last)], "tables": [stretches.table(symbols, q) for q in range(4)],
            }
            return pa.RecordBatch.from_arrays([pa.array([conv], arrow_kind), pa.array([part], pa.int32()), pa.array([json.dumps(summary)])], names=["conv", "part", "summary"])

        conv, tally, arrow_kind = None, None, None
        for batch in batches:
            arrow_kind = batch.schema.field("conv").type
            for c, turn, role, text, copies, later in _entries([batch], ("later",)):
                if tally is None or c != conv:
                    if tally is not None:
                        yield row(conv, tally, arrow_kind)
                    conv, tally = c, Tally()
                tally.add(turn, role, text, copies, later)
        if tally is not None:
            yield row(conv, tally, arrow_kind)

    return _bytes(rows, "later").mapInArrow(run, f"conv {kind.simpleString()}, part int, summary string")


def _joined(segments: DataFrame, kind: DataType) -> DataFrame:
    """The stretches of each conversation put together: a row for each with its states, the first with the results."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        parts = table.column("part").to_numpy()[order]
        summaries = [json.loads(table.column("summary")[int(i)].as_py()) for i in order]
        held: list = [(0, None), None, None, None]
        counts, low, high, last = np.zeros(5, dtype=np.int64), None, None, None
        for s in summaries:
            held = _followed(held, dict(enumerate(s["tables"])))
            counts += s["counts"]
            (begin, end), (initial, final) = s["turns"], s["initials"]
            if last is not None and bytes.fromhex(last + initial) not in (b"su", b"ua", b"au"):
                counts[3] += 1
            if begin is not None:
                counts[4] -= begin == high  # a turn on both sides of a cut
                low, high = begin if low is None else low, end
            last = final
        cost, chain = least(held)
        links, n = chain.links(), len(parts)
        gaps = 0 if low is None else min(high - low + 1 - int(counts[4]), _TOP)
        result = [gaps, *counts[:4].tolist(), cost, "".join(c.piece for c in links)]
        return pa.table(
            {
                "conv": pa.chunked_array([table.column("conv").combine_chunks().take(pa.array(order))]), "part": pa.array(parts, pa.int32()),
                "enter": pa.array([c.states[0] for c in links], pa.int32()), "leave": pa.array([c.states[1] for c in links], pa.int32()),
                **{name: pa.array([v] + [None] * (n - 1), pa.string() if name == "audit" else pa.int64()) for name, v in zip((*_COUNTS, "audit"), result, strict=True)},
            }
        )

    schema = f"conv {kind.simpleString()}, part int, enter int, leave int, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string"
    return segments.groupBy("conv").applyInArrow(run, schema)


def _pieces(rows: DataFrame, kind: DataType) -> DataFrame:
    """(conv, place, piece): the repaired rows of each stretch, in pieces of about PIECE bytes; rows end with a newline."""

    def run(batches):
        stretches, part, number = Stretches(), TaskContext.get().partitionId() << 32, 0

        def given(conv, tally, held, enter, leave, arrow_kind):
            nonlocal number
            audit = stretches.table("".join(tally.symbols), enter)[leave][1]
            lines, size = [], 0
            for line in repaired(held, audit, enter):
                lines.append(line)
                size += len(line)
                if size >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array([conv], arrow_kind), pa.array([part + number]), pa.array([b"\n".join(lines) + b"\n"])], names=["conv", "place", "piece"])
                    lines, size, number = [], 0, number + 1
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([conv], arrow_kind), pa.array([part + number]), pa.array([b"\n".join(lines) + b"\n"])], names=["conv", "place", "piece"])
                number += 1

        conv, tally, held, states, arrow_kind = None, None, [], (0, 0), None
        for batch in batches:
            arrow_kind = batch.schema.field("conv").type
            for c, turn, role, text, copies, later, enter, leave in _entries([batch], ("later", "enter", "leave")):
                if tally is None or c != conv:
                    if tally is not None:
                        yield from given(conv, tally, held, *states, arrow_kind)
                    conv, tally, held, states = c, Tally(), [], (enter, leave)
                tally.add(turn, role, text, copies, later)
                held.append((role, text, copies))
        if tally is not None:
            yield from given(conv, tally, held, *states, arrow_kind)

    return _bytes(rows, "later", "enter", "leave").mapInArrow(run, f"conv {kind.simpleString()}, place bigint, piece binary")


def _digests(pieces: DataFrame, kind: DataType) -> DataFrame:
    """(conv, repaired_sha256): a digest is one pass in order, so a conversation's pieces stream through one task, one at a time."""

    def run(batches):
        conv, sha, arrow_kind, some = None, None, None, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([conv], arrow_kind), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])

        for batch in batches:
            arrow_kind = batch.schema.field("conv").type
            for i in range(batch.num_rows):
                c, piece = batch.column("conv")[i].as_py(), batch.column("piece")[i].as_py()
                if sha is None or c != conv:
                    if sha is not None:
                        yield row()
                    conv, sha, some = c, hashlib.sha256(), False
                sha.update((b"\n" if some else b"") + piece[:-1])
                some = True
        if sha is not None:
            yield row()

    ordered = pieces.repartition(exchange.targets(pieces.sparkSession), "conv").sortWithinPartitions("conv", "place")
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")


def _split(rows: DataFrame, kind: DataType) -> DataFrame:
    """Results of conversations that lie in several partitions."""
    held = saved(_in_order(rows).withColumn("at", F.monotonically_increasing_id()).withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    first = held.groupBy("conv", "same").agg(F.min("at").alias("earliest")).select(F.col("conv").alias("of"), F.col("same").alias("like"), "earliest")
    flagged = held.join(first, held["conv"].eqNullSafe(first["of"]) & (held["same"] == first["like"])).withColumn("later", F.col("at") > F.col("earliest"))
    ranged = saved(flagged.select("conv", "turn", "role", "text", "copies", "at", "later").repartitionByRange(exchange.targets(rows.sparkSession), "at").sortWithinPartitions("at"))
    joined = saved(_joined(_segments(ranged, kind), kind))
    states = joined.select(F.col("conv").alias("of"), F.col("part").alias("in_part"), "enter", "leave")  # two rows a partition at most, and one a conversation
    placed = ranged.withColumn("part", F.spark_partition_id())
    met = placed.join(F.broadcast(states), placed["conv"].eqNullSafe(states["of"]) & (placed["part"] == states["in_part"]))
    digests = _digests(_pieces(met, kind), kind).withColumnRenamed("conv", "of")
    results = joined.where("cost IS NOT NULL").drop("part", "enter", "leave")
    done = results.join(digests, results["conv"].eqNullSafe(digests["of"]), "left")
    return done.select("conv", *_COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256"))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation.

    Rows are first damaged by the checksum of `conv:turn`. Null roles, texts and turns count as one space there; a
    null conversation is one of its own, a null turn comes first and counts in no gap. Rows of one turn are taken
    by role, then text; repeated rows all count, so one is kept and the others are duplicates. An empty role has no
    initial and is illegal beside any other. Gaps are at most the largest long. A conversation that loses all its
    rows has zeros, no audit and the digest of nothing; an empty table gives no rows. Other columns are not read.
    The audit and digest of a conversation are single values, so one of billions of rows needs the memory of its
    audit, about a byte a row and pair of states, where its stretches are joined.
    """
    kind = conversations.schema[conv_col].dataType
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    whole = saved(_whole(_in_order(rows), kind))
    cut = saved(whole.where("edge").groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("of")))
    results = whole.drop("edge")
    if not cut.isEmpty():
        few = F.broadcast(cut)  # one for each border of two partitions at most
        is_cut = lambda df: df["conv"].eqNullSafe(cut["of"])
        again = _split(rows.join(few, is_cut(rows), "left_semi"), kind)
        results = results.join(few, is_cut(results), "left_anti").union(again.select(*results.columns))
    every = conversations.select(conversations[conv_col].alias("id")).distinct()
    out = every.join(results, every["id"].eqNullSafe(results["conv"]), "left")
    return out.select(F.col("id").alias(conv_col), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY_SHA)).alias("repaired_sha256"))
