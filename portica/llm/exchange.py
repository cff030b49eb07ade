"""Packed exchanges: many small values travel between tasks as a few binary rows.

A task sorts what it has by target partition and sends one row (`part`, `payload`) per target, so a
shuffle of hashes costs their bytes rather than a Spark row each.  Spark still does the partitioning,
the shuffle and the recovery; a payload is a list of arrays whose dtypes both ends know.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import saved, shared_folder

__all__ = ["Sender", "deal", "from_six", "hashable", "pack", "read_all", "rows", "saved", "shared_folder", "six", "targets", "unpack"]

SCHEMA = "part int, payload binary"
ARROW = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
FLUSH_BYTES = 12 << 20


def targets(spark: SparkSession) -> int:
    """How many partitions a packed exchange deals out to: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, n: int) -> DataFrame:
    return df.repartitionById(n, df["part"])


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.size for a in arrays], dtype=np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(payload: bytes, *dtypes) -> list[np.ndarray]:
    sizes = np.frombuffer(payload, dtype=np.int64, count=len(dtypes))
    at, out = 8 * len(dtypes), []
    for size, kind in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(payload, dtype=kind, count=int(size), offset=at))
        at += int(size) * np.dtype(kind).itemsize
    return out


def rows(parts: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], schema=ARROW)


def six(h: np.ndarray) -> np.ndarray:
    """The low 48 bits of hashes as bytes."""
    return np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)


def from_six(b: np.ndarray) -> np.ndarray:
    out = np.zeros((b.size // 6, 8), dtype=np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


class Sender:
    """Gathers arrays by target and gives packed rows.

    Each add() holds entries grouped by an owner: `target` and `owner` (rising) by entry, columns by
    entry, and columns by owner.  A payload holds the owner columns (once per owner and target), the
    number of entries of each, then the entry columns.
    """

    def __init__(self, n: int):
        self.n, self.held, self.size = n, [], 0

    def add(self, target: np.ndarray, owner: np.ndarray, entry: list[np.ndarray], by_owner: list[np.ndarray]):
        self.held.append((target.astype(np.int32), owner.astype(np.int64), entry, by_owner))
        self.size += sum(a.nbytes for a in entry) + target.size * 12

    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def flush(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        base, owners = 0, []
        for _, owner, _, by_owner in self.held:
            owners.append(owner + base)
            base += by_owner[0].size
        target, owner = np.concatenate([h[0] for h in self.held]), np.concatenate(owners)
        entry = [np.concatenate(c) for c in zip(*(h[2] for h in self.held), strict=True)]
        by_owner = [np.concatenate(c) for c in zip(*(h[3] for h in self.held), strict=True)]
        self.held, self.size = [], 0
        if not target.size:
            return None
        order = np.argsort(target, kind="stable")
        target, owner, entry = target[order], owner[order], [c[order] for c in entry]
        cuts = np.flatnonzero(np.diff(target)) + 1
        begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [target.size]))
        parts, payloads = [], []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            own = owner[a:b]
            heads = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
            count = np.diff(np.concatenate((heads, [b - a]))).astype(np.uint32)
            parts.append(int(target[a]))
            payloads.append(pack(*(c[own[heads]] for c in by_owner), count, *(c[a:b] for c in entry)))
        return rows(parts, payloads)


def read_all(batches, owner_kinds: list, entry_kinds: list) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """All payloads of a partition: owner columns, counts and entry columns, each concatenated."""
    got = [unpack(p, *owner_kinds, np.uint32, *entry_kinds) for batch in batches for p in batch.column("payload").to_pylist() if p is not None]
    k = len(owner_kinds)
    if not got:
        return [np.empty(0, t) for t in owner_kinds], np.empty(0, np.uint32), [np.empty(0, t) for t in entry_kinds]
    cols = [np.concatenate(c) for c in zip(*got, strict=True)]
    return cols[:k], cols[k], cols[k + 1 :]


def hashable(df: DataFrame, name: str) -> Column:
    """A column in a form that Spark can hash: maps as JSON."""
    return F.to_json(F.struct(df[name])) if "map<" in df.schema[name].dataType.simpleString() else df[name]
