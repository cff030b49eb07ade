"""Products of long panels by blocks: units of some times and two blocks of assets, with numpy products inside.

A panel row goes once to each unit of its block of assets, so N assets cost N / ASSETS copies of the panel where a
join of the panel with itself costs N / 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Assets and times in a block; rows that a task takes at once, about.
ASSETS, TIMES, ROWS = 512, 512, 1 << 17

Power = tuple[str, int]


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(per_key, keys) if keys else rows.crossJoin(per_key)


def _runs(*names: np.ndarray) -> np.ndarray:
    """Where a run of equal names begins, and the end."""
    new = np.zeros(names[0].size, dtype=bool)
    new[:1] = True
    for x in names:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), names[0].size)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, rank of each number in the order of values)."""
    coded = column.combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(rank.size)
    return coded.indices.to_numpy(), rank


def _whole_units(batches, end):
    """Tables of whole units from batches sorted by (_u, _v)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begin = int(_runs(table["_u"].to_numpy(), table["_v"].to_numpy())[-2])
        if begin:
            yield from end(table.slice(0, begin))
        held, size = table.slice(begin).to_batches(), table.num_rows - begin
    if size:
        yield from end(pa.Table.from_batches(held).combine_chunks())


def pair_sums(panel: DataFrame, keys: list[str], columns: list[str], products: dict[str, tuple[Power, Power]]) -> DataFrame:
    """(keys.., a, b, n, a sum for each product) for pairs a <= b of assets that have a common t.

    `panel(keys.., t, asset, columns..)` has no nulls in columns and one row at most for (keys, t, asset). A product
    takes a power of a column on a's side and one on b's side, and sums over their common t; n counts those.
    """
    sizes = panel.groupBy(*keys, "asset").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.ceil(F.count("*") / ASSETS).alias("_blocks"), F.ceil(F.max("_n") / TIMES).alias("_spans"))
    dealt = attach(panel.select(*keys, "t", "asset", *[F.col(c).cast("double").alias(c) for c in columns]), sizes, keys)
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("asset"), F.col("_blocks"))).withColumn("_span", F.pmod(F.xxhash64("t"), F.col("_spans")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    unit = [*keys, F.least("_block", "_other"), F.greatest("_block", "_other"), F.col("_span")]
    side = F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1)
    rows = dealt.select(*keys, "t", "asset", *columns, side.alias("_side"), F.xxhash64(*unit).alias("_u"), F.xxhash64(F.lit("v"), *unit).alias("_v"))
    powers = {p for pair in products.values() for p in pair}

    def products_of(table: pa.Table):
        times, _ = _codes(table["t"])
        assets, rank = _codes(table["asset"])
        side, values = table["_side"].to_numpy(), {c: table[c].to_numpy() for c in columns}
        cuts = _runs(table["_u"].to_numpy(), table["_v"].to_numpy())
        at_a, at_b, sums = [], [], {name: [] for name in ("n", *products)}
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            _, time = np.unique(times[s:e], return_inverse=True)
            n_times, halves = int(time.max()) + 1, []
            for use in (np.flatnonzero(side[s:e] != 1), np.flatnonzero(side[s:e] != 0)):
                _, first, column = np.unique(assets[s:e][use], return_index=True, return_inverse=True)
                dense = {}
                for c, p in powers | {(columns[0], 0)}:
                    m = dense[c, p] = np.zeros((n_times, first.size))
                    m[time[use], column] = values[c][s:e][use] ** p
                halves.append((s + use[first], dense))
            (left, dl), (right, dr) = halves
            n = dl[columns[0], 0].T @ dr[columns[0], 0]
            rising = rank[assets[left]][:, None] <= rank[assets[right]][None, :]
            within = bool(side[s] == 2)
            i, j = np.nonzero((n > 0) & rising if within else n > 0)
            turned = ~rising[i, j]
            at_a.append(np.where(turned, right[j], left[i]))
            at_b.append(np.where(turned, left[i], right[j]))
            sums["n"].append(n[i, j])
            for name, (f, g) in products.items():
                value = (dl[f].T @ dr[g])[i, j]
                if f != g and not within:
                    value = np.where(turned, (dl[g].T @ dr[f])[i, j], value)
                sums[name].append(value)
        a, b = (pa.array(np.concatenate(x)) for x in (at_a, at_b))
        numbers = {name: np.concatenate(v) for name, v in sums.items()}
        out = pa.table([*(table[k].take(a) for k in keys), table["asset"].take(a), table["asset"].take(b), pa.array(numbers.pop("n").astype(np.int64)), *map(pa.array, numbers.values())], names=[*keys, "a", "b", "n", *products])
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    kind = {f.name: f.dataType.simpleString() for f in panel.schema}
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), f"a {kind['asset']}", f"b {kind['asset']}", "n bigint", *(f"{p} double" for p in products)])
    units = rows.repartition("_u", "_v").sortWithinPartitions("_u", "_v").mapInArrow(lambda batches: _whole_units(batches, products_of), schema)
    return units.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"), *[F.sum(p).alias(p) for p in products])
