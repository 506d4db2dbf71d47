"""Continuous periods and gaps of overlapping intervals per entity.

The mergeable aggregate of an entity is its list of sorted disjoint intervals. Lists of separate chunks of rows are
combined by a linear merge in a reduction tree. Rows are range-partitioned on (entity, start), so the list of a busy
entity is held in pieces, one per partition, and the pieces are joined by the latest end that reaches them from before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.plans.cut import Cut


def from_rows(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The aggregate of one chunk: disjoint intervals sorted by (entity, start); touching ones are one."""
    order = np.lexsort((end, start, entity))
    return coalesce(entity[order], start[order], end[order])


def coalesce(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins overlapping and touching neighbours of rows sorted by (entity, start), in one pass."""
    if not len(entity):
        return entity, start, end
    out = []
    for a, b, key in _keyed(entity, start, end):
        e, s, t = entity[a:b], start[a:b], end[a:b]
        reach = np.maximum.accumulate(key + (t - s))  # keys rise from one entity to the next, so no end reaches over
        opens = np.r_[True, (e[1:] != e[:-1]) | (key[1:] > reach[:-1])]
        at = np.flatnonzero(opens)
        last = np.r_[at[1:] - 1, b - a - 1]
        out.append((e[at], s[at], s[at] + (reach[last] - key[at])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _keyed(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of rows (sorted by entity), and for their rows one number in the order of (entity, start) with room for the ends.

    A range holds as many entities as numbers of 64 bits have room for; usually that is all of them.
    """
    low = int(start.min())
    span = int(end.max()) - low + 1
    held = max(1, (1 << 62) // span)
    a = 0
    while a < len(entity):
        b = int(np.searchsorted(entity, entity[a] + held, "left"))
        base = entity[a:b] - entity[a]
        yield a, b, base * span + (start[a:b] - low) if b - a > 1 and base[-1] else start[a:b] - int(start[a])
        a = b


def merge(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two aggregates as one by a linear merge: a stable sort of two sorted runs does nothing but merge them."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    low = min(int(a[1].min()), int(b[1].min()))
    span = max(int(a[1].max()), int(b[1].max())) - low + 1
    held = max(1, (1 << 62) // span)
    out, first = [], min(int(a[0][0]), int(b[0][0]))
    stop = max(int(a[0][-1]), int(b[0][-1]))
    while first <= stop:
        parts = [tuple(x[np.searchsorted(s[0], first) : np.searchsorted(s[0], first + held)] for x in s) for s in (a, b)]
        entity, start, end = (np.concatenate(x) for x in zip(*parts))
        if len(entity):
            key = start - low if held == 1 else (entity - first) * span + (start - low)
            order = np.argsort(key, kind="stable")
            out.append((entity[order], start[order], end[order]))
        first += held
    return coalesce(*(np.concatenate(x) for x in zip(*out)))


class Reduction:
    """A reduction tree: aggregates of equal weight are merged in pairs, as carries of a binary counter are."""

    def __init__(self) -> None:
        self.levels: list[tuple | None] = []

    def add(self, state: tuple) -> None:
        for i, held in enumerate(self.levels):
            if held is None:
                self.levels[i] = state
                return
            state, self.levels[i] = merge(held, state), None
        self.levels.append(state)

    def result(self) -> tuple | None:
        out = None
        for held in self.levels:
            if held is not None:
                out = held if out is None else merge(held, out)
        return out


def _lists(batches: Iterator[pa.RecordBatch], keep_at_most: int) -> Iterator[pa.RecordBatch]:
    """Aggregates of the rows of one task; lists are given out whenever they hold more than keep_at_most intervals."""
    codes: dict = {}
    names: list = []
    tree = Reduction()
    held = 0

    def out(state: tuple) -> pa.RecordBatch:
        entity = pa.array(names, names_type).take(pa.array(state[0]))
        return pa.RecordBatch.from_arrays([entity, pa.array(state[1]), pa.array(state[2])], ["_entity", "_start", "_end"])

    names_type = pa.string()
    for batch in batches:
        column = batch.column(0)
        names_type = column.type
        d = pc.dictionary_encode(column)
        local = np.empty(len(d.dictionary), np.int64)
        for i, name in enumerate(d.dictionary.to_pylist()):
            if name not in codes:
                codes[name] = len(names)
                names.append(name)
            local[i] = codes[name]
        entity = local[d.indices.to_numpy(zero_copy_only=False)] if len(local) else np.empty(0, np.int64)
        state = from_rows(entity, batch.column(1).to_numpy(), batch.column(2).to_numpy())
        tree.add(state)
        held += len(state[0])
        if held > keep_at_most:
            yield out(tree.result())
            tree, held, codes, names = Reduction(), 0, {}, []
    if (state := tree.result()) is not None and len(state[0]):
        yield out(state)


def disjoint(df: DataFrame, entity: str, start: Column, end: Column, cut: Cut | None = None, keep_at_most: int = 2_000_000) -> DataFrame:
    """Pieces of the entities' lists: (_entity, _part, _start, _end) of rows with end > start; a written table.

    start and end are whole numbers (microseconds, say) between -2**61 and 2**61. Intervals of one partition are disjoint; those of an earlier
    partition may still reach into a later one.
    """
    cut = cut or Cut(df.sparkSession)
    rows = df.select(F.col(entity).alias("_entity"), start.cast("bigint").alias("_start"), end.cast("bigint").alias("_end"))
    rows = rows.where(F.col("_entity").isNotNull() & (F.col("_end") > F.col("_start")))
    schema = rows.schema

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _lists(batches, keep_at_most)

    partial = rows.mapInArrow(lists, schema)  # before the shuffle
    ranged = partial.repartitionByRange("_entity", "_start").sortWithinPartitions("_entity", "_start")
    return cut.write(ranged.mapInArrow(lists, schema).withColumn("_part", F.spark_partition_id()))


def _carried(pieces: DataFrame) -> DataFrame:
    """pieces with _reach, the latest end of the entity before the row, in this partition or an earlier one (or null)."""
    parts = pieces.groupBy("_entity", "_part").agg(F.max("_end").alias("_part_end"))
    earlier = Window.partitionBy("_entity").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("_entity").alias("_e"), F.col("_part").alias("_p"), F.max("_part_end").over(earlier).alias("_carry"))
    here = Window.partitionBy("_entity", "_part").orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    joined = pieces.withColumn("_before", F.max("_end").over(here)).join(carry, (F.col("_entity") == F.col("_e")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_reach", F.greatest("_before", "_carry"))


def gaps(df: DataFrame, entity: str, start: Column, end: Column) -> DataFrame:
    """The complement of each entity's list, between its first and its last interval: entity, gap_start, gap_end.

    Rows with a null entity, start or end, or an end that is not after the start, do not count; touching intervals
    leave no gap; repeated rows change nothing; an empty table gives no rows.
    """
    reached = _carried(disjoint(df, entity, start, end))
    found = reached.where(F.col("_start") > F.col("_reach"))
    return found.select(F.col("_entity").alias(entity), F.col("_reach").alias("gap_start"), F.col("_start").alias("gap_end"))


def periods(df: DataFrame, entity: str, start: Column, end: Column) -> DataFrame:
    """Continuous periods: entity, period_start, period_end. Rows count as in gaps().

    A period starts at an interval that no earlier one reaches and ends where the next gap starts; both are read off
    (entity, position) pairs without gathering an entity's list.
    """
    cut = Cut(df.sparkSession)
    reached = cut.write(_carried(disjoint(df, entity, start, end, cut)).select("_entity", "_part", "_start", "_end", "_reach"))
    opens = F.col("_reach").isNull() | (F.col("_start") > F.col("_reach"))
    here = Window.partitionBy("_entity", "_part").orderBy("_start", "_end").rowsBetween(Window.unboundedPreceding, 0)
    local = reached.withColumn("_period", F.max(F.when(opens, F.col("_start"))).over(here))
    parts = reached.groupBy("_entity", "_part").agg(F.max(F.when(opens, F.col("_start"))).alias("_last"))
    earlier = Window.partitionBy("_entity").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("_entity").alias("_e"), F.col("_part").alias("_p"), F.max("_last").over(earlier).alias("_carry"))
    whole = local.join(carry, (F.col("_entity") == F.col("_e")) & (F.col("_part") == F.col("_p")))
    return (
        whole.groupBy(F.col("_entity").alias(entity), F.coalesce("_period", "_carry").alias("period_start"))
        .agg(F.max("_end").alias("period_end"))
    )
