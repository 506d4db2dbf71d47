"""Per-key results over skewed keys: range partitions on a composite key, stitched partial states.

The rows are range-partitioned on (key, secondary) with the quantiles that Spark samples, so a key that holds a third
of all rows is spread over as many partitions as its rows fill. Each partition makes one partial state per key it
sees; the states of one key in neighbouring partitions are then stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.plans.cut import Cut


#: An aggregate of rows and the one that merges its partial results. Any such pair will do, sketches too.
Aggregate = tuple[Callable[[Column], Column], Callable[[Column], Column]]
MAX: Aggregate = (F.max, F.max)
MIN: Aggregate = (F.min, F.min)
SUM: Aggregate = (F.sum, F.sum)
COUNT: Aggregate = (F.count, F.sum)


def per_key_states(df: DataFrame, key: str, secondary: str, measures: dict[str, tuple[Column, Aggregate]]) -> DataFrame:
    """Partial states (_key, _part, n_rows, n_distinct, first_2nd, last_2nd and one column per measure).

    A measure is a column and an aggregate in two steps. Equal (key, secondary) rows always share a range partition, so
    distinct counts of different partitions add up.
    """
    keyed = df.select(F.col(key).alias("_key"), F.col(secondary).alias("_2nd"), *[c.alias(m) for m, (c, _) in measures.items()])
    ranged = keyed.repartitionByRange("_key", "_2nd")
    # The range partitioning already clusters (_key, _2nd): this aggregate needs no exchange.
    runs = ranged.groupBy("_key", "_2nd").agg(F.count(F.lit(1)).alias("_n"), *[partial(F.col(m)).alias(m) for m, (_, (partial, _)) in measures.items()])
    return (
        runs.withColumn("_part", F.spark_partition_id())
        .groupBy("_key", "_part")
        .agg(
            F.sum("_n").alias("n_rows"),
            F.count("_2nd").alias("n_distinct"),
            F.min("_2nd").alias("first_2nd"),
            F.max("_2nd").alias("last_2nd"),
            *[merge(F.col(m)).alias(m) for m, (_, (_, merge)) in measures.items()],
        )
    )


def per_key(df: DataFrame, key: str, secondary: str, measures: dict[str, tuple[Column, Aggregate]] | None = None) -> DataFrame:
    """One row per key: key, n_rows, n_distinct (of secondary), first_2nd, last_2nd and the measures.

    Null keys form one group of their own; null secondaries count as rows but not as distinct values; null measures
    are ignored (null if there is no other); repeated rows count in n_rows only; an empty table gives no rows; other
    columns are ignored whatever they are called.
    """
    measures = measures or {}
    states = per_key_states(df, key, secondary, measures)
    return states.groupBy(F.col("_key").alias(key)).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_distinct").alias("n_distinct"),
        F.min("first_2nd").alias("first_2nd"),
        F.max("last_2nd").alias("last_2nd"),
        *[merge(F.col(m)).alias(m) for m, (_, (_, merge)) in measures.items()],
    )


def positions(df: DataFrame, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with position, from 1 on, in the given order within each group (no group columns: over all rows).

    Rows are range-partitioned on (group, order); each partition numbers its own rows and adds how many rows of the group
    the partitions before it have, so a large group is numbered by many tasks. Ties have any order among themselves.
    """
    keys = [*within]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = Cut(df.sparkSession).write(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = placed.withColumn("_row", F.row_number().over(here)).join(offsets, same)
    return numbered.select(*df.columns, (F.col("_row") + F.col("_before")).alias("position"))
