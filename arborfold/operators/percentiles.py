"""Percentiles per group as cumulative frequencies of mergeable value counts.

A summary holds (group, value, frequency). Summaries of separate days or files are put together by adding
frequencies. Ranks come from a range sort on (group, value), running sums inside each range partition and the sums of
the partitions before it, so no group has to fit into one task.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.plans.cut import Cut


def bucket(value: Column, bits: int | None) -> Column:
    """The value itself (bits None), or the nearest one with `bits` leading binary digits, off by at most value / 2**bits.

    That holds for every magnitude, fractions and the smallest numbers included; whole numbers below 2**bits stay as they
    are, and so do NaN (which counts as larger than all others) and the infinities. Signs are kept, zeros are one.
    """
    x = value.cast("double")
    if bits is None:
        return F.when(x == 0, F.lit(0.0)).otherwise(x)
    size, two = F.abs(x), F.lit(2.0)
    guess = F.floor(F.log2(size)).cast("double")
    # the logarithm may be off by its last digit next to a power of two
    power = guess + F.when(size >= F.pow(two, guess + 1), 1.0).when(size < F.pow(two, guess), -1.0).otherwise(0.0)
    steps = F.lit(2.0 ** (bits - 1))
    near = F.floor(size / F.pow(two, power) * steps + 0.5).cast("double") / steps * F.pow(two, power)
    rounded = F.least(near, F.lit(sys.float_info.max)) * F.signum(x)
    plain = F.isnan(x) | (size == float("inf"))
    return F.when(x == 0, F.lit(0.0)).when(plain, x).otherwise(rounded)


def value_counts(df: DataFrame, groups: Sequence[str], values: dict[str, Column], bits: int | None = None) -> DataFrame:
    """A summary: groups..., measure, value, n. Null values are left out, NaN and infinities count as values; null groups
    form a group of their own."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(c, bits).alias("value")) for m, c in values.items()])
    return (
        df.select(*groups, F.explode(pairs).alias("_p"))
        .select(*groups, F.col("_p.measure").alias("measure"), F.col("_p.value").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_counts(summaries: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """Summaries of separate inputs as one; columns besides the groups (a day, a file) are summed away."""
    every = reduce(DataFrame.unionByName, [s.select(*groups, "measure", "value", "n") for s in summaries])
    return every.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """For each group and measure the first value whose cumulative frequency reaches ceil(p * total).

    Returns groups..., measure, n_values, and a column p<percent> for each probability (p50 for 0.5). Exact on exact
    counts; on bucketed counts each percentile is off by no more than the bucket's error. An empty summary gives no
    rows.
    """
    keys = [*groups, "measure"]
    spark = counts.sparkSession
    cut = Cut(spark)
    ranged = counts.select(*keys, "value", "n").repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value")
    placed = cut.write(ranged.withColumn("_part", F.spark_partition_id()))

    parts = placed.groupBy(*keys, "_part").agg(F.sum("n").alias("_in_part"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_in_part").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_part").over(whole).alias("_total"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    running = Window.partitionBy("_part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_run", F.sum("n").over(running))
    ranked = summed.join(offsets, (F.col("_part") == F.col("_p")) & same).withColumn("_cum", F.col("_run") + F.col("_before"))
    targets = [F.ceil(F.lit(p).cast("decimal(10,6)") * F.col("_total")) for p in probabilities]
    reached = [F.min(F.when(F.col("_cum") >= F.greatest(t, F.lit(1)), F.col("value"))).alias(f"p{100 * p:g}".replace(".", "_")) for p, t in zip(probabilities, targets)]
    return ranked.groupBy(*keys).agg(F.max("_total").alias("n_values"), *reached)
