"""References to records that do not exist, and what they leave behind further down.

A reference is direct if its target is missing, deleted, or arrived only after the reference was made. Missing and
deleted targets leave the referring record orphaned, and every record that refers to an orphaned one inherits that.
The cascade runs to a fixpoint of semi-joins down the references. References that form deep hierarchies are contracted
first, so that the semi-joins follow some dozen rounds instead of every level (see hierarchy.below); references of many
records to few targets, such as that of every entry to its tree, are followed one step at a time in between.

A few targets can have most of the references. They are told apart by their counts, of which there are at most a
thousand; only those few are sent to every task, and their references stay spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.operators.hierarchy import CORE_LINKS, below, keyed, keys_collide
from arborfold.plans.cut import Cut

#: A target is hot if it has more references than this and than a thousandth of all.
HOT_ROWS, HOT_SHARE = 50_000, 1_000


class Targets:
    """The distinct targets of references, as a written table, and which of them are hot."""

    def __init__(self, refs: DataFrame, target: str, cut: Cut, facts: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> None:
        """facts has (id, ...), unique; its columns come along, null for a target without any."""
        counted = refs.groupBy(F.col(target).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_id is not null")
        if facts is not None:
            counted = counted.join(facts.withColumnRenamed("id", "_id").withColumn("_known", F.lit(True)), "_id", "left")
        self.table = cut.write(counted)
        total = self.table.agg(F.sum("_n")).first()[0] or 0
        self.limit = max(hot_rows, total // HOT_SHARE)
        self.target = target

    def join(self, refs: DataFrame, facts: DataFrame, spread: str) -> DataFrame:
        """refs with the columns of facts (_id, _n, ...: targets of this table), null for other targets.

        Facts of hot targets (at most a thousand) are broadcast; their references are placed by the column `spread`.
        """
        names = [c for c in facts.columns if c not in ("_id", "_n")]
        hot = facts.where(F.col("_n") > self.limit).select(F.col("_id").alias("_hot"), *[F.col(c).alias(f"_hot{c}") for c in names])
        cold = facts.where(F.col("_n") <= self.limit).select(F.col("_id").alias("_cold"), *names)
        first = refs.join(F.broadcast(hot), F.col(self.target) == F.col("_hot"), "left")
        place = F.when(F.col("_hot").isNull(), F.col(self.target)).otherwise(F.col(spread))
        both = first.join(cold, place == F.col("_cold"), "left")
        return both.select(*refs.columns, *[F.when(F.col("_hot").isNotNull(), F.col(f"_hot{c}")).otherwise(F.col(c)).alias(c) for c in names])


def direct(refs: DataFrame, targets: DataFrame, cut: Cut, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Targets]:
    """refs with reason: missing, deleted, late or null for a reference that holds; and the targets.

    refs has ref_id, target_id and at; targets has id (unique), first_at and deleted. A null target is no reference. A
    reference without a time is never late, nor is one to a target without an arrival.
    """
    facts = targets.select("id", F.col("first_at").alias("_first"), F.col("deleted").alias("_gone"))
    held = Targets(refs, "target_id", cut, facts, hot_rows)
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("_gone"), "deleted").when(F.col("_first") > F.col("at"), "late")
    judged = held.join(refs.where("target_id is not null"), held.table, "ref_id")
    return judged.withColumn("reason", reason).drop("_first", "_gone", "_known"), held


def cascade(deep: DataFrame, wide: DataFrame, seeds: DataFrame, core_links: int = CORE_LINKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """n of every seed and of every record that refers, over one or more links, to a seed; each once, written tables.

    deep and wide have (c, p): record c refers to p. Deep links may form hierarchies of any depth and are followed by
    contraction; wide ones are followed by one semi-join for each time that a way changes from deep to wide links.
    seeds has (n). Cycles and repeated links do no harm, rows with a null do not count.
    """
    cut = Cut(deep.sparkSession)
    targets = Targets(wide, "p", cut, hot_rows=hot_rows)
    new = cut.write(seeds.where("n is not null").select("n").distinct())
    parts = [new, below(deep, new, core_links)]
    fresh = reduce(DataFrame.unionAll, parts)
    while True:
        hit = cut.write(targets.table.join(fresh.withColumnRenamed("n", "_id"), "_id", "left_semi").withColumn("_hit", F.lit(True)))
        if hit.isEmpty():
            break
        known = reduce(DataFrame.unionAll, parts)
        referring = targets.join(wide.where("c is not null and p is not null"), hit, "c").where("_hit").select(F.col("c").alias("n")).distinct()
        new = cut.write(referring.join(known, "n", "left_anti"))
        if new.isEmpty():
            break
        rest = deep.join(known.withColumnRenamed("n", "c"), "c", "left_anti")
        fresh = new.unionAll(below(rest, new, core_links))
        parts.append(fresh)
    return reduce(DataFrame.unionAll, parts)


def orphans(refs: DataFrame, targets: DataFrame, deep: Column, core_links: int = CORE_LINKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every orphan reference: the columns of refs, reason and kind.

    refs has ref_table, ref_id, target_id, at; targets as in direct(). kind is direct (reason missing, deleted, late) or
    inherited (reason inherited): a reference to a record that is orphaned itself, over missing or deleted targets; a
    late target is there by now and passes nothing on. deep says which references may form deep hierarchies; the others
    should have few targets. Empty tables give no rows; repeated references give a row each.
    """
    cut = Cut(refs.sparkSession)
    judged, held = direct(refs.withColumn("_deep", deep), targets, cut, hot_rows)
    judged = cut.write(judged)
    hashed = not keys_collide(judged.select("ref_id"), held.table.select("_id"))
    key = keyed if hashed else (lambda c: c)
    seeds = judged.where("reason in ('missing', 'deleted') and ref_id is not null").select(key(F.col("ref_id")).alias("n"))
    links = judged.select(key(F.col("ref_id")).alias("c"), key(F.col("target_id")).alias("p"), "_deep")
    orphaned = cascade(links.where("_deep").drop("_deep"), links.where("not _deep").drop("_deep"), seeds, core_links, hot_rows)
    below_it = held.table.select("_id", "_n", key(F.col("_id")).alias("n")).join(orphaned, "n", "left_semi").select("_id", "_n", F.lit(True).alias("_orphaned"))
    every = held.join(judged, below_it, "ref_id")
    own = F.col("reason").isNotNull()
    kind = F.when(own, "direct").when(F.col("_orphaned"), "inherited")
    out = every.withColumn("kind", kind).withColumn("reason", F.coalesce("reason", F.when(F.col("_orphaned"), "inherited")))
    return out.where("kind is not null").drop("_deep", "_orphaned")
