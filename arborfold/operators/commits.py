"""Commits as batches: new entries on the current tips, with canonical parents and heights, and reads at snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.operators import fold, hierarchy
from arborfold.operators.dag import canonical_snapshot, tree_tips


def heads(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """tree_id, parents (the snapshot of the current tips), next_height."""
    tips = tree_tips(entries, edges)
    return tips.groupBy("tree_id").agg(canonical_snapshot(F.collect_list("entry_id")).alias("parents"), (F.max("height") + 1).alias("next_height"))


def commit(entries: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and edges that new (tree_id, entry_id, ...) entries add, one per tree, each on its tree's current tips.

    An id that is stored already is left out, so a commit can be run again; a tree without entries starts with a root of
    height 0.
    """
    fresh = new.dropDuplicates(["entry_id"]).join(entries.select("entry_id"), "entry_id", "left_anti")
    placed = fresh.join(heads(entries, edges), "tree_id", "left")
    rows = placed.select(*new.columns, F.coalesce("next_height", F.lit(0)).alias("height"), F.col("parents").isNull().alias("is_root"))
    links = placed.select("tree_id", F.col("entry_id").alias("child_id"), F.explode("parents").alias("parent_id"))
    return rows, links


def states_at(patches: DataFrame, edges: DataFrame, wanted: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The flat state at each wanted entry: at_entry, keys, values. Each is the fold of what is at or above that entry.

    All snapshots are folded at once: every wanted entry's ancestors come from one contraction.
    """
    links = edges.select(F.col("child_id").alias("c"), F.col("parent_id").alias("p"))
    found = hierarchy.values(links, edges.select(F.col("parent_id").alias("n")).where("false"), "ancestors")
    asked = wanted.select(F.col("entry_id").alias("n")).distinct().join(found.select("n", "ancestors"), "n", "left")
    none = F.array().cast("array<string>")
    above = asked.select(F.col("n").alias("at_entry"), F.explode(F.concat(F.coalesce("ancestors", none), F.array("n"))).alias("entry_id"))
    return fold.last_writer(patches.join(above, "entry_id"), ["at_entry", *keys], values)


class StateCache:
    """Folded states kept as tables by scope and snapshot; a snapshot has the same state for ever, so nothing goes stale."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def place(self, scope: str, tips: Sequence[str]) -> str:
        """The folder of a state: the key of merges, for the tips in any order and however often each is given."""
        text = ":".join(["merge", *sorted(set(tips))])
        return f"{self.folder}/{hashlib.sha256(scope.encode()).hexdigest()[:16]}/{hashlib.sha256(text.encode()).hexdigest()}"

    def get(self, scope: str, tips: Sequence[str], compute: Callable[[], DataFrame]) -> DataFrame:
        """The state, read if it is there, else computed and written. A half-written one does not count."""
        place = self.place(scope, tips)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            compute().write.mode("overwrite").parquet(place)
        return self.spark.read.parquet(place)
