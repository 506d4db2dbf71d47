"""Operators on entry graphs: tips, closures, paths, merge bases, differences and reachability.

entries has (tree_id, entry_id, ...), edges (tree_id, child_id, parent_id); entry ids are unique over all trees. Closures
run in blocks of bounded size (see Blocks), so no large tree ends up in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.operators.hierarchy import values
from arborfold.operators.skew import positions
from arborfold.plans.cut import Cut

#: Edges in a block of a closure.
BLOCK_ROWS = 500_000


def tree_tips(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries that are nobody's parent within their tree."""
    parents = edges.select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p"))
    return entries.join(parents, (F.col("tree_id") == F.col("_t")) & (F.col("entry_id") == F.col("_p")), "left_anti")


def store_tips(patches: DataFrame, store_edges: DataFrame) -> DataFrame:
    """Patches of a store whose entry is nobody's store parent there."""
    parents = store_edges.select(F.col("tree_id").alias("_t"), F.col("store").alias("_s"), F.col("parent_id").alias("_p"))
    same = (F.col("tree_id") == F.col("_t")) & (F.col("store") == F.col("_s")) & (F.col("entry_id") == F.col("_p"))
    return patches.join(parents, same, "left_anti")


def is_tip(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """entries with is_tip."""
    parents = edges.select(F.col("tree_id").alias("_t"), F.col("parent_id").alias("_p")).distinct()
    joined = entries.join(parents, (F.col("tree_id") == F.col("_t")) & (F.col("entry_id") == F.col("_p")), "left")
    return joined.withColumn("is_tip", F.col("_p").isNull()).drop("_t", "_p")


class Blocks:
    """Edges laid out in blocks for closures, as written tables that any number of closures over them can share.

    Blocks are range partitions of tree and child. A round of a closure follows each block's own edges from the entries
    that reach it to their end, and hands what it found on to the blocks that refer to it. Only blocks that new entries
    reach are read again, but a way through k blocks takes k rounds: trees smaller than a block take one or two.
    """

    def __init__(self, edges: DataFrame, up: bool = True, block_rows: int = BLOCK_ROWS) -> None:
        """up: from children to parents."""
        spark = edges.sparkSession
        self.cut = Cut(spark)
        a, b = ("parent_id", "child_id") if up else ("child_id", "parent_id")
        links = edges.select(F.col(a).alias("c"), F.col(b).alias("p"), "tree_id", F.col("child_id").alias("at")).where("c is not null and p is not null and c <> p")
        links = self.cut.write(links)
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // block_rows))
        self.placed = self.cut.write(links.repartitionByRange(n, "tree_id", "at").select("c", "p", F.spark_partition_id().alias("blk")))
        self.cut.drop(links)
        self.wanted = self.cut.write(self.placed.select("p", "blk").distinct())

    def reach(self, seeds: DataFrame) -> DataFrame:
        """entry_id of the seeds (entry_id) and of everything that the edges lead to from them, each once."""
        new = self.cut.write(seeds.select(F.col("entry_id").alias("n")).where("n is not null").distinct())
        parts = [new]
        while True:
            into = self.cut.write(new.join(self.wanted, new["n"] == self.wanted["p"]).select("n", "blk"))
            if into.isEmpty():
                break
            touched = self.placed.join(into.select("blk").distinct(), "blk", "left_semi")
            reached = touched.groupBy("blk").cogroup(into.groupBy("blk")).applyInArrow(_follow, "n string").distinct()
            new = self.cut.write(reached.join(reduce(DataFrame.unionAll, parts), "n", "left_anti"))
            if new.isEmpty():
                break
            parts.append(new)
        return reduce(DataFrame.unionAll, parts).withColumnRenamed("n", "entry_id")


def _follow(edges: pa.Table, start: pa.Table) -> pa.Table:
    """Everything that the edges (c after p) lead to from the start entries."""
    after: dict = {}
    for x, y in zip(edges["c"].to_pylist(), edges["p"].to_pylist()):
        after.setdefault(y, []).append(x)
    todo, seen = start["n"].to_pylist(), set()
    while todo:
        for x in after.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return pa.table({"n": pa.array(list(seen), pa.string())})


def subtree_tips(patches: DataFrame, store_edges: DataFrame) -> DataFrame:
    """patches with is_tip: whether the entry is a tip of its store."""
    parents = store_edges.select(F.col("tree_id").alias("_t"), F.col("store").alias("_s"), F.col("parent_id").alias("_p")).distinct()
    same = (F.col("tree_id") == F.col("_t")) & (F.col("store") == F.col("_s")) & (F.col("entry_id") == F.col("_p"))
    return patches.join(parents, same, "left").withColumn("is_tip", F.col("_p").isNull()).drop("_t", "_s", "_p")


def ancestors(edges: DataFrame, tips: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """entry_id of the tips and everything above them; stop entries are left out and not passed."""
    if stop is None:
        return Blocks(edges).reach(tips)
    ends = stop.select(F.col("entry_id").alias("_e")).where("_e is not null").distinct()
    inner = edges.join(ends, F.col("child_id") == F.col("_e"), "left_anti").join(ends, F.col("parent_id") == F.col("_e"), "left_anti")
    return Blocks(inner).reach(tips.join(ends, F.col("entry_id") == F.col("_e"), "left_anti"))


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """entry_id of the start entries and everything below them."""
    return Blocks(edges, up=False).reach(start)


def tree_at(entries: DataFrame, edges: DataFrame, tips: DataFrame) -> DataFrame:
    """The entries at or above the tips of their tree; no tips, no entries. See bad_tips() for what is no tip."""
    return entries.join(ancestors(edges, tips), "entry_id", "left_semi")


def bad_tips(entries: DataFrame, tips: DataFrame) -> DataFrame:
    """tips (tree_id, entry_id) with error: not_found or not_in_tree."""
    known = entries.select(F.col("entry_id").alias("_e"), F.col("tree_id").alias("_t")).distinct()
    joined = tips.join(known, F.col("entry_id") == F.col("_e"), "left")
    error = F.when(F.col("_e").isNull(), "not_found").when(F.col("_t") != F.col("tree_id"), "not_in_tree")
    return joined.select("tree_id", "entry_id", error.alias("error")).where("error is not null")


def store_at(patches: DataFrame, store_edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Patches of one store at or above the tips over store edges; tips of other trees or stores do not count."""
    own = tips.join(patches.select("entry_id"), "entry_id", "left_semi")
    return patches.join(ancestors(store_edges, own), "entry_id", "left_semi")


def store_tips_at(entries: DataFrame, edges: DataFrame, patches: DataFrame, store_edges: DataFrame, main_tips: DataFrame) -> DataFrame:
    """Store tips among the entries at or above the main tips."""
    seen = ancestors(edges, main_tips)
    kept = patches.join(seen, "entry_id", "left_semi")
    inner = store_edges.join(seen.withColumnRenamed("entry_id", "child_id"), "child_id", "left_semi")
    return store_tips(kept, inner)


def sorted_parents(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """tree_id, child_id, parents: the parents in canonical order (height, then id)."""
    height = entries.select(F.col("entry_id").alias("parent_id"), "height")
    rows = edges.select("tree_id", "child_id", "parent_id").distinct().join(height, "parent_id")
    ordered = F.sort_array(F.collect_list(F.struct("height", "parent_id")))
    return rows.groupBy("tree_id", "child_id").agg(ordered.getField("parent_id").alias("parents"))


def first_parents(edges: DataFrame) -> DataFrame:
    """edges with only the smallest parent of each child."""
    return edges.groupBy("tree_id", "child_id").agg(F.min("parent_id").alias("parent_id"))


def missing_parents(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is no entry."""
    return edges.join(entries.select(F.col("entry_id").alias("_e")), F.col("parent_id") == F.col("_e"), "left_anti")


def missing_ancestors(entries: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """entry_id of what is not here among the wanted entries and everything above them."""
    return ancestors(edges, wanted).join(entries.select("entry_id"), "entry_id", "left_anti")


def reachability(entries: DataFrame, edges: DataFrame, start: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (tree_id, entry_id) with state: reachable, unreachable, indeterminate or not_in_tree.

    A target is indeterminate if some way up from the start entries of its tree leaves what is here (see lost_ids());
    other trees' gaps do not count. Entries lower than every target of their tree cannot lead to one and are not
    visited. No start entries: unreachable. A target that is an entry of another tree is not_in_tree.
    """
    seen, lost = _sighted(entries, edges, start, targets)
    trees = lost.select(F.col("tree_id").alias("_lost")).distinct()
    known = entries.select(F.col("entry_id").alias("_e"), F.col("tree_id").alias("_of"))
    joined = targets.join(seen.select(F.col("entry_id").alias("_hit")), F.col("entry_id") == F.col("_hit"), "left").join(trees, F.col("tree_id") == F.col("_lost"), "left").join(known, F.col("entry_id") == F.col("_e"), "left")
    state = F.when(F.col("_of") != F.col("tree_id"), "not_in_tree").when(F.col("_hit").isNotNull(), "reachable").when(F.col("_lost").isNotNull(), "indeterminate").otherwise("unreachable")
    return joined.select(*targets.columns, state.alias("state"))


def lost_ids(entries: DataFrame, edges: DataFrame, start: DataFrame, targets: DataFrame) -> DataFrame:
    """tree_id, entry_id of what a reachability() from start would have to look at and is not here."""
    return _sighted(entries, edges, start, targets)[1]


def _sighted(entries: DataFrame, edges: DataFrame, start: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    heights = entries.select(F.col("entry_id").alias("_e"), F.col("height").alias("_h"))
    floors = targets.join(heights, F.col("entry_id") == F.col("_e"), "left").groupBy(F.col("tree_id").alias("_t")).agg(F.min("_h").alias("_floor"))
    high = entries.join(floors, F.col("tree_id") == F.col("_t")).where("_floor is null or height >= _floor").select(F.col("entry_id").alias("child_id"))
    passing = edges.join(high, "child_id", "left_semi")
    seen = Blocks(passing).reach(start)
    over = passing.select("tree_id", F.col("parent_id").alias("entry_id"), F.col("child_id").alias("_c")).join(seen.withColumnRenamed("entry_id", "_c"), "_c", "left_semi")
    lost = over.select("tree_id", "entry_id").unionByName(start.select("tree_id", "entry_id")).join(heights, F.col("entry_id") == F.col("_e"), "left_anti").distinct()
    return seen, lost


def ids_added(entries: DataFrame, edges: DataFrame, before: DataFrame, after: DataFrame, strict: bool = False) -> DataFrame:
    """tree_id, entry_id, height, position (by height, then id, in each tree) of what `after` has above it and `before` has not.

    strict only stops at the entries of `before` and does not leave out what else lies above them. Trees in which every
    entry of `before` is higher than all of `after` have nothing added (the difference runs backwards), and neither have
    those with the same snapshots.
    """
    heights = entries.select(F.col("entry_id").alias("_e"), F.col("tree_id").alias("_t"), F.col("height").alias("_h"))
    low = before.join(heights, F.col("entry_id") == F.col("_e")).groupBy("_t").agg(F.min("_h").alias("_low"))
    high = after.join(heights, F.col("entry_id") == F.col("_e")).groupBy(F.col("_t").alias("_t2")).agg(F.max("_h").alias("_high"))
    backwards = low.join(high, (F.col("_t") == F.col("_t2")) & (F.col("_low") > F.col("_high"))).select(F.col("_t").alias("tree_id"))
    if strict:
        found = ancestors(edges, after, before)
    else:
        blocks = Blocks(edges)
        found = blocks.reach(after).join(blocks.reach(before), "entry_id", "left_anti")
    rows = entries.select("tree_id", "entry_id", "height").join(found, "entry_id", "left_semi").join(backwards, "tree_id", "left_anti")
    return positions(rows, ["tree_id"], ["height", "entry_id"])


def merge_errors(entries: DataFrame, requests: DataFrame, trees: DataFrame) -> DataFrame:
    """tree_id, error of trees for which no merge base can be asked: empty_list (no entries are requested) or not_found."""
    known = entries.select(F.col("entry_id").alias("_e"), F.col("tree_id").alias("_t"))
    lost = requests.join(known, (F.col("entry_id") == F.col("_e")) & (F.col("tree_id") == F.col("_t")), "left_anti").select("tree_id", F.lit("not_found").alias("error")).distinct()
    return trees.select("tree_id").join(requests, "tree_id", "left_anti").select("tree_id", F.lit("empty_list").alias("error")).unionByName(lost)


def merge_bases(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """tree_id, base: the lowest entry through which every way up from all requested entries of the tree passes.

    requests has (tree_id, entry_id). base is null if there is no such entry. Only what lies above the requested entries
    goes to the kernel, which finds immediate dominators in one pass over it.
    """
    above = ancestors(edges, requests).select(F.col("entry_id").alias("child_id"))
    inner = edges.join(above, "child_id", "left_semi").select(F.col("tree_id").alias("tree_id"), "child_id", "parent_id")
    asked = requests.select(F.col("tree_id").alias("tree_id"), F.col("entry_id").alias("entry_id"))

    def base(links: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"tree_id": pa.array([], pa.string()), "base": pa.array([], pa.string())})
        found = lowest_dominator(zip(links["child_id"].to_pylist(), links["parent_id"].to_pylist()), wanted["entry_id"].to_pylist())
        return pa.table({"tree_id": pa.array([wanted["tree_id"][0].as_py()], pa.string()), "base": pa.array([found], pa.string())})

    return inner.groupBy("tree_id").cogroup(asked.groupBy("tree_id")).applyInArrow(base, "tree_id string, base string")


def dominators(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """tree_id, entry_id of every entry through which all ways up from all requested (tree_id, entry_id) of its tree pass.

    The lowest of them is the merge base. Tasks and bounds are those of merge_bases().
    """
    above = ancestors(edges, requests).select(F.col("entry_id").alias("child_id"))
    inner = edges.join(above, "child_id", "left_semi").select(F.col("tree_id").alias("tree_id"), "child_id", "parent_id")
    asked = requests.select(F.col("tree_id").alias("tree_id"), F.col("entry_id").alias("entry_id"))

    def chain(links: pa.Table, wanted: pa.Table) -> pa.Table:
        found = all_dominators(zip(links["child_id"].to_pylist(), links["parent_id"].to_pylist()), wanted["entry_id"].to_pylist()) if wanted.num_rows else []
        tree = wanted["tree_id"][0].as_py() if wanted.num_rows else None
        return pa.table({"tree_id": pa.array([tree] * len(found), pa.string()), "entry_id": pa.array(found, pa.string())})

    return inner.groupBy("tree_id").cogroup(asked.groupBy("tree_id")).applyInArrow(chain, "tree_id string, entry_id string")


def lowest_dominator(links: Iterator[tuple[str, str]], wanted: list[str]) -> str | None:
    """The lowest node on all ways up from the wanted nodes; None if ways end at different roots."""
    return next(iter(all_dominators(links, wanted)), None)


def all_dominators(links: Iterator[tuple[str, str]], wanted: list[str]) -> list[str]:
    """The nodes on all ways up from the wanted nodes, the lowest first."""
    up: dict[str, set] = {}
    kids: dict[str, set] = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
        kids.setdefault(p, set()).add(c)
    nodes = set(up) | set(kids) | set(wanted)
    left = {n: len(up.get(n, ())) for n in nodes}
    over: dict = {None: None}
    depth: dict = {None: 0}

    def meet(a: str | None, b: str | None) -> str | None:
        while a != b:
            if depth[a] < depth[b]:
                a, b = b, a
            a = over[a]
        return a

    ready = [n for n in nodes if not left[n]]
    while ready:
        n = ready.pop()
        parents = list(up.get(n, ()))
        dom = parents[0] if parents else None
        for p in parents[1:]:
            dom = meet(dom, p)
        over[n], depth[n] = dom, depth[dom] + 1
        for c in kids.get(n, ()):
            left[c] -= 1
            if not left[c]:
                ready.append(c)
    best = wanted[0]
    for w in wanted[1:]:
        best = meet(best, w)
    out = []
    while best is not None:
        out.append(best)
        best = over[best]
    return out


def timestamp_heights(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """tree_id, entry_id, height: the larger of the entry's time (ms) and one more than its highest parent.

    entries has (tree_id, entry_id, ms). Parents that are not here do not count; entries on or below a cycle have none.
    """
    ms = entries.select(F.col("entry_id").alias("c"), F.col("ms").alias("m"))
    here = edges.select(F.col("child_id").alias("c"), F.col("parent_id").alias("p")).join(entries.select(F.col("entry_id").alias("p")), "p", "left_semi")
    found = values(here.join(ms, "c"), ms.withColumnRenamed("c", "n"), "floor")
    return found.join(entries.select("tree_id", F.col("entry_id").alias("n")), "n").select("tree_id", F.col("n").alias("entry_id"), F.col("floor").alias("height"))


def canonical_snapshot(tips: Column) -> Column:
    """A snapshot: its tips sorted, each once."""
    return F.array_sort(F.array_distinct(tips))


def merge_key(tips: Column) -> Column:
    """The cache key of a merged state: the same for any order of the tips."""
    return F.sha2(F.concat_ws(":", F.lit("merge"), canonical_snapshot(tips)), 256)
