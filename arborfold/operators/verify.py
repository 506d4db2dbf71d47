"""Verification of entries as taint propagation: statuses 0 verified, 1 failed, 2 unverified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.operators.auth import validate_pinned
from arborfold.operators.commits import states_at
from arborfold.operators.dag import Blocks, descendants, missing_parents, tree_tips

VERIFIED, FAILED, UNVERIFIED = 0, 1, 2


def verified_entries(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Verified entries all of whose ancestors are here and verified."""
    bad = entries.where(F.col("status") != VERIFIED).select("entry_id")
    lost = missing_parents(entries, edges).select(F.col("child_id").alias("entry_id"))
    return entries.join(descendants(edges, bad.unionAll(lost)), "entry_id", "left_anti")


def verified_frontier(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """The tips of the verified entries."""
    kept = verified_entries(entries, edges)
    inner = edges.join(kept.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")
    return tree_tips(kept, inner)


def verify(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """entries with new_status after one pass over the unverified ones in which parents come first.

    valid says whether an entry's own check passes (null: it cannot be made yet). A failed parent fails it, an unverified
    or missing parent leaves it unverified, and otherwise its own check decides. Settled entries stay as they are.
    """
    open_ = entries.where(F.col("status") == UNVERIFIED)
    inner = edges.join(open_.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")
    status = entries.select(F.col("entry_id").alias("parent_id"), F.col("status").alias("p_status"))
    parents = inner.join(status, "parent_id", "left")
    below_failed = parents.where(F.col("p_status") == FAILED).select(F.col("child_id").alias("entry_id"))
    lost = parents.where(F.col("p_status").isNull()).select(F.col("child_id").alias("entry_id"))
    not_passing = open_.where("valid is null or not valid").select("entry_id")
    downwards = Blocks(inner, up=False)  # one layout for both closures
    held = downwards.reach(not_passing.unionAll(below_failed).unionAll(lost)).withColumn("_held", F.lit(True))
    passes = open_.join(held, "entry_id", "left_anti").select("entry_id")
    settled = entries.where(F.col("status") == VERIFIED).select("entry_id").unionAll(passes).select(F.col("entry_id").alias("parent_id"))
    has_open_parent = inner.join(settled, "parent_id", "left_anti").select(F.col("child_id").alias("entry_id"))
    invalid = open_.where("valid = false").select("entry_id").join(has_open_parent, "entry_id", "left_anti")
    failed = downwards.reach(invalid.unionAll(below_failed)).withColumn("_failed", F.lit(True))
    joined = entries.join(held, "entry_id", "left").join(failed, "entry_id", "left")
    new = F.when(F.col("status") != UNVERIFIED, F.col("status")).when(F.col("_failed"), FAILED).when(F.col("_held"), UNVERIFIED).otherwise(VERIFIED)
    return joined.withColumn("new_status", new).drop("_held", "_failed")


def verify_pinned(entries: DataFrame, edges: DataFrame, settings: DataFrame, settings_edges: DataFrame) -> DataFrame:
    """verify() in which an entry's own check is made against the keys it is pinned to.

    entries has (tree_id, entry_id, status) and what auth.validate_pinned() asks for; settings has the patches of the
    settings stores (entry_id, pubkey, name, type, priority, status, height), settings_edges their (child_id, parent_id).
    The keys at each pin are those folded from the patches at or above it; a pin of which a patch is missing here is
    incomplete, and entries with such a pin stay unverified.
    """
    pins = entries.where("pin is not null").select(F.col("entry_id").alias("_e"), F.col("pin").alias("entry_id")).select("entry_id").distinct()
    states = states_at(settings, settings_edges, pins, ["pubkey"], ["name", "type", "priority", "status"]).withColumnRenamed("at_entry", "pin")
    here = settings.select("entry_id")
    known = settings_edges.select(F.col("child_id").alias("entry_id"), F.col("parent_id").alias("_p"))
    lost = known.join(here.withColumnRenamed("entry_id", "_p"), "_p", "left_anti").select("entry_id").unionAll(pins.join(here, "entry_id", "left_anti"))
    incomplete = descendants(settings_edges, lost).select(F.col("entry_id").alias("pin"))
    own = validate_pinned(entries, states, incomplete).withColumnRenamed("entry_id", "_e")
    judged = entries.drop("valid").join(own, F.col("entry_id") == F.col("_e"), "left").drop("_e")
    return verify(judged, edges)


def put_remote(stored: DataFrame, edges: DataFrame, arriving: DataFrame, arriving_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and edges with what arrives (tree_id, entry_id, valid), stored unverified and verified once; status is the new one."""
    new = arriving.dropDuplicates(["entry_id"]).join(stored.select("entry_id"), "entry_id", "left_anti").select("tree_id", "entry_id", F.lit(UNVERIFIED).alias("status"), "valid")
    every = stored.select("tree_id", "entry_id", "status", "valid").unionByName(new)
    links = edges.select("tree_id", "child_id", "parent_id").unionByName(arriving_edges.select("tree_id", "child_id", "parent_id")).distinct()
    return verify(every, links).drop("status").withColumnRenamed("new_status", "status"), links


def report(verified: DataFrame) -> DataFrame:
    """How many unverified entries became what."""
    was = F.col("status") == UNVERIFIED
    return verified.agg(
        F.count_if(was & (F.col("new_status") == VERIFIED)).alias("verified"),
        F.count_if(was & (F.col("new_status") == FAILED)).alias("failed"),
        F.count_if(was & (F.col("new_status") == UNVERIFIED)).alias("still_unverified"),
    )


def demote(entries: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """entries with new_status: the targets and their verified descendants become unverified."""
    below = descendants(edges, targets).withColumn("_below", F.lit(True))
    target = targets.select("entry_id").distinct().withColumn("_target", F.lit(True))
    joined = entries.join(below, "entry_id", "left").join(target, "entry_id", "left")
    hit = F.coalesce(F.col("_target") | (F.col("_below") & (F.col("status") == VERIFIED)), F.lit(False))
    return joined.withColumn("new_status", F.when(hit, UNVERIFIED).otherwise(F.col("status"))).drop("_below", "_target")
