"""Transactions over several stores: one entry each, with parents in the tree and in every store, and a pin of the settings."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.operators import dag
from arborfold.operators.dag import canonical_snapshot

SETTINGS = "_settings"


class Batch(NamedTuple):
    """What transactions add, and which of them add nothing (entry_id, error)."""

    entries: DataFrame
    edges: DataFrame
    patches: DataFrame
    store_edges: DataFrame
    errors: DataFrame


def store_heads(patches: DataFrame, store_edges: DataFrame, entries: DataFrame | None = None, edges: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """tree_id, store, parents, next_height of every store: its current tips, or those seen from the main tips `at`."""
    tips = dag.store_tips(patches, store_edges) if at is None else dag.store_tips_at(entries, edges, patches, store_edges, at)
    return tips.groupBy("tree_id", "store").agg(canonical_snapshot(F.collect_list("entry_id")).alias("parents"), (F.max("height") + 1).alias("next_height"))


def context(entries: DataFrame, edges: DataFrame, patches: DataFrame, store_edges: DataFrame, settings_store: str = SETTINGS) -> DataFrame:
    """tree_id, store, tips (id and height, in order), n_tips, top: what a transaction starts from; store is null for the tree
    itself, and is_settings marks the settings store."""
    order = F.array_sort(F.collect_list(F.struct("entry_id", "height")))
    own = [order.alias("tips"), F.count(F.lit(1)).alias("n_tips"), F.max("height").alias("top")]
    tree = dag.tree_tips(entries, edges).groupBy("tree_id").agg(*own).withColumn("store", F.lit(None).cast("string"))
    stores = dag.store_tips(patches, store_edges).groupBy("tree_id", "store").agg(*own)
    return tree.unionByName(stores).withColumn("is_settings", F.coalesce(F.col("store") == settings_store, F.lit(False)))


def transact(entries: DataFrame, edges: DataFrame, patches: DataFrame, store_edges: DataFrame, new: DataFrame, auth: DataFrame | None = None, at: DataFrame | None = None, settings_store: str = SETTINGS) -> Batch:
    """The rows that new transactions (tree_id, entry_id, stores, signed) add.

    Each is one entry on the tips of its tree (or on the snapshot `at`, of which every tree has at least one tip), and one
    patch in each of its stores, whose parents are the store's tips as seen from there. settings_tips is the settings
    store's current snapshot, whatever the parents. auth (tree_id, auth: none, set or corrupted; see stores.settings)
    guards: a corrupted one lets nothing through, a set one only signed transactions. All or nothing of a transaction is
    added; one whose id is stored already adds nothing and is no error, so a batch can be run again.
    """
    fresh = new.dropDuplicates(["entry_id"]).join(entries.select("entry_id"), "entry_id", "left_anti")
    state = F.lit("none") if auth is None else F.coalesce("auth", F.lit("none"))
    guarded = fresh if auth is None else fresh.join(auth.select("tree_id", "auth"), "tree_id", "left")
    error = F.when(state == "corrupted", "CorruptedAuthConfiguration").when((state == "set") & ~F.coalesce("signed", F.lit(False)), "AuthenticationRequired")
    judged = guarded.withColumn("error", error)
    good = judged.where("error is null").select("tree_id", "entry_id", "stores")
    tips = dag.tree_tips(entries, edges) if at is None else entries.join(at.select("entry_id"), "entry_id", "left_semi")
    heads = tips.groupBy("tree_id").agg(canonical_snapshot(F.collect_list("entry_id")).alias("parents"), (F.max("height") + 1).alias("next_height"))
    pins = dag.store_tips(patches.where(F.col("store") == settings_store), store_edges.where(F.col("store") == settings_store))
    pinned = pins.groupBy("tree_id").agg(canonical_snapshot(F.collect_list("entry_id")).alias("settings_tips"))
    placed = good.join(heads, "tree_id", "left").join(pinned, "tree_id", "left")
    none = F.array().cast("array<string>")
    rows = placed.select("tree_id", "entry_id", F.coalesce("next_height", F.lit(0)).cast("bigint").alias("height"), F.col("parents").isNull().alias("is_root"), F.coalesce("settings_tips", none).alias("settings_tips"))
    links = placed.select("tree_id", F.col("entry_id").alias("child_id"), F.explode("parents").alias("parent_id"))
    touched = good.select("tree_id", "entry_id", F.explode(F.array_distinct("stores")).alias("store"))
    in_store = touched.join(store_heads(patches, store_edges, entries, edges, at), ["tree_id", "store"], "left")
    parts = in_store.select("tree_id", "store", "entry_id", F.coalesce("next_height", F.lit(0)).cast("bigint").alias("height"))
    store_links = in_store.select("tree_id", "store", F.col("entry_id").alias("child_id"), F.explode("parents").alias("parent_id"))
    return Batch(rows, links, parts, store_links, judged.where("error is not null").select("entry_id", "error"))


def with_transaction(begin: Callable, work: Callable, commit: Callable):  # noqa: ANN201
    """What commit makes of a begun transaction after work on it; an error in work commits nothing and is passed on."""
    transaction = begin()
    work(transaction)
    return commit(transaction)
