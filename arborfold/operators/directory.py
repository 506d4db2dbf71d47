"""Lookups in the node's own tables: peers, users, keys, bootstrap requests, and which of them go with which trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.operators import fold


def latest_peers(peers: DataFrame) -> DataFrame:
    """One row per peer: of several deliveries the last seen one, then the first by status and name."""
    order = F.struct(F.coalesce(F.unix_micros("last_seen"), F.lit(-1)).alias("seen"), "status", "display_name")
    return peers.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*[c for c in peers.columns if c != "id"]), order).alias("_p")).select("id", "_p.*")


def registry(peers: DataFrame, tree_peers: DataFrame) -> DataFrame:
    """id, display_name, status, n_addresses, n_trees of every peer; names without blanks around them, null if empty."""
    n = tree_peers.select(F.col("peer").alias("_peer"), "tree_id").distinct().groupBy("_peer").agg(F.count(F.lit(1)).alias("n_trees"))
    name = F.trim("display_name")
    rows = latest_peers(peers).join(n, F.col("id") == F.col("_peer"), "left")
    return rows.select("id", F.when(name != "", name).alias("display_name"), "status", F.coalesce(F.size("addresses"), F.lit(0)).alias("n_addresses"), F.coalesce("n_trees", F.lit(0)).alias("n_trees"))


def in_state(requests: DataFrame, state: Column, wanted: str) -> DataFrame:
    """Bootstrap requests (or any records) in a state: pending, approved or rejected, say."""
    return requests.where(state == wanted)


def request_states(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last state of each request; decisions are later rows of the same request."""
    return fold.last_writer(requests, keys, ["state"], order).select(*keys, "state")


def users(records: DataFrame, name: Column | None = None, wanted: str | None = None) -> DataFrame:
    """id, name, status of all user records, or of those with one name; names without blanks around them."""
    each = records.where("display_name is not null").select("id", F.trim("display_name").alias("name"), "status").distinct()
    return each if wanted is None else each.where(F.col("name") == wanted)


def linked(tree_users: DataFrame, by: str, to: str) -> DataFrame:
    """by, links: for each user its databases, or for each database its users, in order and each once.

    The pairs of one key are gathered in one list, as that list is the answer; see link_counts() for large ones.
    """
    return tree_users.select(by, to).dropna().distinct().groupBy(by).agg(F.array_sort(F.collect_list(to)).alias("links"))


def link_counts(tree_users: DataFrame, by: str, to: str) -> DataFrame:
    """by, n_links, first_link without gathering lists."""
    return tree_users.select(by, to).dropna().distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n_links"), F.min(to).alias("first_link"))


def combined_settings(links: DataFrame, settings: DataFrame) -> DataFrame:
    """tree_id with the settings of all its users combined; a database without links has none. See fold.merge_settings()."""
    return fold.merge_settings(links.join(settings, ["user_id", "tree_id"], "left"), ["tree_id"])


def ordered_keys(keys: DataFrame, owner: str) -> DataFrame:
    """keys (owner, key, created_at, is_default) with place, the oldest first; ties in the order of keys."""
    w = Window.partitionBy(owner).orderBy(F.asc_nulls_last("created_at"), "key")
    return keys.withColumn("place", F.row_number().over(w))


def default_keys(keys: DataFrame, owner: str) -> DataFrame:
    """owner, key: the key flagged as default (the oldest of several), else the oldest one."""
    at = F.struct((~F.coalesce("is_default", F.lit(False))).alias("flag"), F.col("created_at").isNull().alias("unknown"), "created_at", "key")
    return keys.groupBy(owner).agg(F.min_by("key", at).alias("key"))


def keys_for_databases(wanted: DataFrame, mappings: DataFrame, defaults: DataFrame) -> DataFrame:
    """wanted (owner, tree_id) with key and how: explicit (mapped to a key), self (mapped to the default key) or none.

    mappings has (owner, tree_id, mapped): a key, or null for the owner's default one; defaults has (owner, key).
    """
    m = mappings.select(F.col("owner").alias("_o"), F.col("tree_id").alias("_t"), "mapped", F.lit(True).alias("_is"))
    d = defaults.select(F.col("owner").alias("_d"), F.col("key").alias("_key"))
    joined = wanted.join(m, (F.col("owner") == F.col("_o")) & (F.col("tree_id") == F.col("_t")), "left").join(d, F.col("owner") == F.col("_d"), "left")
    how = F.when(F.col("_is").isNull(), "none").when(F.col("mapped").isNotNull(), "explicit").otherwise("self")
    return joined.select("owner", "tree_id", how.alias("how"), F.when(how == "explicit", F.col("mapped")).when(how == "self", F.col("_key")).alias("key"))
