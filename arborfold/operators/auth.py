"""Permissions as ranks, key lookups and the checks of entries, as columns and joins.

A permission is (type, priority) with type Read, Write or Admin; a smaller priority is stronger. keys has (pubkey, name,
type, priority, status); requests refer to keys by a hint: global, a public key or a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborfold.operators.hierarchy import values

# Fixed value: the largest priority, an unsigned 32-bit number.
MAX_PRIORITY = 4_294_967_295


def rank(type_: Column, priority: Column) -> Column:
    """Read is 0, every Write is above it, every Admin above every Write."""
    write = F.lit(1 + MAX_PRIORITY) - priority.cast("bigint")
    admin = F.lit(2 + 2 * MAX_PRIORITY) - priority.cast("bigint")
    return F.when(type_ == "Read", F.lit(0).cast("bigint")).when(type_ == "Write", write).when(type_ == "Admin", admin)


def can_admin(ranked: Column) -> Column:
    return ranked > 1 + MAX_PRIORITY


def can_write(ranked: Column) -> Column:
    return ranked > 0


def allowed(ranked: Column, settings: Column) -> Column:
    """Settings need Admin, data Write or Admin."""
    return F.when(settings, can_admin(ranked)).otherwise(can_write(ranked))


def clamp(ranked: Column, maximum: Column, minimum: Column) -> Column:
    """A rank within bounds: never above the maximum, lifted to the minimum (null: none) unless that is above the maximum."""
    capped = F.least(ranked, maximum)
    return F.when(minimum.isNull() | (minimum > maximum), capped).otherwise(F.greatest(capped, minimum))


def signature_class(hint_set: Column, delegated: Column, signed: Column) -> Column:
    """unsigned, malformed or signed."""
    return F.when(delegated, F.when(signed, "signed").otherwise("malformed")).when(hint_set != signed, "malformed").when(signed, "signed").otherwise("unsigned")


def resolve(requests: DataFrame, keys: DataFrame, global_type: str | None, global_priority: int = 0, global_status: str = "Active") -> DataFrame:
    """Candidates of each request (id, hint_kind global, pubkey or name, hint): id, pubkey, ranked, status.

    A global hint names its own public key and has the global permission; a name may give several keys; a hint that
    matches nothing gives no row.
    """
    own = keys.select(F.col("pubkey").alias("k"), F.col("name").alias("n"), rank(F.col("type"), F.col("priority")).alias("ranked"), "status")
    by_key = requests.where("hint_kind = 'pubkey'").join(own, F.col("hint") == F.col("k"))
    by_name = requests.where("hint_kind = 'name'").join(own, F.col("hint") == F.col("n"))
    out = by_key.unionAll(by_name).select("id", F.col("k").alias("pubkey"), "ranked", "status")
    if global_type is not None:
        over = rank(F.lit(global_type), F.lit(global_priority))
        out = out.unionAll(requests.where("hint_kind = 'global'").select("id", F.col("hint").alias("pubkey"), over.alias("ranked"), F.lit(global_status).alias("status")))
    return out


def effective(candidates: DataFrame) -> DataFrame:
    """id, ranked: the strongest active candidate of each request."""
    return candidates.where("status = 'Active'").groupBy("id").agg(F.max("ranked").alias("ranked"))


def validate(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """entries (id, class, has_auth, settings, signer) with ok.

    Malformed entries fail, unsigned ones pass only where no keys are configured, signed ones only where some are and an
    active candidate key verifies the signature (it is the signer's) and may do what the entry does.
    """
    fits = candidates.where("status = 'Active'").select(F.col("id").alias("_i"), F.col("pubkey").alias("_k"), "ranked")
    joined = entries.join(fits, (F.col("id") == F.col("_i")) & (F.col("signer") == F.col("_k")), "left")
    best = joined.groupBy("id", "class", "has_auth", "settings").agg(F.max(F.coalesce(allowed(F.col("ranked"), F.col("settings")), F.lit(False))).alias("fits"))
    ok = F.when(F.col("class") == "malformed", F.lit(False)).when(F.col("class") == "unsigned", ~F.col("has_auth")).otherwise(F.col("has_auth") & F.col("fits"))
    return best.select("id", ok.alias("ok"))


def delegated(steps: DataFrame, start: DataFrame, max_steps: int = 10) -> DataFrame:
    """pubkey, ranked, n_steps of keys reached from start (node) over delegation steps, bounds narrowed at each step.

    steps has (node, next, max_rank, min_rank) for a delegation and (node, pubkey, ranked) for a key in the same table,
    the other columns being null. The narrowest maximum and the highest minimum of a way hold for the key at its end.
    """
    links = steps.where("next is not null").select(F.col("node").alias("_n"), "next", "max_rank", "min_rank")
    keys = steps.where("pubkey is not null").select(F.col("node").alias("_n"), "pubkey", "ranked")
    no = F.lit(None).cast("bigint")
    at = start.select("node", no.alias("hi"), no.alias("lo"), F.lit(0).alias("n_steps"))
    out = None
    for step in range(max_steps + 1):
        value = F.when(F.col("hi").isNull(), F.col("ranked")).otherwise(clamp(F.col("ranked"), F.col("hi"), F.col("lo")))
        here = at.join(keys, F.col("node") == F.col("_n")).select("pubkey", value.alias("ranked"), "n_steps")
        out = here if out is None else out.unionAll(here)
        if step < max_steps:
            moved = at.join(links, F.col("node") == F.col("_n"))
            at = moved.select(F.col("next").alias("node"), F.least("hi", "max_rank").alias("hi"), F.greatest("lo", "min_rank").alias("lo"), (F.col("n_steps") + 1).alias("n_steps")).distinct()
    return out


def find_sigkeys(keys: DataFrame, delegations: DataFrame, pubkeys: DataFrame) -> DataFrame:
    """tree_id, pubkey, via, ranked, place: every way in which wanted keys may sign in a tree, the strongest first.

    keys has (tree_id, pubkey, ranked, status), the global permission of a tree under the pubkey '*'; delegations has
    (tree_id, to_tree, max_rank, min_rank); pubkeys has (tree_id, pubkey). via is key, global, or the tree to which one
    step of delegation leads, where the key's own or the global permission counts within the delegation's bounds. Only
    active keys count; at equal rank the own key comes before the global one and that before delegations.
    """
    active = keys.where("status = 'Active'").select(F.col("tree_id").alias("_tree"), F.col("pubkey").alias("_key"), "ranked")
    own = active.where("_key <> '*'")
    over = active.where("_key = '*'").drop("_key")
    none = F.lit(None).cast("bigint")
    direct = pubkeys.join(own, (F.col("tree_id") == F.col("_tree")) & (F.col("pubkey") == F.col("_key"))).select("tree_id", "pubkey", F.lit("key").alias("via"), F.lit(0).alias("_order"), "ranked")
    by_all = pubkeys.join(over, F.col("tree_id") == F.col("_tree")).select("tree_id", "pubkey", F.lit("global").alias("via"), F.lit(1).alias("_order"), "ranked")
    steps = pubkeys.join(delegations.withColumnRenamed("tree_id", "_from"), F.col("tree_id") == F.col("_from"))
    there = own.unionByName(over.withColumn("_key", none.cast("string")))
    reached = steps.join(there, (F.col("to_tree") == F.col("_tree")) & (F.col("_key").isNull() | (F.col("_key") == F.col("pubkey"))))
    stepped = reached.select("tree_id", "pubkey", F.col("to_tree").cast("string").alias("via"), F.lit(2).alias("_order"), clamp(F.col("ranked"), F.col("max_rank"), F.col("min_rank")).alias("ranked"))
    every = direct.unionByName(by_all).unionByName(stepped.groupBy("tree_id", "pubkey", "via", "_order").agg(F.max("ranked").alias("ranked")))
    place = F.row_number().over(Window.partitionBy("tree_id", "pubkey").orderBy(F.desc("ranked"), "_order", "via"))
    return every.withColumn("place", place).drop("_order")


def highest(found: DataFrame) -> DataFrame:
    """tree_id, pubkey, ranked: the strongest way of find_sigkeys()."""
    return found.where("place = 1").select("tree_id", "pubkey", "ranked")


def can_change_key(signer: Column, target: Column) -> Column:
    """Whether a signer's rank may make or modify a key of the target rank: Admin, and no weaker than it."""
    return can_admin(signer) & (signer >= target)


def needs_auth(trees: DataFrame, keys: DataFrame) -> DataFrame:
    """trees (tree_id) with needs_auth: keys are configured, and there is no active global permission."""
    known = keys.groupBy(F.col("tree_id").alias("_t")).agg(F.bool_or((F.col("pubkey") == "*") & (F.col("status") == "Active")).alias("_open"))
    joined = trees.join(known, F.col("tree_id") == F.col("_t"), "left")
    return joined.select("tree_id", (F.col("_t").isNotNull() & ~F.coalesce("_open", F.lit(False))).alias("needs_auth"))


def key_states(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (tree_id, pubkey) with state ok, revoked, or no_key, and ranked: that of its active key, else the global one."""
    own = keys.where("pubkey <> '*'").select(F.col("tree_id").alias("_t"), F.col("pubkey").alias("_k"), F.col("ranked").alias("_own"), F.col("status").alias("_status"))
    over = keys.where("pubkey = '*' and status = 'Active'").select(F.col("tree_id").alias("_g"), F.col("ranked").alias("_all"))
    joined = wanted.join(own, (F.col("tree_id") == F.col("_t")) & (F.col("pubkey") == F.col("_k")), "left").join(over, F.col("tree_id") == F.col("_g"), "left")
    active = F.col("_status") == "Active"
    ranked = F.when(active, F.col("_own")).otherwise(F.col("_all"))
    state = F.when(ranked.isNotNull(), "ok").when(F.col("_k").isNotNull(), "revoked").otherwise("no_key")
    return joined.select("tree_id", "pubkey", state.alias("state"), ranked.alias("ranked"))


#: Fixed value: the most tips that a delegation step may claim.
MAX_TIPS = 64


def claims(requests: DataFrame, floors: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """id, state of delegation claims (id, tree_id, tips): too_many_tips, no_tips, not_found, not_in_tree, below_floor or ok.

    floors has (tree_id, entry_id): the snapshot at or above which claims must stand; every floor entry has to be one of
    the tips or above one. Trees without a floor take any claim. Ancestors of all claimed tips come from one contraction.
    """
    tips = requests.select("id", F.col("tree_id").alias("_tree"), F.explode(F.array_distinct("tips")).alias("_tip"))
    known = entries.select(F.col("entry_id").alias("_e"), F.col("tree_id").alias("_of"))
    placed = tips.join(known, F.col("_tip") == F.col("_e"), "left")
    wrong = placed.groupBy("id").agg(F.bool_or(F.col("_e").isNull()).alias("_lost"), F.bool_or(F.col("_of") != F.col("_tree")).alias("_foreign"))
    links = edges.select(F.col("child_id").alias("c"), F.col("parent_id").alias("p"))
    above = values(links, edges.select(F.col("parent_id").alias("n")).where("false"), "ancestors").select(F.col("n").alias("_a"), "ancestors")
    needed = floors.groupBy(F.col("tree_id").alias("_t")).agg(F.collect_set("entry_id").alias("_floor"))
    seen = placed.join(needed, F.col("_tree") == F.col("_t")).join(above, F.col("_tip") == F.col("_a"), "left")
    hits = F.filter(F.col("_floor"), lambda f: (f == F.col("_tip")) | F.array_contains(F.coalesce("ancestors", F.array().cast("array<string>")), f))
    covered = seen.select("id", "_floor", F.explode_outer(hits).alias("_hit")).groupBy("id", "_floor").agg(F.count_distinct("_hit").alias("_n"))
    short = covered.select("id", (F.col("_n") < F.size("_floor")).alias("_short"))
    joined = requests.select("id", "tips").join(wrong, "id", "left").join(short, "id", "left")
    n = F.coalesce(F.size("tips"), F.lit(0))
    state = F.when(n > MAX_TIPS, "too_many_tips").when(n <= 0, "no_tips").when(F.col("_lost"), "not_found").when(F.col("_foreign"), "not_in_tree").when(F.col("_short"), "below_floor").otherwise("ok")
    return joined.select("id", state.alias("state"))


def validate_pinned(entries: DataFrame, states: DataFrame, incomplete: DataFrame) -> DataFrame:
    """entry_id, valid of entries judged by the keys that they are pinned to; null where those cannot be known yet.

    entries has (entry_id, pin, hint_kind, hint, class, settings, signer); pin is the id of a settings snapshot, null for
    entries without one, for which no keys are configured. states has (pin, pubkey, name, type, priority, status), the
    keys at each pin, a global permission under the pubkey '*'; incomplete has (pin) of snapshots of which some part is
    missing here.
    """
    ranked = rank(F.col("type"), F.col("priority"))
    keys = states.where("status = 'Active'").select(F.col("pin").alias("_pin"), F.col("pubkey").alias("_k"), F.col("name").alias("_name"), ranked.alias("_rank"))
    asked = entries.where("class = 'signed'")
    by_key = asked.where("hint_kind = 'pubkey' and hint = signer").join(keys, (F.col("pin") == F.col("_pin")) & (F.col("hint") == F.col("_k")))
    by_name = asked.where("hint_kind = 'name'").join(keys, (F.col("pin") == F.col("_pin")) & (F.col("hint") == F.col("_name")) & (F.col("signer") == F.col("_k")))
    by_all = asked.where("hint_kind = 'global' and hint = signer").join(keys.where("_k = '*'"), F.col("pin") == F.col("_pin"))
    may = by_key.unionByName(by_name).unionByName(by_all).where(allowed(F.col("_rank"), F.col("settings"))).select(F.col("entry_id").alias("_may")).distinct()
    configured = states.select(F.col("pin").alias("_pin")).distinct()
    judged = entries.select("entry_id", "pin", "class").join(configured, F.col("pin") == F.col("_pin"), "left").join(may, F.col("entry_id") == F.col("_may"), "left")
    judged = judged.select("entry_id", "pin", "class", F.col("_pin").isNotNull().alias("_auth"), F.col("_may").isNotNull().alias("_good"))
    lost = incomplete.select(F.col("pin").alias("_lost")).distinct()
    ok = F.when(F.col("class") == "malformed", F.lit(False)).when(F.col("class") == "unsigned", ~F.col("_auth")).otherwise(F.col("_auth") & F.col("_good"))
    return judged.join(lost, F.col("pin") == F.col("_lost"), "left").select("entry_id", F.when(F.col("_lost").isNull(), ok).alias("valid"))
