"""Queries for permissions and replication bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfold.functions.times import utc_month
from arborfold.operators import auth, fold, sync
from arborfold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- permissions: nations are permissions, suppliers keys, events signed entries ----

_M = auth.MAX_PRIORITY


def _rank_sql(type_: str = "type", priority: str = "priority") -> str:
    return f"case {type_} when 'Read' then 0 when 'Write' then {_M + 1} - {priority} when 'Admin' then {2 * _M + 2} - {priority} end"


_PERMISSIONS = "p as (select n_nationkey, case n_nationkey % 3 when 0 then 'Admin' when 1 then 'Write' else 'Read' end as type, cast(n_nationkey as bigint) as priority from nation)"
_AUTH_KEYS = f"""{_PERMISSIONS}, keys as (select 'ed25519:' || s_suppkey as pubkey, case when s_suppkey % 5 <> 0 then 'key' || s_suppkey % 20 end as name, type, priority,
    {_rank_sql()} as ranked, case when s_suppkey % 4 = 0 then 'Revoked' else 'Active' end as status, s_suppkey from supplier join p on n_nationkey = s_nationkey)"""


def _permissions(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    kind = F.when(n % 3 == 0, "Admin").when(n % 3 == 1, "Write").otherwise("Read")
    return table(spark, folder, "nation").select("n_nationkey", kind.alias("type"), n.cast("bigint").alias("priority"))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    s, k = table(spark, folder, "supplier"), F.col("s_suppkey")
    joined = s.join(_permissions(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.concat(F.lit("ed25519:"), k.cast("string")).alias("pubkey"), F.when(k % 5 != 0, F.concat(F.lit("key"), (k % 20).cast("string"))).alias("name"),
        "type", "priority", F.when(k % 4 == 0, "Revoked").otherwise("Active").alias("status"), "s_suppkey",
    )


_ENTRIES = """e as (select event_id as id, user_id % 5 <> 0 as has_auth, event_type = 'signup' as settings,
    case event_id % 10 when 0 then null when 2 then null when 3 then 'global' when 4 then 'name' else 'pubkey' end as hint_kind,
    case event_id % 10 when 0 then null when 2 then null when 4 then 'key' || event_id % 23 else 'ed25519:' || user_id % 60 end as hint,
    event_id % 10 not in (0, 1) as signed, event_id % 29 = 28 as delegated, 'ed25519:' || case when event_id % 19 = 0 then 'other' when event_id % 10 = 4 then cast(event_id % 23 as varchar) else cast(user_id % 60 as varchar) end as signer from events)"""
_CLASS = "case when delegated then case when signed then 'signed' else 'malformed' end when (hint is not null) <> signed then 'malformed' when signed then 'signed' else 'unsigned' end"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id") % 60
    t = i % 10
    own = F.concat(F.lit("ed25519:"), u.cast("string"))
    hint = F.when(t.isin(0, 2), F.lit(None)).when(t == 4, F.concat(F.lit("key"), (i % 23).cast("string"))).otherwise(own)
    signer = F.when(i % 19 == 0, "ed25519:other").when(t == 4, F.concat(F.lit("ed25519:"), (i % 23).cast("string"))).otherwise(own)
    kind = F.when(t.isin(0, 2), F.lit(None)).when(t == 3, "global").when(t == 4, "name").otherwise("pubkey")
    signed = ~t.isin(0, 1)
    return table(spark, folder, "events").select(
        i.alias("id"), (F.col("user_id") % 5 != 0).alias("has_auth"), (F.col("event_type") == "signup").alias("settings"), kind.alias("hint_kind"), hint.alias("hint"),
        signer.alias("signer"), auth.signature_class(hint.isNotNull(), i % 29 == 28, signed).alias("class"),
    )


_CANDIDATES = f"""c as (select id, pubkey, ranked, status from e join keys on hint_kind = 'pubkey' and hint = pubkey
    union all select id, pubkey, ranked, status from e join keys on hint_kind = 'name' and hint = name
    union all select id, hint, {_M + 1} - 7, 'Active' from e where hint_kind = 'global')"""


@_query(f"with {_PERMISSIONS} select n_nationkey, {_rank_sql()} as ranked, row_number() over (order by {_rank_sql()} desc, n_nationkey) as place from p")
def v06_permission_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _permissions(spark, folder).select("n_nationkey", auth.rank(F.col("type"), F.col("priority")).alias("ranked"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ranked"), "n_nationkey")))


@_query(f"with {_AUTH_KEYS} select pubkey, ranked > 0 as data_ok, ranked > {_M + 1} as settings_ok from keys")
def v05_check_permission(spark: SparkSession, folder: str) -> DataFrame:
    r = auth.rank(F.col("type"), F.col("priority"))
    return _keys(spark, folder).select("pubkey", auth.allowed(r, F.lit(False)).alias("data_ok"), auth.allowed(r, F.lit(True)).alias("settings_ok"))


@_query(f"""with {_PERMISSIONS}, r as (select n_nationkey as n, {_rank_sql()} as r from p), b as (select a.n, a.r, x.r as hi, case when a.n % 4 = 0 then null else y.r end as lo
    from r a join r x on x.n = (a.n + 1) % 25 join r y on y.n = (a.n + 2) % 25)
    select n, case when lo is null or lo > hi then least(r, hi) else greatest(least(r, hi), lo) end as clamped from b""")
def v07_clamp(spark: SparkSession, folder: str) -> DataFrame:
    r = _permissions(spark, folder).select(F.col("n_nationkey").alias("n"), auth.rank(F.col("type"), F.col("priority")).alias("r"))
    hi = r.select(((F.col("n") + 24) % 25).alias("n"), F.col("r").alias("hi"))
    lo = r.select(((F.col("n") + 23) % 25).alias("n"), F.col("r").alias("lo"))
    b = r.join(hi, "n").join(lo, "n").withColumn("lo", F.when(F.col("n") % 4 != 0, F.col("lo")))
    return b.select("n", auth.clamp(F.col("r"), F.col("hi"), F.col("lo")).alias("clamped"))


@_query(f"with {_ENTRIES} select id, {_CLASS} as class from e")
def v04_sig_class(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, folder).select("id", "class")


@_query(f"with {_AUTH_KEYS}, {_ENTRIES}, {_CANDIDATES} select * from c")
def v08_resolve_hint(spark: SparkSession, folder: str) -> DataFrame:
    return auth.resolve(_entries(spark, folder), _keys(spark, folder), "Write", 7)


@_query(f"with {_AUTH_KEYS} select name, pubkey, row_number() over (partition by name order by ranked desc, pubkey) as place from keys where name is not null and status = 'Active'")
def v09_keys_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """The active keys of every name, strongest first."""
    ranked = _keys(spark, folder).where("name is not null and status = 'Active'").withColumn("ranked", auth.rank(F.col("type"), F.col("priority")))
    return ranked.select("name", "pubkey", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ranked"), "pubkey")).alias("place"))


@_query(f"with {_AUTH_KEYS}, {_ENTRIES}, {_CANDIDATES} select id, max(ranked) as ranked from c where status = 'Active' group by id")
def v10_effective(spark: SparkSession, folder: str) -> DataFrame:
    return auth.effective(auth.resolve(_entries(spark, folder), _keys(spark, folder), "Write", 7))


@_query(f"""with {_AUTH_KEYS}, {_ENTRIES}, {_CANDIDATES}
    select id, case {_CLASS} when 'malformed' then false when 'unsigned' then not has_auth
        else has_auth and exists (select 1 from c where c.id = e.id and status = 'Active' and pubkey = signer and ranked > case when settings then {_M + 1} else 0 end) end as ok from e""")
def v03_validate_entry(spark: SparkSession, folder: str) -> DataFrame:
    e = _entries(spark, folder)
    return auth.validate(e, auth.resolve(e, _keys(spark, folder), "Write", 7))


_STEPS = f"""{_AUTH_KEYS}, r as (select n_nationkey as n, {_rank_sql()} as r from p),
    links as (select s_suppkey as node, s_suppkey + 1 as next, x.r as max_rank, case when s_suppkey % 2 = 0 then y.r end as min_rank from supplier join r x on x.n = s_suppkey % 25 join r y on y.n = (s_suppkey + 7) % 25 where s_suppkey % 6 <> 5)"""


@_query(f"""with recursive {_STEPS},
    ways(node, hi, lo, n_steps) as (select s_suppkey, null::bigint, null::bigint, 0 from supplier where s_suppkey % 6 = 0
        union all select next, least(hi, max_rank), greatest(lo, min_rank), n_steps + 1 from ways join links using (node) where n_steps < 10)
    select pubkey, n_steps, case when hi is null then ranked when lo is null or lo > hi then least(ranked, hi) else greatest(least(ranked, hi), lo) end as ranked from ways join keys on s_suppkey = node""")
def v11_delegation(spark: SparkSession, folder: str) -> DataFrame:
    """Keys over delegation ways of up to ten steps (here: chains of six suppliers)."""
    keys = _keys(spark, folder)
    r = _permissions(spark, folder).select(F.col("n_nationkey").alias("n"), auth.rank(F.col("type"), F.col("priority")).alias("r"))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("node")).where("node % 6 <> 5")
    hi, lo = r.select(F.col("n").alias("h"), F.col("r").alias("max_rank")), r.select(F.col("n").alias("l"), F.col("r").alias("m"))
    links = s.join(hi, F.col("node") % 25 == F.col("h")).join(lo, (F.col("node") + 7) % 25 == F.col("l")).select("node", (F.col("node") + 1).alias("next"), "max_rank", F.when(F.col("node") % 2 == 0, F.col("m")).alias("min_rank"))
    own = keys.select(F.col("s_suppkey").alias("node"), "pubkey", auth.rank(F.col("type"), F.col("priority")).alias("ranked"))
    steps = links.unionByName(own, allowMissingColumns=True)
    start = keys.where("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("node"))
    return auth.delegated(steps, start).select("pubkey", "n_steps", "ranked")


# ---- replication: the node's sync history, peers, tips and entries ----

def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of one sync are equal in all fields; each counts once."""
    return table(spark, folder, "sync_history").dropDuplicates()


_SYNCS = "s as materialized (select distinct * from sync_history)"
_SETTINGS = "settings as (select tree_id, bool_or(success) as sync_enabled, bool_or(entries_count > 10) as sync_on_commit, min(case when duration_ms > 0 then duration_ms end) as interval_seconds from s where tree_id is not null group by tree_id)"


def _settings(syncs: DataFrame) -> DataFrame:
    """Settings rows in the form of M11, from the syncs of each tree."""
    rows = syncs.where("tree_id is not null").select("tree_id", F.col("success").alias("sync_enabled"), (F.col("entries_count") > 10).alias("sync_on_commit"), F.when(F.col("duration_ms") > 0, F.col("duration_ms")).alias("interval_seconds"))
    return fold.merge_settings(rows, ["tree_id"])


@_query(f"with {_SYNCS}, {_SETTINGS} select * from settings")
def m11_sync_settings(spark: SparkSession, folder: str) -> DataFrame:
    return _settings(_history(spark, folder))


@_query("select user_id, event_type as property, arg_max(cast(value as varchar), (ts, event_id)) as value from (select user_id, event_type, cast(value * 100 as bigint) as value, ts, event_id from events) group by all")
def m11_properties(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", F.col("event_type").alias("property"), F.round(F.col("value") * 100).cast("bigint").cast("string").alias("value"), "ts", "event_id")
    return fold.merge_properties(e, ["user_id"], ["ts", "event_id"])


@_query(f"""with {_SYNCS} select peer_pubkey, count(*) filter (success) as n_success, count(*) filter (not success) as n_failed, cast(coalesce(sum(entries_count) filter (success), 0) as bigint) as entries_synced,
    cast(coalesce(sum(bytes_transferred) filter (success), 0) as bigint) as bytes_synced, round(coalesce(avg(duration_ms) filter (success), 0), 4) as mean_ms,
    round(coalesce(count(*) filter (success) / nullif(count(success), 0), 0), 6) as success_rate from s where peer_pubkey is not null group by peer_pubkey""")
def m12_sync_stats(spark: SparkSession, folder: str) -> DataFrame:
    return sync.statistics(_history(spark, folder))


@_query(f"""with {_SYNCS}, {_SETTINGS}, tp as (select distinct tree_id, peer_pubkey as peer from s where peer_pubkey is not null)
    select peer, e.tree_id, id as entry_id from (select distinct tree_id, id from entries) e join tp using (tree_id) join settings using (tree_id) where sync_enabled and sync_on_commit""")
def y03_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry, as for peers that have nothing yet, for each peer that syncs its tree."""
    h = _history(spark, folder)
    return sync.fan_out(_new(spark, folder), _tree_peers(h), _settings(h))


def _new(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entries").select("tree_id", F.col("id").alias("entry_id")).distinct()


def _tree_peers(h: DataFrame) -> DataFrame:
    return h.where("peer_pubkey is not null and tree_id is not null").select("tree_id", F.col("peer_pubkey").alias("peer")).distinct()


@_query(f"""with {_SYNCS}, {_SETTINGS}, tp as (select distinct tree_id, peer_pubkey as peer from s where peer_pubkey is not null)
    select peer, count(*) as n_entries, min(id) as first_entry, max(id) as last_entry from (select distinct tree_id, id from entries) join tp using (tree_id) join settings using (tree_id) where sync_enabled and sync_on_commit group by peer""")
def y04_queue_drain(spark: SparkSession, folder: str) -> DataFrame:
    h = _history(spark, folder)
    return sync.queue_sizes(_new(spark, folder), _tree_peers(h), _settings(h))


@_query("select event_id, cast(pow(2, least(event_id % 13, 6)) * 1000 as bigint) as backoff_ms, case when event_id % 13 >= 10 then 'given_up' when user_id * 500 >= pow(2, least(event_id % 13, 6)) * 1000 then 'due' else 'waiting' end as state from events")
def y05_backoff(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("event_id") % 13
    return table(spark, folder, "events").select("event_id", sync.backoff_ms(a).alias("backoff_ms"), sync.retry_state(a, F.col("user_id") * 500).alias("state"))


@_query(f"with {_SYNCS}, w as (select peer_pubkey, sync_id, row_number() over (partition by peer_pubkey order by started_at desc, sync_id) as place from s where peer_pubkey is not null and started_at is not null) select * from w where place <= 5")
def y06_history_topk(spark: SparkSession, folder: str) -> DataFrame:
    known = _history(spark, folder).where("peer_pubkey is not null and started_at is not null")
    return sync.latest(known, "peer_pubkey", 5).select("peer_pubkey", "sync_id", "place")


@_query("select peer_pubkey as peer from sync_history where peer_pubkey is not null union select id from peers where id is not null")
def y07_peers_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "sync_history").select(F.col("peer_pubkey").alias("peer"))
    return a.union(table(spark, folder, "peers").select("id")).where("peer is not null").distinct()


@_query(f"with {_SYNCS} select strftime(started_at, '%Y-%m') as month, count(*) as n from s where started_at < timestamptz '2025-04-01 00:00:00+00' group by all")
def y08_retention(spark: SparkSession, folder: str) -> DataFrame:
    """How many syncs of each month a clean-up before April 2025 removes."""
    old = sync.expired(_history(spark, folder), F.lit("2025-04-01T00:00:00Z").cast("timestamp"))
    return old.groupBy(utc_month(F.col("started_at")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@_query("select distinct id, a.transport_type as transport_type, a.address as address from (select id, unnest(addresses) as a from peers) where a.transport_type = 'http'")
def y09_peer_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return sync.addresses(table(spark, folder, "peers"), "http")


@_query("""select event_id as id, user_id as key from (select *, row_number() over (partition by user_id, value order by event_id) as r
    from (select * from events where abs(event_id * 1000 - 400000) <= 60000)) where r = 1""")
def y12_freshness(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("value").alias("nonce"), (F.col("event_id") * 1000).alias("ms"))
    return sync.fresh(r, F.lit(400_000)).select("id", "key")


@_query("select trim(display_name) as name, count(*) as n, case when count(*) > 1 then 'duplicates' when max(status) <> 'Active' then 'inactive' else 'ok' end as state from (select distinct id, display_name, status from peers where display_name is not null) group by 1")
def y14_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "peers").where("display_name is not null").select("id", F.trim("display_name").alias("display_name"), "status").distinct()
    return sync.name_states(named, "display_name", "status")


@_query(f"with {_SYNCS} select tree_id, count(distinct peer_pubkey) as n_peers, min(peer_pubkey) as first_peer from s where peer_pubkey is not null and tree_id is not null group by tree_id")
def y15_tree_peers(spark: SparkSession, folder: str) -> DataFrame:
    return _tree_peers(_history(spark, folder)).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_peers"), F.min("peer").alias("first_peer"))


@_query(f"with {_SYNCS} select peer_pubkey as peer, count(distinct tree_id) as n_trees from s where peer_pubkey is not null and tree_id is not null group by 1")
def y15_trees_of_peers(spark: SparkSession, folder: str) -> DataFrame:
    return _tree_peers(_history(spark, folder)).groupBy("peer").agg(F.count(F.lit(1)).alias("n_trees"))


@_query(f"""with {_SYNCS}, c as (select peer_pubkey, tree_id, arg_max(sync_id, (completed_at, sync_id)) as last_sync_id, sum(coalesce(entries_count, 0)) as total_entries from s
        where success and completed_at is not null and peer_pubkey is not null and tree_id is not null group by all),
    want as (select distinct peer_pubkey, tree_id from s where peer_pubkey is not null and tree_id is not null)
    select peer_pubkey, tree_id, last_sync_id, cast(coalesce(total_entries, 0) as bigint) as total_entries from want left join c using (peer_pubkey, tree_id)""")
def y17_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The cursor of every (peer, tree), a default one where no sync has succeeded."""
    h = _history(spark, folder)
    want = h.where("peer_pubkey is not null and tree_id is not null").select("peer_pubkey", "tree_id").distinct()
    return want.join(sync.cursors(h), ["peer_pubkey", "tree_id"], "left").select("peer_pubkey", "tree_id", "last_sync_id", F.coalesce("total_entries", F.lit(0)).alias("total_entries"))


@_query(f"with {_SYNCS}, {_SETTINGS} select r.id as tree_id, coalesce(sync_enabled, false) as enabled from (select distinct id from entries where is_root) r left join settings on tree_id = r.id")
def y18_sync_enabled(spark: SparkSession, folder: str) -> DataFrame:
    """Fails closed: trees without settings are not enabled."""
    roots = table(spark, folder, "entries").where("is_root").select(F.col("id").alias("root")).distinct()
    joined = roots.join(_settings(_history(spark, folder)), F.col("root") == F.col("tree_id"), "left")
    return joined.select(F.col("root").alias("tree_id"), F.coalesce("sync_enabled", F.lit(False)).alias("enabled"))


@_query("""select id, n_tips from (select distinct id from entries where is_root and id not in (select coalesce(tree_id, '') from tips where store_name in ('_settings', '_index')))
    left join (select tree_id, count(distinct entry_id) as n_tips from tips where store_name = '' group by 1) on tree_id = id""")
def y20_db_list(spark: SparkSession, folder: str) -> DataFrame:
    """Roots without system stores, with their recorded tips."""
    tips = table(spark, folder, "tips")
    system = tips.where("store_name in ('_settings', '_index')").select(F.col("tree_id").alias("id"))
    roots = table(spark, folder, "entries").where("is_root").select("id").distinct().join(system, "id", "left_anti")
    n = tips.where("store_name = ''").groupBy(F.col("tree_id").alias("id")).agg(F.count_distinct("entry_id").alias("n_tips"))
    return roots.join(n, "id", "left").select("id", "n_tips")


@_query(f"with {_AUTH_KEYS}, {_ENTRIES} select id, coalesce((select ranked from keys where pubkey = signer and status = 'Active'), {_M + 1} - 7) as ranked from e where has_auth")
def v15_identity_permission(spark: SparkSession, folder: str) -> DataFrame:
    """The permission of each signer: that of its own active key, else the global one."""
    own = _keys(spark, folder).where("status = 'Active'").select(F.col("pubkey").alias("signer"), auth.rank(F.col("type"), F.col("priority")).alias("own"))
    e = _entries(spark, folder).where("has_auth").select("id", "signer")
    return e.join(own, "signer", "left").select("id", F.coalesce("own", auth.rank(F.lit("Write"), F.lit(7))).alias("ranked"))


@_query("select id, case when verification_status = 2 and height % 3 = 0 then 0 else verification_status end as status from (select id, height, arg_max(verification_status, (received_at, verification_status)) as verification_status from entries group by id, height)")
def v12_status_update(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivered status of every entry; unverified ones of every third height are set to verified."""
    last = table(spark, folder, "entries").groupBy("id", "height").agg(F.max_by("verification_status", F.struct("received_at", "verification_status")).alias("s"))
    return last.select("id", F.when((F.col("s") == 2) & (F.col("height") % 3 == 0), 0).otherwise(F.col("s")).alias("status"))


@_query(f"with {_SYNCS}, {_SETTINGS}, tp as (select distinct tree_id, peer_pubkey as peer from s where peer_pubkey is not null) select peer, count(*) as n_trees, bool_or(sync_enabled) as any_enabled, min(interval_seconds) as shortest from tp join settings using (tree_id) group by peer")
def y11_settings_of_peers(spark: SparkSession, folder: str) -> DataFrame:
    """The combined settings of all trees that a peer syncs."""
    h = _history(spark, folder)
    joined = _tree_peers(h).join(_settings(h), "tree_id")
    return joined.groupBy("peer").agg(F.count(F.lit(1)).alias("n_trees"), F.bool_or("sync_enabled").alias("any_enabled"), F.min("interval_seconds").alias("shortest"))
