"""Queries for registries, settings, transactions and verification against pinned keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfold.operators import auth, stores, tables, transactions, verify
from arborfold.plans.graph_queries import _TIPS, _VERIFY, _cut, _cut_sql, _query_into, _up
from arborfold.plans.history import History
from arborfold.plans.service_queries import _AUTH_KEYS, _keys, _rank_sql
from arborfold.plans.state_queries import _ALIVE
from arborfold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_query = _query_into(QUERIES, SQL)
_M = auth.MAX_PRIORITY


def _plain(sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- registries and settings: documents of each user's events ----

def _documents(spark: SparkSession, folder: str, nodes: F.Column, when: str) -> tables.Documents:
    rows = table(spark, folder, "events").where(when).select("user_id", "event_id", F.explode(nodes).alias("n"))
    each = rows.select("user_id", "n.path", F.transform("n.path", lambda _: F.lit("d")).alias("cont"), "n.kind", "n.value", F.col("event_id").alias("height"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("entry_id"))
    return tables.Documents(each, ["user_id"])


def _node(path: list, kind: object, value: object = None) -> F.Column:
    as_column = lambda x: x if isinstance(x, F.Column) else F.lit(x)
    return F.struct(F.array(*map(as_column, path)).alias("path"), as_column(kind).alias("kind"), as_column(value).cast("string").alias("value"))


def _with_documents(select: str) -> str:
    """The folded documents of a selection of (user_id, event_id, path, kind, value), as the table expression `state`."""
    rows = f"pe as materialized (select user_id, path, [x for x in list_transform(path, lambda p: 'd')] as cont, kind, value, event_id as height, lpad(cast(event_id as varchar), 12, '0') as entry_id from ({select}))"
    return f"with {rows},{_ALIVE.split('events)))', 1)[1].lstrip().removeprefix(',')}"


def _registry(spark: SparkSession, folder: str) -> stores.Registry:
    i, name = F.col("event_id"), F.col("event_type")
    gone = F.array(_node([name], "deleted"))
    put = F.array(_node([name], "doc"), _node([name, "type"], "text", F.when(i % 2 == 0, "docstore").otherwise("table")), _node([name, "config"], "text", F.col("props")))
    return stores.Registry(_documents(spark, folder, F.when(i % 5 == 0, gone).otherwise(put), "true"))


_REGISTRY = _with_documents("""
    select user_id, event_id, [event_type] as path, case when event_id % 5 = 0 then 'deleted' else 'doc' end as kind, null::varchar as value from events
    union all select user_id, event_id, [event_type, 'type'], 'text', case when event_id % 2 = 0 then 'docstore' else 'table' end from events where event_id % 5 <> 0
    union all select user_id, event_id, [event_type, 'config'], 'text', props from events where event_id % 5 <> 0""")
_REGISTERED = "select a.user_id, a.path[1] as name, a.value as type, b.value as config from state a join state b on a.user_id = b.user_id and a.path[1] = b.path[1] where a.path[2] = 'type' and b.path[2] = 'config' and a.kind = 'text' and b.kind = 'text'"


@_plain(f"{_REGISTRY} {_REGISTERED}")
def t16_registry_list(spark: SparkSession, folder: str) -> DataFrame:
    """The registered stores of every database with their types and configurations."""
    return _registry(spark, folder).all()


@_plain(f"""{_REGISTRY}, r as ({_REGISTERED}), wanted as (select distinct cast(user_id as varchar) as tree_id, event_type as store, 'table' as type from events union all select distinct cast(user_id as varchar), '_settings', 'docstore' from events)
    select tree_id, store, w.type, case when store like '\\_%' escape '\\' then 'system' when r.type is null then 'registered' when r.type = w.type then 'ok' else 'type_mismatch' end as state
    from wanted w left join r on cast(r.user_id as varchar) = tree_id and r.name = store""")
def w02_open_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every store of every database opened as a table, and its settings."""
    known = _registry(spark, folder).all().withColumn("tree_id", F.col("user_id").cast("string"))
    users = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("tree_id"), F.col("event_type").alias("store")).distinct()
    wanted = users.withColumn("type", F.lit("table")).unionByName(users.select("tree_id").distinct().select("tree_id", F.lit("_settings").alias("store"), F.lit("docstore").alias("type")))
    return stores.open_states(known, wanted)


def _settings(spark: SparkSession, folder: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    name = F.array(_node(["name"], "text", F.concat(t, F.lit("-"), (F.col("user_id") % 7).cast("string"))))
    height = F.array(_node(["height_strategy"], "text", F.when(i % 3 == 0, "timestamp").otherwise("incremental")))
    key = F.concat(F.lit("k"), (i % 5).cast("string"))
    keys = F.array(_node(["auth"], "doc"), _node(["auth", "keys"], "doc"), _node(["auth", "keys", key], F.when(i % 9 == 0, "deleted").otherwise("text"), F.when(i % 9 != 0, t)))
    broken = F.array(_node(["auth"], F.when(i % 2 == 0, "deleted").otherwise("int"), F.when(i % 2 == 1, "7")))
    nodes = F.when(i % 31 == 7, broken).when(i % 4 == 0, name).when(i % 4 == 1, height).when(i % 4 == 2, keys)
    return stores.settings(_documents(spark, folder, nodes, "event_id % 31 = 7 or event_id % 4 <> 3"))


_SETTINGS = _with_documents("""
    with e as (select *, case when event_id % 31 = 7 then 'broken' else ['name', 'height', 'keys', 'none'][event_id % 4 + 1] end as what from events)
    select user_id, event_id, ['auth'] as path, case when event_id % 2 = 0 then 'deleted' else 'int' end as kind, case when event_id % 2 = 1 then '7' end as value from e where what = 'broken'
    union all select user_id, event_id, ['name'], 'text', event_type || '-' || user_id % 7 from e where what = 'name'
    union all select user_id, event_id, ['height_strategy'], 'text', case when event_id % 3 = 0 then 'timestamp' else 'incremental' end from e where what = 'height'
    union all select user_id, event_id, unnest([['auth'], ['auth', 'keys']]), 'doc', null from e where what = 'keys'
    union all select user_id, event_id, ['auth', 'keys', 'k' || event_id % 5], case when event_id % 9 = 0 then 'deleted' else 'text' end, case when event_id % 9 <> 0 then event_type end from e where what = 'keys'""")
_FOLDED = """f as (select user_id, max(case when path = ['name'] and kind = 'text' then value end) as name, coalesce(max(case when path = ['height_strategy'] and kind = 'text' then value end), 'incremental') as height_strategy,
    case max(case when path = ['auth'] then kind end) when 'doc' then 'set' else case when max(case when path = ['auth'] then kind end) is null then 'none' else 'corrupted' end end as auth,
    count(*) filter (len(path) = 3 and path[1:2] = ['auth', 'keys'] and kind <> 'deleted') as n_keys from state group by user_id)"""


@_plain(f"{_SETTINGS}, {_FOLDED} select * from f")
def t17_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The settings of every database."""
    return _settings(spark, folder)


@_plain(f"{_SETTINGS}, {_FOLDED} select cast(user_id as varchar) as tree_id, name from f where name = 'view-3'")
def t18_find_database(spark: SparkSession, folder: str) -> DataFrame:
    """Databases whose name in their settings is the one asked for."""
    known = _settings(spark, folder).withColumn("tree_id", F.col("user_id").cast("string"))
    try:
        return stores.find_database(known.select("tree_id"), known, "view-3").select("tree_id", "name")
    except stores.DatabaseNotFound:
        return known.select("tree_id", "name").where("false")


# ---- transactions ----

_NEW_AUTH = "case when tree_id like '%5' then 'corrupted' when tree_id like '%2' then 'set' else 'none' end"
_ERROR = f"case {_NEW_AUTH} when 'corrupted' then 'CorruptedAuthConfiguration' when 'set' then case when tree_id like '1%' then null else 'AuthenticationRequired' end end"


def _batch(h: History, at: DataFrame | None = None) -> transactions.Batch:
    """One transaction on every tree, in three stores of which one is new."""
    trees = h.entries.select("tree_id").distinct()
    new = trees.select("tree_id", F.concat(F.lit("new-"), "tree_id").alias("entry_id"), F.array(*map(F.lit, ("view", "click", "brandnew"))).alias("stores"), F.startswith("tree_id", F.lit("1")).alias("signed"))
    kind = F.when(F.endswith("tree_id", F.lit("5")), "corrupted").when(F.endswith("tree_id", F.lit("2")), "set").otherwise("none")
    return transactions.transact(h.entries, h.edges, h.patches, h.store_edges, new, trees.select("tree_id", kind.alias("auth")), at, "signup")


@_query(f"""
    , tips as ({_TIPS}), pins as (select tree_id, string_agg(entry_id, ',' order by entry_id) as pin from patches p where store = 'signup' and not exists (select 1 from store_edges s where s.parent_id = p.entry_id and s.store = 'signup') group by tree_id),
    t as (select tree_id, max(height) + 1 as height, string_agg(entry_id, ',' order by entry_id) as parents from tips join entries_ using (tree_id, entry_id) group by tree_id)
    select 'new-' || tree_id as entry_id, {_ERROR} as error, case when {_ERROR} is null then height end as height, case when {_ERROR} is null then parents end as parents, case when {_ERROR} is null then coalesce(pin, '') end as settings_tips from t left join pins using (tree_id)""")
def w01_transactions(h: History) -> DataFrame:
    """What one transaction on every tree adds, and those that the keys do not allow."""
    b = _batch(h)
    parents = b.edges.groupBy(F.col("child_id").alias("entry_id")).agg(F.array_join(F.array_sort(F.collect_list("parent_id")), ",").alias("parents"))
    added = b.entries.join(parents, "entry_id").select("entry_id", "height", "parents", F.array_join("settings_tips", ",").alias("settings_tips"))
    return added.unionByName(b.errors, allowMissingColumns=True)


@_query(f"""{_up("seen", _cut_sql(2))}, kept as materialized (select * from patches where entry_id in (from seen)),
    heads as (select tree_id, store, max(height) + 1 as height, string_agg(entry_id, ',' order by entry_id) as parents from kept k where not exists (select 1 from store_edges s join kept c on c.entry_id = s.child_id where s.parent_id = k.entry_id) group by all)
    select 'new-' || tree_id as entry_id, store, coalesce(heads.height, 0) as height, parents from (select distinct tree_id from entries_) cross join (select unnest(['view', 'click', 'brandnew']) as store) left join heads using (tree_id, store) where {_ERROR} is null""")
def w03_store_parents(h: History) -> DataFrame:
    """The patches of a transaction on an older snapshot of every tree: parents are the stores' tips as seen from there."""
    b = _batch(h, _cut(h, 2))
    parents = b.store_edges.groupBy("store", F.col("child_id").alias("entry_id")).agg(F.array_join(F.array_sort(F.collect_list("parent_id")), ",").alias("parents"))
    return b.patches.join(parents, ["store", "entry_id"], "left").select("entry_id", "store", "height", "parents")


@_query(f"""
    , st as (select tree_id, store, entry_id, height from patches p where not exists (select 1 from store_edges s where s.parent_id = p.entry_id and s.store = p.store)),
    every as (select tree_id, cast(null as varchar) as store, entry_id, height from ({_TIPS}) join entries_ using (tree_id, entry_id) union all select * from st)
    select tree_id, store, count(*) as n_tips, max(height) as top, string_agg(entry_id || ':' || height, ',' order by entry_id) as tips, coalesce(store = 'signup', false) as is_settings from every group by tree_id, store""")
def t21_transaction_context(h: History) -> DataFrame:
    found = transactions.context(h.entries, h.edges, h.patches, h.store_edges, "signup")
    texts = F.array_join(F.transform("tips", lambda t: F.concat_ws(":", t["entry_id"], t["height"].cast("string"))), ",")
    return found.withColumn("tips", texts)


# ---- verification against the keys that entries are pinned to: sign-ups are settings patches that set a key ----

_PIN = """
    , sk as materialized (select entry_id, height, case when event_id % 6 = 5 then '*' else 'k' || event_id % 6 end as pubkey, 'n' || event_id % 4 as name, case event_id % 3 when 0 then 'Admin' when 1 then 'Write' else 'Read' end as type,
        event_id % 10 as priority, case when event_id % 4 = 0 then 'Revoked' else 'Active' end as status, event_id % 89 = 3 as gone from patches where store = 'signup'),
    se as materialized (select * from store_edges where store = 'signup'),
    pinned as materialized (select entry_id, last_value(case when event_type = 'signup' then lpad(cast(event_id as varchar), 12, '0') end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as pin,
        case event_id % 10 when 0 then null when 2 then null when 3 then 'global' when 4 then 'name' else 'pubkey' end as hint_kind,
        case event_id % 10 when 0 then null when 2 then null when 4 then 'n' || event_id % 5 else 'k' || event_id % 7 end as hint, event_id % 10 not in (0, 1) as signed, event_id % 29 = 28 as delegated,
        case when event_id % 19 = 0 then 'other' when event_id % 10 = 4 then 'k' || event_id % 6 else 'k' || event_id % 7 end as signer, event_type = 'signup' as settings
        from (select *, lpad(cast(event_id as varchar), 12, '0') as entry_id from events)),
    up(pin, entry_id) as (select entry_id, entry_id from sk union select up.pin, parent_id from up join se on child_id = up.entry_id),
    lost as (select distinct pin from up join sk using (entry_id) where gone),
    st as materialized (select pin, pubkey, name, type, priority, status from up join sk using (entry_id) where not gone qualify row_number() over (partition by pin, pubkey order by height desc, entry_id desc) = 1),"""
_PIN_VALID = f"""
    may as (select entry_id from pinned p join st on st.pin = p.pin and status = 'Active' and {_rank_sql()} > case when settings then {_M + 1} else 0 end
        and (hint_kind = 'pubkey' and hint = pubkey and pubkey = signer or hint_kind = 'name' and hint = name and pubkey = signer or hint_kind = 'global' and pubkey = '*' and hint = signer)),
    judgement as materialized (select entry_id, case when pin in (select pin from lost) then null
        when (delegated and not signed) or (not delegated and (hint is not null) <> signed) then false
        when not signed then not coalesce(pin in (select pin from st), false) else coalesce(pin in (select pin from st), false) and entry_id in (from may) end as valid from pinned)"""


def _pinned(h: History) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("event_id")
    t = i % 10
    before = Window.partitionBy("tree_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    pin = F.last(F.when(F.col("store") == "signup", F.col("entry_id")), ignorenulls=True).over(before)
    own = F.concat(F.lit("k"), (i % 7).cast("string"))
    hint = F.when(t.isin(0, 2), F.lit(None)).when(t == 4, F.concat(F.lit("n"), (i % 5).cast("string"))).otherwise(own)
    signer = F.when(i % 19 == 0, "other").when(t == 4, F.concat(F.lit("k"), (i % 6).cast("string"))).otherwise(own)
    kind = F.when(t.isin(0, 2), F.lit(None)).when(t == 3, "global").when(t == 4, "name").otherwise("pubkey")
    signed = h.events.select("entry_id", pin.alias("pin"), kind.alias("hint_kind"), hint.alias("hint"), signer.alias("signer"), auth.signature_class(hint.isNotNull(), i % 29 == 28, ~t.isin(0, 1)).alias("class"), (F.col("store") == "signup").alias("settings"))
    entries = h.entries.join(signed, "entry_id")
    keys = h.patches.where("store = 'signup' and event_id % 89 <> 3").select(
        "entry_id", "height", F.when(i % 6 == 5, "*").otherwise(F.concat(F.lit("k"), (i % 6).cast("string"))).alias("pubkey"), F.concat(F.lit("n"), (i % 4).cast("string")).alias("name"),
        F.when(i % 3 == 0, "Admin").when(i % 3 == 1, "Write").otherwise("Read").alias("type"), t.alias("priority"), F.when(i % 4 == 0, "Revoked").otherwise("Active").alias("status"),
    )
    return entries, keys, h.store_edges.where("store = 'signup'")


@_query(f"""{_PIN}{_PIN_VALID}, checked as materialized (select e.* replace (j.valid as valid) from entries_ e join judgement j using (entry_id))
    {_VERIFY.replace("entries_", "checked")} select entry_id, new_status, valid from judged""")
def v01_verify_pinned(h: History) -> DataFrame:
    """One verification pass in which every entry is checked against the keys it is pinned to, some of which are not here."""
    entries, keys, links = _pinned(h)
    return verify.verify_pinned(entries, h.edges, keys, links).select("entry_id", "new_status", "valid")


_CLAIMS = "tips as (select entry_id as id, tree_id, unnest([entry_id, lag(entry_id, 5) over (partition by tree_id order by height)]) as tip from entries_), known as (select * from tips where tip is not null and id in (select entry_id from entries_ where store = 'purchase'))"


@_query(f""", {_CLAIMS}, up(tip, entry_id) as (select distinct tip, tip from known union select tip, parent_id from up join edges on child_id = up.entry_id),
    floors as (select tree_id, entry_id from entries_ where entry_id in ({_cut_sql(3)})),
    hit as (select distinct id from known join up using (tip) join floors f on f.tree_id = known.tree_id and f.entry_id = up.entry_id)
    select distinct id, case when tree_id like '%7' then 'not_in_tree' when id in (from hit) then 'ok' else 'below_floor' end as state from known""")
def v11_claims(h: History) -> DataFrame:
    """Every purchase claims itself and the fifth entry before it as a delegated snapshot, some of them of another tree."""
    w = Window.partitionBy("tree_id").orderBy("height")
    asked = h.entries.withColumn("before", F.lag("entry_id", 5).over(w)).where("store = 'purchase'")
    tree = F.when(F.endswith("tree_id", F.lit("7")), F.lit("another")).otherwise(F.col("tree_id"))
    requests = asked.select(F.col("entry_id").alias("id"), tree.alias("tree_id"), F.array_compact(F.array("entry_id", "before")).alias("tips"))
    floors = h.entries.join(_cut(h, 3).select("entry_id"), "entry_id", "left_semi").select("tree_id", "entry_id")
    return auth.claims(requests, floors, h.entries, h.edges)


# ---- keys of trees: suppliers are keys of their nation's tree, which delegates to two others ----

_TREE_KEYS = f"""{_AUTH_KEYS}, k as (select s_nationkey as tree_id, case when keys.s_suppkey % 9 = 4 then '*' else 'ed25519:' || keys.s_suppkey % 12 end as pubkey, max(ranked) as ranked, max(status) as status from keys join supplier using (s_suppkey) group by all),
    r as (select n_nationkey as n, {_rank_sql()} as r from p)"""


def _tree_keys(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("tree_id"))
    own = _keys(spark, folder).drop("pubkey").join(nations, "s_suppkey")
    pubkey = F.when(F.col("s_suppkey") % 9 == 4, "*").otherwise(F.concat(F.lit("ed25519:"), (F.col("s_suppkey") % 12).cast("string")))
    return own.groupBy("tree_id", pubkey.alias("pubkey")).agg(F.max(auth.rank(F.col("type"), F.col("priority"))).alias("ranked"), F.max("status").alias("status"))


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    pubkeys = F.explode(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.concat(F.lit("ed25519:"), i.cast("string"))))
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("tree_id"), pubkeys.alias("pubkey"))


def _sigkeys(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    steps = table(spark, folder, "nation").select(n.alias("tree_id"), F.explode(F.array((n + 1) % 25, (n + 7) % 25)).alias("to_tree"))
    ranks = table(spark, folder, "nation").select(n.alias("_n"), auth.rank(F.when(n % 3 == 0, "Admin").when(n % 3 == 1, "Write").otherwise("Read"), n).alias("max_rank"))
    low = ranks.select(F.col("_n").alias("_m"), F.col("max_rank").alias("min_rank"))
    bounds = steps.join(ranks, F.col("to_tree") == F.col("_n")).join(low, (F.col("to_tree") + 3) % 25 == F.col("_m"))
    return auth.find_sigkeys(_tree_keys(spark, folder), bounds.select("tree_id", "to_tree", "max_rank", F.when(F.col("tree_id") % 2 == 0, F.col("min_rank")).alias("min_rank")), _wanted(spark, folder))


_WANTED = "wanted as (select n_nationkey as tree_id, 'ed25519:' || i as pubkey from nation, range(13) t(i))"
_SIGKEYS = f"""{_TREE_KEYS}, {_WANTED},
    act as (select * from k where status = 'Active'),
    steps as (select d.n as tree_id, (d.n + s.step) % 25 as to_tree, x.r as hi, case when d.n % 2 = 0 then y.r end as lo from r d, (select unnest([1, 7]) as step) s, r x, r y where x.n = (d.n + s.step) % 25 and y.n = (d.n + s.step + 3) % 25),
    ways as (select w.tree_id, w.pubkey, 'key' as via, 0 as o, ranked from wanted w join act a on a.tree_id = w.tree_id and a.pubkey = w.pubkey
        union all select w.tree_id, w.pubkey, 'global', 1, ranked from wanted w join act a on a.tree_id = w.tree_id and a.pubkey = '*'
        union all select w.tree_id, w.pubkey, cast(to_tree as varchar), 2, max(case when lo is null or lo > hi then least(ranked, hi) else greatest(least(ranked, hi), lo) end)
            from wanted w join steps s using (tree_id) join act a on a.tree_id = to_tree and a.pubkey in ('*', w.pubkey) group by all),
    found as (select tree_id, pubkey, via, ranked, row_number() over (partition by tree_id, pubkey order by ranked desc, o, via) as place from ways)"""


@_plain(f"with {_SIGKEYS} select * from found")
def v13_find_sigkeys(spark: SparkSession, folder: str) -> DataFrame:
    """Every way in which a key may sign in a tree: its own entry, the global permission, or one step of delegation."""
    return _sigkeys(spark, folder)


@_plain(f"with {_SIGKEYS} select tree_id, pubkey, ranked, ranked > 0 as can_access, ranked > {_M + 1} and ranked >= {2 * _M + 2} - 12 as can_create from found where place = 1")
def v17_highest_permission(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest way of each key, whether it may write, and whether it may make an administrator's key."""
    best = auth.highest(_sigkeys(spark, folder))
    return best.select("tree_id", "pubkey", "ranked", auth.can_write(F.col("ranked")).alias("can_access"), auth.can_change_key(F.col("ranked"), auth.rank(F.lit("Admin"), F.lit(12))).alias("can_create"))


@_plain(f"with {_TREE_KEYS} select n_nationkey as tree_id, n_nationkey in (select tree_id from k) and n_nationkey not in (select tree_id from k where pubkey = '*' and status = 'Active') as needs_auth from nation")
def v17_needs_auth(spark: SparkSession, folder: str) -> DataFrame:
    return auth.needs_auth(table(spark, folder, "nation").select(F.col("n_nationkey").alias("tree_id")), _tree_keys(spark, folder))


@_plain(f"""with {_TREE_KEYS}, {_WANTED}, j as (select w.*, o.ranked as own, o.status, o.pubkey as known, g.ranked as over from wanted w left join k o on o.tree_id = w.tree_id and o.pubkey = w.pubkey left join k g on g.tree_id = w.tree_id and g.pubkey = '*' and g.status = 'Active')
    select tree_id, pubkey, case when status = 'Active' or over is not null then 'ok' when known is not null then 'revoked' else 'no_key' end as state, case when status = 'Active' then own else over end as ranked from j""")
def v16_key_states(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each key may be used in each tree, and its permission there."""
    return auth.key_states(_tree_keys(spark, folder), _wanted(spark, folder))
