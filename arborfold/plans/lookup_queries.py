"""Queries for lookups in the node's tables, sources and sinks, clocks, signatures, and changes of single documents."""

from __future__ import annotations

import contextlib
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold import streaming
from arborfold.functions import clock, paths, signatures
from arborfold.operators import commits, dag, directory, fold, tables, verify
from arborfold.plans.cut import Cut
from arborfold.plans.graph_queries import _VERIFY, _query_into
from arborfold.plans.history import History
from arborfold.plans.service_queries import _SYNCS, _history, _tree_peers
from arborfold.plans.state_queries import _ALIVE, _FLAT, _KEYS, _LAST, _flat, _orders, _path_events, _user_events
from arborfold.sources import store
from arborfold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_graph = _query_into(QUERIES, SQL)


def _query(sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- peers, users, keys ----

_TP = f"{_SYNCS}, tp as (select distinct tree_id, peer_pubkey as peer from s where peer_pubkey is not null and tree_id is not null)"
_PEERS = "lp as (select * from peers where id is not null qualify row_number() over (partition by id order by coalesce(epoch_us(last_seen), -1) desc, status desc nulls last, display_name desc nulls last) = 1)"


@_query(f"with {_TP}, {_PEERS} select id, nullif(trim(display_name), '') as display_name, status, coalesce(len(addresses), 0) as n_addresses, (select count(*) from tp where peer = id) as n_trees from lp")
def y09_peer_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Every peer with its addresses and trees counted."""
    return directory.registry(table(spark, folder, "peers"), _tree_peers(_history(spark, folder)))


_STATES = "case event_type when 'signup' then 'pending' when 'purchase' then 'approved' when 'error' then 'rejected' end"


@_query(f"select user_id from (select user_id, arg_max({_STATES}, (ts, event_id)) as state from events where event_type in ('signup', 'purchase', 'error') group by user_id) where state = 'pending'")
def y10_pending_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose last request to take part is not decided yet: sign-ups ask, purchases approve, errors reject."""
    e = table(spark, folder, "events").where("event_type in ('signup', 'purchase', 'error')").withColumn("state", F.expr(_STATES))
    return directory.in_state(directory.request_states(e, ["user_id"], ["ts", "event_id"]), F.col("state"), "pending").select("user_id")


@_query("select distinct id, trim(display_name) as name, status from peers where display_name is not null")
def y13_list_users(spark: SparkSession, folder: str) -> DataFrame:
    return directory.users(table(spark, folder, "peers"))


_DB_KEY = "'db' || user_id % 40 as tree_id"


@_query(f"with l as (select distinct user_id, {_DB_KEY} from events) select tree_id, string_agg(user_id, ',' order by user_id) as users from (select tree_id, lpad(cast(user_id as varchar), 6, '0') as user_id from l) group by tree_id")
def y16_linked_users(spark: SparkSession, folder: str) -> DataFrame:
    """The users of every database."""
    links = table(spark, folder, "events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("user_id"), F.concat(F.lit("db"), (F.col("user_id") % 40).cast("string")).alias("tree_id"))
    return directory.linked(links, "tree_id", "user_id").select("tree_id", F.array_join("links", ",").alias("users"))


@_query("select user_id, count(distinct event_type) as n_links, min(event_type) as first_link from events group by user_id")
def y16_linked_databases(spark: SparkSession, folder: str) -> DataFrame:
    """How many databases every user has, and the first of them."""
    return directory.link_counts(table(spark, folder, "events"), "user_id", "event_type")


@_query("""with u as (select user_id, event_type as tree_id, bool_or(value > 50) as e, bool_or(value > 90) as c, min(case when value > 20 then cast(value * 100 as bigint) end) as i from events group by all)
    select tree_id, bool_or(e) as sync_enabled, bool_or(c) as sync_on_commit, min(i) as interval_seconds from u group by tree_id""")
def y11_combined_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The settings of all users of a database as one."""
    v = F.col("value")
    own = table(spark, folder, "events").groupBy("user_id", F.col("event_type").alias("tree_id")).agg(F.bool_or(v > 50).alias("sync_enabled"), F.bool_or(v > 90).alias("sync_on_commit"), F.min(F.when(v > 20, F.round(v * 100).cast("bigint"))).alias("interval_seconds"))
    return directory.combined_settings(own.select("user_id", "tree_id"), own)


def _owned_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Peers are keys, their status is who owns them, and failed connections flag a default."""
    return directory.latest_peers(table(spark, folder, "peers")).select(F.col("status").alias("owner"), F.col("id").alias("key"), F.unix_micros("first_seen").alias("created_at"), (F.col("connection_state") == "Failed").alias("is_default"))


_OWNED = f"{_PEERS}, k as (select status as owner, id as key, epoch_us(first_seen) as created_at, connection_state = 'Failed' as is_default from lp)"
_DEFAULTS = f"{_OWNED}, d as (select owner, key from k qualify row_number() over (partition by owner order by coalesce(is_default, false) desc, created_at nulls last, key) = 1)"


@_query(f"with {_OWNED} select owner, key, row_number() over (partition by owner order by created_at nulls last, key) as place from k")
def y19_keys_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return directory.ordered_keys(_owned_keys(spark, folder), "owner").select("owner", "key", "place")


@_query(f"with {_DEFAULTS} select * from d")
def y19_default_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Each owner's default key: the flagged one, else the oldest."""
    return directory.default_keys(_owned_keys(spark, folder), "owner")


_MAPPED = "w as (select owner, 'db' || i as tree_id, i from (select distinct owner from k), range(9) t(i)), m as (select owner, tree_id, case when i % 3 = 1 then 'key-' || i end as mapped from w where i % 3 <> 0)"


@_query(f"with {_DEFAULTS}, {_MAPPED} select w.owner, w.tree_id, case when m.owner is null then 'none' when mapped is not null then 'explicit' else 'self' end as how, case when m.owner is not null then coalesce(mapped, d.key) end as key from w left join m on m.owner = w.owner and m.tree_id = w.tree_id left join d on d.owner = w.owner")
def y19_keys_for_databases(spark: SparkSession, folder: str) -> DataFrame:
    """The key that each owner uses for each of nine databases: a mapped one, the default one, or none."""
    keys = _owned_keys(spark, folder)
    i = F.substring("tree_id", 3, 9).cast("int")
    wanted = keys.select("owner").distinct().select("owner", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: F.concat(F.lit("db"), n.cast("string")))).alias("tree_id"))
    mapped = wanted.where(i % 3 != 0).withColumn("mapped", F.when(i % 3 == 1, F.concat(F.lit("key-"), i.cast("string"))))
    return directory.keys_for_databases(wanted, mapped, directory.default_keys(keys, "owner"))


# ---- sources and sinks ----

_PART = "select event_id, user_id, event_type, value from events"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")


@_query(_PART)
def s08_save_and_load(spark: SparkSession, folder: str) -> DataFrame:
    """Events saved to a versioned folder and loaded again."""
    place = f"{Cut(spark).base}/saved"
    store.save({"events": _rows(spark, folder)}, place)
    return store.load(spark, place, ["events"])["events"]


@_query(f"{_PART} union all select -1, 1, 'new', 0.5")
def s09_jdbc_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Events written to a database table by JDBC, read again, and one row put in twice."""
    place = Cut(spark).base.removeprefix("file://").removeprefix("file:")
    os.makedirs(place, exist_ok=True)
    url = f"jdbc:derby:{place}/database;create=true"
    store.write_jdbc(_rows(spark, folder).coalesce(4), url, "events", "overwrite")
    stored = store.reader(spark, url)("events")
    known = stored.select(*[F.col(c).alias(c.lower()) for c in stored.columns])
    new = spark.createDataFrame([(-1, 1, "new", 0.5)], known.schema)
    again = known.where("event_id is not null").orderBy("event_id").limit(1)  # the same one each time that it is computed
    return store.upsert(store.upsert(known, new.unionByName(again), ["event_id"]), new, ["event_id"])


@_query("select n_nationkey, n_name, n_regionkey from nation")
def s10_sqlite_source(spark: SparkSession, folder: str) -> DataFrame:
    """A table of an SQLite file (made here of a small table), opened by its URL."""
    rows = [tuple(r) for r in table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    place = Cut(spark).base.removeprefix("file://").removeprefix("file:")
    os.makedirs(place, exist_ok=True)
    with contextlib.closing(sqlite3.connect(f"{place}/store.db")) as con:
        con.execute("create table nation (n_nationkey integer, n_name text, n_regionkey integer)")
        con.executemany("insert into nation values (?, ?, ?)", rows)
        con.commit()
    return store.reader(spark, f"sqlite:{place}/store.db")("nation")


@_query("select 'name' as key, 'second' as value union all select 'size', '2'")
def s13_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The one row of metadata, written twice."""
    place = f"{Cut(spark).base}/saved"
    store.set_metadata(spark, place, {"name": "first", "gone": "x"})
    store.set_metadata(spark, place, {"name": "second", "size": "2"})
    return spark.createDataFrame(sorted(store.get_metadata(spark, place).items()), "key string, value string")


# ---- changes of single documents and tables ----

_SHOWN = "array_to_string(path, '.') as path, kind, value"


def _document(docs: tables.Documents) -> DataFrame:
    return fold.live(docs.get_all()).where("user_id = 7").select(F.array_join("path", ".").alias("path"), "kind", "value")


def _docs(spark: SparkSession, folder: str) -> tables.Documents:
    return tables.Documents(_path_events(spark, folder), _KEYS)


@_query(f"""with {_ALIVE} select {_SHOWN} from state where user_id = 7 and kind <> 'deleted' union all
    select * from (values ('todo', 'doc', null), ('todo.n', 'int', '5'), ('todo.done', 'bool', 'false'), ('todo.note', 'null', null), ('todo.title', 'text', 'say "hi"'),
        ('todo.tags', 'list', null), ('todo.tags.0000000001', 'text', 'a'), ('todo.tags.0000000002', 'int', '2'), ('todo.sub', 'doc', null), ('todo.sub.x', 'bool', 'true'))""")
def t08_set_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Values of every kind, a list and a document set in one document."""
    docs = _docs(spark, folder)
    for path, value in (("n", 5), ("done", False), ("note", None), ("title", 'say "hi"'), ("tags", ["a", 2]), ("sub", {"x": True})):
        docs.set((7,), f"todo.{path}", value)
    return _document(docs)


@_query(f"with {_ALIVE} select {_SHOWN} from state where user_id = 7 and kind <> 'deleted' and path[1] <> 'click'")
def t10_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A document without one name, deleted with all below it."""
    docs = _docs(spark, folder)
    docs.delete((7,), "click")
    docs.delete((7,), "absent")
    return _document(docs)


@_query("select * from (values ('first', 'None'), ('again', '1'), ('other', 'None'), ('read', '3'), ('wrong kind', 'TypeMismatch'), ('absent', 'KeyNotFound'), ('optional', 'None')) t(what, got)")
def t09_insert_returns_staged(spark: SparkSession, folder: str) -> DataFrame:
    """Inserts give back what was staged before, and reads say what is wrong."""
    docs, k = _docs(spark, folder), (7,)

    def tried(f) -> str:  # noqa: ANN001
        try:
            return str(f())
        except (tables.KeyNotFound, tables.TypeMismatch) as e:
            return type(e).__name__

    got = [("first", docs.insert(k, "n.x", 1)), ("again", docs.insert(k, "n.x", 3)), ("other", docs.insert(k, "n.y", "t")), ("read", docs.get(k, "n.x"))]
    got += [("wrong kind", tried(lambda: docs.get(k, "n.x", "text"))), ("absent", tried(lambda: docs.get(k, "n.z"))), ("optional", docs.get_option(k, "n.z"))]
    return spark.createDataFrame([(a, str(b)) for a, b in got], "what string, got string")


@_query("select * from (values ('count', 'int', '2'), ('kept', 'text', 'first'), ('list', 'list', null), ('list.0000000001', 'text', 'a'), ('list.0000000002', 'text', 'b!'), ('made', 'int', '10'), ('json', 'text', '{\"a\": [1, null]}')) t(path, kind, value)")
def t14_read_modify_write(spark: SparkSession, folder: str) -> DataFrame:
    """Counters, defaults and texts that hold JSON, by reading and writing; an editor deletes what it made."""
    docs, k = _docs(spark, folder), (-1,)
    docs.modify_or_insert(k, "count", 0, lambda n: n + 1)
    docs.modify(k, "count", lambda n: n + 1)
    docs.get_or_insert(k, "kept", "first")
    docs.get_or_insert(k, "kept", "second")
    docs.modify_or_insert(k, "made", 5, lambda n: n * 2)
    docs.set(k, "list", ["a", "b"])
    docs.set(k, "list", ["a", docs.get(k, "list.1") + "!"])
    docs.set_json(k, "json", {"a": [1, None]})
    editor = docs.editor(k, "gone")
    editor.child("deep.er").set(1)
    editor.delete_self()
    return fold.live(docs.get_all()).where("user_id = -1").select(F.array_join("path", ".").alias("path"), "kind", "value")


@_query("select 3 as n_new, true as keys_differ, 1 as n_found")
def t02_insert_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows inserted under keys of their own."""
    t = _orders(spark, folder)
    keys = [t.insert(f'{{"status": "N", "price": {i}, "priority": "new"}}') for i in range(3)]
    found = t.search("status = 'N'")
    return found.agg(F.count(F.lit(1)).alias("n_new"), (F.count_distinct("key") == len(set(keys))).alias("keys_differ"), F.count_if(F.col("key") == keys[1]).alias("n_found"))


# ---- folds by a cache, verification of what arrives ----

@_query(_FLAT.format(last=_LAST.format(where="where ts < timestamp '2024-01-15'")))
def m10_state_cache(spark: SparkSession, folder: str) -> DataFrame:
    """A state asked for twice by its snapshot, the second time with the tips in another order: it is computed once."""
    cache = commits.StateCache(spark, f"{Cut(spark).base}/cache")
    events = _user_events(spark, folder).where("ts < timestamp_ntz'2024-01-15'")
    cache.get("people", ["b", "a"], lambda: _flat(events))
    return cache.get("people", ["a", "b", "a"], lambda: _flat(events.where("false")))


_NOW = _VERIFY.replace("entries_", "now_")


@_graph(f""", now_ as materialized (select * replace (case when store = 'view' then 2 else status end as status) from entries_){_NOW.replace("unsettled", "open_now")} select entry_id, new_status as status from judged""")
def w07_put_remote(h: History) -> DataFrame:
    """Entries of one store arrive later than all others: they are stored unverified and verified in one pass."""
    stored, late = h.entries.where("store <> 'view'"), h.entries.where("store = 'view'")
    inner = h.edges.join(stored.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")
    outer = h.edges.join(late.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")
    return verify.put_remote(stored, inner, late.unionByName(late), outer)[0].select("entry_id", "status")


@_graph(f"{_VERIFY} select tree_id, entry_id, new_status from judged where status = 2 and new_status <> 2")
def x06_promotions(h: History) -> DataFrame:
    """What becomes verified or failed when everything is here."""
    return streaming.promote(h.entries, h.edges)


# ---- times, keys, paths ----

@_query("select sync_id, strftime(make_timestamp(epoch_us(started_at) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as at from (select distinct sync_id, started_at from sync_history where started_at is not null)")
def f20_times_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """Times in milliseconds as text in UTC, whatever the session's time zone."""
    rows = table(spark, folder, "sync_history").where("started_at is not null").select("sync_id", "started_at").distinct()
    return rows.select("sync_id", clock.rfc3339(F.unix_millis("started_at")).alias("at"))


@_query("select n_name, true as ok, false as changed_text, false as other_key, false as no_signature from nation")
def f18_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Names signed and checked, also with a changed text, under another key, and with what is no signature."""
    seed = bytes(range(32))
    key, other = (F.lit(signatures.key_text(signatures.public_key(s))) for s in (seed, bytes(32)))
    n = table(spark, folder, "nation").select("n_name", signatures.signed(seed, F.col("n_name")).alias("sig"))
    check = signatures.verified
    return n.select("n_name", check(key, F.col("n_name"), F.col("sig")).alias("ok"), check(key, F.lower("n_name"), F.col("sig")).alias("changed_text"), check(other, F.col("n_name"), F.col("sig")).alias("other_key"), check(key, F.col("n_name"), F.lit("none")).alias("no_signature"))


@_query("select event_id, event_type || '.' || user_id || '.a.b' as path from events")
def f04_built_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of mixed parts, each normalised."""
    e = table(spark, folder, "events")
    return e.select("event_id", paths.join(F.concat(F.lit("."), "event_type", F.lit("..")), F.col("user_id").cast("string"), F.lit(paths.build("a", "b"))).alias("path"))


@_graph("select tree_id, entry_id, entry_id not in (select parent_id from edges) as is_tip from entries_ where height = 0")
def g05_roots_that_are_tips(h: History) -> DataFrame:
    """Trees of which nothing but the root is known."""
    return dag.is_tip(h.entries, h.edges).where("height = 0").select("tree_id", "entry_id", "is_tip")
