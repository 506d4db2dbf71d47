"""Queries for folds, tables, documents and value functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfold import streaming
from arborfold.functions import crypto, paths, values
from arborfold.operators import fold, tables
from arborfold.plans.cut import Cut
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


# ---- flat tables: one row per user, removed by an error event ----

def _user_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("leaf")
    row = F.struct("event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.select(F.col("user_id").alias("key"), kind.alias("kind"), F.when(kind == "leaf", F.to_json(row)).alias("row"), "event_type", "value", "ts", F.col("event_id").alias("entry_id"))


_LAST = "select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events {where}) where r = 1"
_FLAT = "select user_id as key, event_type, value, event_id as entry_id from ({last}) where event_type <> 'error'"


def _flat(events: DataFrame) -> DataFrame:
    state = fold.last_writer(events, ["key"], ["kind", "event_type", "value"], ["ts", "entry_id"])
    return fold.live(state).select("key", "event_type", "value", "entry_id")


@_query(_FLAT.format(last=_LAST.format(where="")))
def m05_lww_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_user_events(spark, folder))


@_query("select event_type, count(*) as n, round(sum(value), 4) as total from (" + _LAST.format(where="") + ") where event_type <> 'error' group by event_type")
def m07_state_current(spark: SparkSession, folder: str) -> DataFrame:
    """The current state needs no closure: every entry is at or above some tip."""
    return _flat(_user_events(spark, folder)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_query(_FLAT.format(last=_LAST.format(where="where ts < timestamp '2024-01-15'")))
def m07_state_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_user_events(spark, folder).where("ts < timestamp_ntz'2024-01-15'"))


@_query("""select coalesce(s.key, b.key) as key, case when s.key is null then b.event_type else 'staged' end as event_type
    from (""" + _FLAT.format(last=_LAST.format(where="")) + """) b
    full join (select distinct user_id as key, user_id % 4 = 0 as gone from events where user_id % 2 = 0) s on s.key = b.key where s.key is null or not gone""")
def m08_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Staged changes: even users are overwritten, every fourth is then removed."""
    events = _user_events(spark, folder)
    state = fold.last_writer(events, ["key"], ["kind", "event_type"], ["ts", "entry_id"])
    even = events.where("key % 2 = 0").select("key").distinct()
    put = even.select("key", F.lit("leaf").alias("kind"), F.lit("staged").alias("event_type"), F.lit(0).alias("seq"))
    gone = even.where("key % 4 = 0").select("key", F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("event_type"), F.lit(1).alias("seq"))
    return fold.live(fold.overlay(state, put.unionByName(gone), ["key"], ["kind", "event_type"])).select("key", "event_type")


@_query(_FLAT.format(last=_LAST.format(where="")))
def m10_incremental_equals_full(spark: SparkSession, folder: str) -> DataFrame:
    """A state of the later half of the events that then takes in the earlier half."""
    events = _user_events(spark, folder).select("key", "kind", "event_type", "value", "ts", "entry_id")
    state = fold.last_writer(events.where("entry_id % 2 = 1"), ["key"], ["kind", "event_type", "value"], ["ts", "entry_id"])
    return _flat(state.unionByName(events.where("entry_id % 2 = 0")))


# ---- nested documents: up to three levels under a user's document ----

_KEYS = ("user_id",)


def _path_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    depth = (F.col("event_id") % 3 + 1).cast("int")
    i = F.col("event_id")
    held = (i % 17 == 5) & (depth > 1)
    final = F.when(i % 13 == 0, "deleted").when(i % 13 == 1, "adoc").when(i % 13 == 2, "doc").when(i % 13 == 3, "list").when(i % 13 == 4, "null").when(i % 13 == 5, "bool").when(i % 13 == 6, "int").otherwise("text")
    segments = F.array(F.col("event_type"), F.concat(F.lit("f"), i % 4), F.concat(F.lit("g"), i % 2))
    rows = e.select("user_id", "event_id", segments.alias("s"), depth.alias("depth"), held.alias("held"), final.alias("final"), F.explode(F.sequence(F.lit(1), depth)).alias("n"))
    tags = F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.when((j == F.col("depth")) & F.col("held"), "l").otherwise("d"))
    kind = F.when(F.col("n") == F.col("depth"), F.col("final")).when((F.col("n") == F.col("depth") - 1) & F.col("held"), "list").otherwise("doc")
    value = F.when(kind == "bool", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")).when(kind == "int", F.col("event_id").cast("string")).when(kind == "text", F.concat(F.lit('v"'), F.col("event_id")))
    return rows.select(
        "user_id", F.slice("s", F.lit(1), F.col("n")).alias("path"), tags.alias("cont"), kind.alias("kind"), value.alias("value"),
        F.col("event_id").alias("height"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("entry_id"),
    )


_PATHS = """pe as materialized (
    select user_id, s[1:n] as path, [case when j = depth and held then 'l' else 'd' end for j in range(1, n + 1)] as cont, kind, case kind when 'bool' then case when event_id % 2 = 0 then 'true' else 'false' end when 'int' then cast(event_id as varchar) when 'text' then 'v"' || event_id end as value,
           event_id as height, lpad(cast(event_id as varchar), 12, '0') as entry_id
    from (select *, case when n = depth then final when n = depth - 1 and held then 'list' else 'doc' end as kind
          from (select user_id, event_id, [event_type, 'f' || event_id % 4, 'g' || event_id % 2] as s, event_id % 3 + 1 as depth, event_id % 17 = 5 and event_id % 3 + 1 > 1 as held,
                       case event_id % 13 when 0 then 'deleted' when 1 then 'adoc' when 2 then 'doc' when 3 then 'list' when 4 then 'null' when 5 then 'bool' when 6 then 'int' else 'text' end as final, unnest(range(1, event_id % 3 + 2)) as n from events)))"""
_ALIVE = f"""{_PATHS},
    alive as materialized (select * from pe e where not exists (
        select 1 from pe k where k.user_id = e.user_id and len(k.path) < len(e.path) and e.path[1:len(k.path)] = k.path and (k.height > e.height or (k.height = e.height and k.entry_id > e.entry_id))
          and (k.kind not in ('doc', 'list') or (k.kind = 'list' and e.cont[len(k.path) + 1] = 'd') or (k.kind = 'doc' and e.cont[len(k.path) + 1] = 'l')))),
    decided as materialized (select user_id, path, arg_max(kind, height) as last_kind, arg_max(coalesce(value, ''), height) as v, max(case when kind = 'adoc' then height end) as a, max(case when kind not in ('doc', 'adoc') then height end) as b from alive group by user_id, path),
    state as materialized (select user_id, path, case when last_kind = 'adoc' then 'doc' else last_kind end as kind, nullif(v, '') as value, last_kind in ('doc', 'adoc') and a is not null and (b is null or a > b) as atomic from decided)"""
_SHOW = "select user_id, array_to_string(path, '.') as path, kind, value, atomic from state"


def _show(state: DataFrame) -> DataFrame:
    return state.select("user_id", F.array_join("path", ".").alias("path"), "kind", "value", "atomic")


@_query(f"with {_ALIVE} {_SHOW}")
def m01_nested_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _show(fold.nested(_path_events(spark, folder), _KEYS))


@_query(f"with {_ALIVE} {_SHOW} where atomic")
def m01_atomic_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _show(fold.nested(_path_events(spark, folder), _KEYS).where("atomic"))


@_query(f"with {_ALIVE} {_SHOW} where len(path) > 1 and path[1:len(path) - 1] in (select s.path from state s where s.user_id = state.user_id and s.kind = 'list')")
def m03_list_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The items of all lists."""
    state = fold.nested(_path_events(spark, folder), _KEYS)
    lists = state.where("kind = 'list'").select("user_id", F.col("path").alias("above"))
    items = state.where(F.size("path") > 1).withColumn("above", F.slice("path", F.lit(1), F.size("path") - 1))
    return _show(items.join(lists, ["user_id", "above"], "left_semi"))


@_query(f"with {_ALIVE} {_SHOW}")
def m10_nested_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Live events of the later events that then take in the earlier ones, folded."""
    events = _path_events(spark, folder)
    state = fold.live_events(events.where("height % 2 = 1"), _KEYS)
    return _show(fold.decide(fold.live_events(state.unionByName(events.where("height % 2 = 0")), _KEYS), _KEYS))


@_query(f"with {_ALIVE} {_SHOW} where kind <> 'deleted'")
def t11_get_all(spark: SparkSession, folder: str) -> DataFrame:
    return _show(fold.live(tables.Documents(_path_events(spark, folder), _KEYS).get_all()))


@_query(f"with {_ALIVE} {_SHOW} where kind <> 'deleted' and path[1:2] = ['view', 'f1']")
def t12_get_path(spark: SparkSession, folder: str) -> DataFrame:
    return _show(tables.Documents(_path_events(spark, folder), _KEYS).get_path("view.f1"))


@_query(f"with {_ALIVE} select user_id from state where kind <> 'deleted' and path = ['click', 'f2']")
def t13_contains(spark: SparkSession, folder: str) -> DataFrame:
    return tables.Documents(_path_events(spark, folder), _KEYS).contains("click.f2")


_AT = "from state where kind <> 'deleted' and path = ['click', 'f2']"


@_query(f"with {_ALIVE} select user_id, kind, case when kind = 'int' then cast(value as bigint) end as as_int, case when kind = 'bool' then value = 'true' end as as_bool, case when kind = 'text' then value end as as_text, kind <> 'int' as not_int {_AT}")
def t07_typed_getter(spark: SparkSession, folder: str) -> DataFrame:
    """One path of every document, asked for as each type."""
    docs = tables.Documents(_path_events(spark, folder), _KEYS)
    got = docs.lookup("click.f2").select("user_id", "kind")
    for kind in ("int", "bool", "text"):
        got = got.join(docs.get_as("click.f2", kind).select("user_id", F.col("value").alias(f"as_{kind}"), F.col("mismatch").alias(f"not_{kind}")), "user_id")
    return got.select("user_id", "kind", "as_int", "as_bool", "as_text", "not_int")


@_query(f"with {_ALIVE}, i as (select *, row_number() over (partition by user_id, path[1:2] order by path[3]) as r from state s where kind <> 'deleted' and len(path) = 3 and path[1:2] = ['view', 'f1'] and exists (select 1 from state l where l.user_id = s.user_id and l.path = s.path[1:2] and l.kind = 'list')) select user_id, kind, value from i where r = 1")
def f05_list_index_in_path(spark: SparkSession, folder: str) -> DataFrame:
    """A number in a path below a list is the index of a live item."""
    return tables.Documents(_path_events(spark, folder), _KEYS).lookup("view.f1.0")


@_query(f"with {_ALIVE} select user_id, path[1] as name, count(*) as n_nodes, count(*) filter (kind = 'deleted') as n_deleted from state group by all")
def f08_counts_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored under each top-level name, tombstones counted apart."""
    return tables.Documents(_path_events(spark, folder), _KEYS).counts()


@_query(f"""with {_ALIVE},
    shown as (select * from state where kind <> 'deleted'),
    l3 as (select user_id, path[1:2] as path, string_agg('"' || path[3] || '":' || j, ',' order by path[3]) as d, string_agg(j, ',' order by path[3]) as l
           from (select *, case kind when 'text' then '"' || replace(value, '"', '\\"') || '"' when 'null' then 'null' when 'bool' then value when 'int' then value when 'list' then '[]' else '{{}}' end as j from shown where len(path) = 3) group by all),
    l2 as (select user_id, path[1:1] as path, string_agg('"' || path[2] || '":' || j, ',' order by path[2]) as d, string_agg(j, ',' order by path[2]) as l
           from (select s.*, case kind when 'text' then '"' || replace(value, '"', '\\"') || '"' when 'null' then 'null' when 'bool' then value when 'int' then value when 'list' then '[' || coalesce(l, '') || ']' else '{{' || coalesce(d, '') || '}}' end as j from shown s left join l3 using (user_id, path) where len(path) = 2) group by all),
    l1 as (select user_id, string_agg('"' || path[1] || '":' || j, ',' order by path[1]) as d
           from (select s.*, case kind when 'text' then '"' || replace(value, '"', '\\"') || '"' when 'null' then 'null' when 'bool' then value when 'int' then value when 'list' then '[' || coalesce(l, '') || ']' else '{{' || coalesce(d, '') || '}}' end as j from shown s left join l2 using (user_id, path) where len(path) = 1) group by all)
    select user_id, '{{' || coalesce(d, '') || '}}' as json from (select distinct user_id from state) left join l1 using (user_id)""")
def f10_to_json(spark: SparkSession, folder: str) -> DataFrame:
    return tables.Documents(_path_events(spark, folder), _KEYS).json(3)


# ---- typed tables: the last order of every customer, removed by some finished ones ----

_ROW = "status string, price double, priority string"


def _orders(spark: SparkSession, folder: str) -> tables.Table:
    o = table(spark, folder, "orders")
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)
    row = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")))
    days = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(o_orderdate as timestamp_ntz))")
    history = o.select(F.col("o_custkey").cast("string").alias("key"), F.when(~gone, row).alias("row"), F.when(gone, "deleted").otherwise("leaf").alias("kind"), days.alias("height"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("entry_id"))
    return tables.Table(history, _ROW)


_ORDERS = """o as (select cast(o_custkey as varchar) as key, o_orderstatus as status, o_totalprice as price, o_orderpriority as priority, o_orderkey,
    row_number() over (partition by o_custkey order by o_orderdate desc, lpad(cast(o_orderkey as varchar), 12, '0') desc) as r from orders),
    t as (select key, status, price, priority from o where r = 1 and not (status = 'F' and o_orderkey % 5 = 0))"""


@_query(f"with {_ORDERS} select * from t where key = '7'")
def t01_table_get(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).search(F.col("key") == "7")


@_query(f"with {_ORDERS} select * from t where status = 'O'")
def t05_search_eq(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).search("status = 'O'")


@_query(f"with {_ORDERS} select * from t where priority like '%URG%'")
def t05_search_contains(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).search(F.contains("priority", F.lit("URG")))


@_query(f"with {_ORDERS} select * from t where priority like '3%'")
def t05_search_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).search(F.col("priority").startswith("3"))


@_query(f"with {_ORDERS} select * from t where price > 200000")
def t05_search_range(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).search("price > 200000")


@_query(f"with {_ORDERS} select * from t where key not in ('1', '2', '4')")
def t05_search_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes staged in this session are seen by its reads."""
    t = _orders(spark, folder)
    for key in ("1", "2", "4"):
        t.delete(key)
    return t.rows()


@_query(f"with {_ORDERS} select * from t where key not in ('1', 'new') union all select 'new', 'O', 1.5, 'x' union all select '1', 'P', 2.5, 'y'")
def t03_set_and_insert(spark: SparkSession, folder: str) -> DataFrame:
    t = _orders(spark, folder)
    t.set("new", '{"status": "P", "price": 0, "priority": ""}')
    t.set("new", '{"status": "O", "price": 1.5, "priority": "x"}')
    t.set("1", '{"status": "P", "price": 2.5, "priority": "y"}')
    return t.rows()


@_query(f"with {_ORDERS} select key, price, row_number() over (order by price desc, key) as place from t order by place limit 50")
def t22_search_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty dearest rows, in order."""
    top = _orders(spark, folder).search(F.lit(True)).orderBy(F.desc("price"), "key").limit(50)
    return top.select("key", "price", F.row_number().over(Window.orderBy(F.desc("price"), "key")).alias("place"))


# ---- paths and values ----

_PATH_SQL = "select event_id, case event_id % 8 when 0 then '' when 1 then '.' when 2 then event_type || '..' || user_id when 3 then '.' || event_type || '.' when 4 then event_type when 5 then '...' || event_type || '.x.' || user_id || '..' when 6 then null else event_type || '.' || user_id || '.k.v' end as p from events"


def _dotted(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    i, t, u = F.col("event_id") % 8, F.col("event_type"), F.col("user_id").cast("string")
    p = (
        F.when(i == 0, "").when(i == 1, ".").when(i == 2, F.concat(t, F.lit(".."), u)).when(i == 3, F.concat(F.lit("."), t, F.lit("."))).when(i == 4, t)
        .when(i == 5, F.concat(F.lit("..."), t, F.lit(".x."), u, F.lit(".."))).when(i == 6, F.lit(None)).otherwise(F.concat(t, F.lit("."), u, F.lit(".k.v")))
    )
    return e.select("event_id", p.alias("p"))


_PARTS = f"select event_id, p, list_filter(string_split(p, '.'), lambda x: x <> '') as c from ({_PATH_SQL})"


@_query(f"select event_id, array_to_string(c, '.') as path from ({_PARTS})")
def f01_normalize_path(spark: SparkSession, folder: str) -> DataFrame:
    return _dotted(spark, folder).select("event_id", paths.normalize(F.col("p")).alias("path"))


@_query(f"""select event_id, len(c) as n, case when len(c) > 1 then array_to_string(c[1:len(c) - 1], '.') end as parent, c[len(c)] as file_name,
    case when c is not null then array_to_string(list_concat(c, ['tail', 'end']), '.') end as joined, not contains(p, '.') as is_component from ({_PARTS})""")
def f02_path_parts(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    return _dotted(spark, folder).select("event_id", paths.length(p).alias("n"), paths.parent(p).alias("parent"), paths.file_name(p).alias("file_name"), paths.join(p, F.lit("tail..end")).alias("joined"), paths.is_component(p).alias("is_component"))


_VALUE_SQL = """select event_id, case event_id % 7 when 0 then 'null' when 1 then 'bool' when 2 then 'int' when 3 then 'text' when 4 then 'doc' when 5 then 'list' else 'deleted' end as kind,
    case event_id % 7 when 1 then case when user_id % 2 = 0 then 'true' else 'false' end when 2 then cast(user_id as varchar) when 3 then event_type end as value from events"""


def _values(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    n = (F.col("event_id") % 7).cast("int")
    kind = F.element_at(F.array(*map(F.lit, values.KINDS)), n + 1)
    value = F.when(n == 1, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")).when(n == 2, F.col("user_id").cast("string")).when(n == 3, F.col("event_type"))
    return e.select("event_id", kind.alias("kind"), value.alias("value"))


@_query(f"""select event_id, case when kind = 'bool' then cast(value as boolean) end as as_bool, coalesce(case when kind = 'int' then try_cast(value as bigint) end, -1) as as_int,
    coalesce(case when kind = 'text' then value end, 'none') as as_text, kind not in ('doc', 'list') as is_leaf, kind in ('doc', 'list') as is_branch,
    case kind when 'deleted' then '<deleted>' when 'null' then 'null' else value end as shown from ({_VALUE_SQL})""")
def f13_typed_access(spark: SparkSession, folder: str) -> DataFrame:
    k, v = F.col("kind"), F.col("value")
    return _values(spark, folder).select(
        "event_id", values.as_bool(F.col("kind"), F.when(k == "bool", v)).alias("as_bool"), values.as_int(k, F.when(k == "int", v), -1).alias("as_int"),
        values.as_text(k, v, "none").alias("as_text"), values.is_leaf(k).alias("is_leaf"), values.is_branch(k).alias("is_branch"), values.display(k, v).alias("shown"),
    )


@_query(f"select event_id, kind = 'text' and coalesce(value = 'view', false) as is_view, kind = 'int' and coalesce(value = '7', false) as is_7, kind = 'bool' and coalesce(value = 'true', false) as is_true from ({_VALUE_SQL})")
def f14_cross_equality(spark: SparkSession, folder: str) -> DataFrame:
    k, v = F.col("kind"), F.col("value")
    return _values(spark, folder).select("event_id", values.equals(k, v, "view").alias("is_view"), values.equals(k, v, 7).alias("is_7"), values.equals(k, v, True).alias("is_true"))


_LISTS = "select user_id, event_id % 40 - 20 as num, event_id % 9 + 1 as den, cast(event_id as varchar) as uid, event_id % 6 = 0 as deleted, event_type as value from events"


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    e, i = table(spark, folder, "events"), F.col("event_id")
    return e.select("user_id", (i % 40 - 20).alias("num"), (i % 9 + 1).alias("den"), i.cast("string").alias("uid"), (i % 6 == 0).alias("deleted"), F.col("event_type").alias("value"))


@_query(f"select user_id, row_number() over (partition by user_id order by num::decimal(38,18) / den, uid) - 1 as index, value from ({_LISTS}) where not deleted")
def f15_list_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.list_items(_positions(spark, folder), ["user_id"])


@_query(f"""with l as (select user_id, row_number() over (partition by user_id order by uid::bigint) - 1 as i, value from ({_LISTS}) where not deleted),
    a as (select user_id, case when i = 1 then 'set' else value end as value, i from l where i <> 0 union all select user_id, 'between', 2.5 from l where i = 2
          union all select user_id, 'last', 1000000 from l where i = 0)
    select user_id, row_number() over (partition by user_id order by i) - 1 as index, value from a where user_id in (select user_id from l where i = 3)""")
def f15_list_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of four items and more, with one item set, one inserted, one pushed, and the first removed."""
    items = given = _positions(spark, folder).withColumns({"num": F.col("uid").cast("bigint"), "den": F.lit(3)})
    for what, index, value in (("set", 1, "set"), ("insert", 3, "between"), ("push", 0, "last"), ("remove", 0, None)):
        items = tables.list_edit(items, ["user_id"], what, index, value, f"new-{value}")
    long = tables.list_items(given, ["user_id"]).where("index = 3").select("user_id")
    return tables.list_items(items, ["user_id"]).join(long, "user_id", "left_semi")


@_query(f"select uid, cast(sign(num * 3 - 2 * den) as int) as against_2_3 from ({_LISTS})")
def f16_position_order(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder).select("uid", values.position_order(F.col("num"), F.col("den"), F.lit(2), F.lit(3)).alias("against_2_3"))


@_query("select event_id, sha256('+' || event_type || chr(31) || case when event_id % 3 = 0 then '-' else '+' || user_id end) as content_id from events")
def f17_content_id(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", values.content_id(F.col("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("user_id"))).alias("content_id"))


@_query("select sync_id, cast(floor((epoch_us(completed_at) - epoch_us(started_at)) / 1000) as bigint) as ms from (select distinct * from sync_history)")
def f21_duration(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sync_history").dropDuplicates().select("sync_id", values.duration_ms(F.col("started_at"), F.col("completed_at")).alias("ms"))


@_query("select event_id, event_type || '&' || user_id as database, 'http://h:' || event_id || '/?a=b;iroh:x y' as peers from events")
def f22_ticket_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    peers = F.array(F.concat(F.lit("http://h:"), F.col("event_id").cast("string"), F.lit("/?a=b")), F.lit("iroh:x y"))
    text = F.concat(values.ticket(F.concat("event_type", F.lit("&"), F.col("user_id").cast("string")), peers), F.lit("&unknown=1&pr="))
    return e.select("event_id", values.parse_ticket(text).alias("t")).select("event_id", F.col("t.database").alias("database"), F.array_join("t.peers", ";").alias("peers"))


@_query("select event_id, props as opened, true as differs, cast(null as varchar) as wrong_key from events")
def f19_aes_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    key, other = (crypto.derive_key(p, b"salt of the store") for p in ("secret", "guess"))
    sealed = table(spark, folder, "events").select("event_id", "props", crypto.encrypt(F.col("props"), key).alias("data"))
    return sealed.select("event_id", crypto.decrypt(F.col("data"), key).alias("opened"), (F.col("data") != F.encode("props", "utf-8")).alias("differs"), crypto.decrypt(F.col("data"), other).alias("wrong_key"))


@_query("select user_id, string_agg(left(event_type, 1), '' order by event_id) as state from events group by user_id")
def x00_custom_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A merge that depends on the order: the first letters of all events of a user, one after another."""
    e = table(spark, folder, "events").select("user_id", "event_type", F.col("event_id").alias("height"), F.col("event_id").cast("string").alias("entry_id"))
    return fold.custom(e, ["user_id"], lambda state, row: (state or "") + row["event_type"][:1])


# ---- streams over the files of the events table ----

def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of four files, one in each batch."""
    place = f"{Cut(spark).base}/events"
    events = table(spark, folder, "events")
    events.repartition(4, "event_id").write.parquet(place)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)


@_query("select tree_id, entry_id from (select cast(user_id as varchar) as tree_id, event_id as entry_id from events) e where not exists (select 1 from events c where c.user_id = e.tree_id::bigint and (c.event_id - c.event_id % 3 - 3) = e.entry_id and c.event_id % 3 <> 0)")
def x04_streaming_tips(spark: SparkSession, folder: str) -> DataFrame:
    """Tips of a graph in which two of three events point to an earlier third, whoever that belongs to."""
    e, i = _stream(spark, folder), F.col("event_id")
    parents = F.when(i % 3 != 0, F.array((i - i % 3 - 3).cast("string")))
    place = Cut(spark).base
    state = streaming.tips(e.select(F.col("user_id").cast("string").alias("tree_id"), i.cast("string").alias("entry_id"), parents.alias("parents")))
    streaming.write_state(state, f"{place}/state", f"{place}/checkpoint").awaitTermination()
    return streaming.read_state(spark, f"{place}/state", ["tree_id", "entry_id"]).where("seen and not has_child").select("tree_id", F.col("entry_id").cast("bigint").alias("entry_id"))


@_query("select user_id, event_type, value from (" + _LAST.format(where="") + ")")
def x05_streaming_fold(spark: SparkSession, folder: str) -> DataFrame:
    place = Cut(spark).base
    state = streaming.table_state(_stream(spark, folder), ["user_id"], ["event_type", "value"], ["ts", "event_id"])
    streaming.write_state(state, f"{place}/state", f"{place}/checkpoint").awaitTermination()
    return streaming.read_state(spark, f"{place}/state", ["user_id"])


@_query("select user_id, event_type, value, true as gap_free from (" + _LAST.format(where="") + ")")
def x02_subscription(spark: SparkSession, folder: str) -> DataFrame:
    """A subscriber folds what it is told of in two calls; together they hold every entry once, in several batches."""
    place = Cut(spark).base
    rows = _stream(spark, folder).withColumn("entry_id", F.col("event_id").cast("string"))
    streaming.ingest(rows, f"{place}/entries", f"{place}/checkpoint").awaitTermination()
    early, cursor = streaming.changes(spark, f"{place}/entries")
    first = early.where("batch < 2")
    rest, _ = streaming.changes(spark, f"{place}/entries", 1)
    told = first.unionByName(rest)
    whole = told.agg((F.count(F.lit(1)) == F.count_distinct("entry_id")).alias("once"), (F.count_distinct("batch") == cursor + 1).alias("all"))
    gap_free = whole.select((F.col("once") & F.col("all")).alias("gap_free"))
    state = fold.last_writer(told, ["user_id"], ["event_type", "value"], ["ts", "event_id"]).select("user_id", "event_type", "value")
    return state.join(F.broadcast(gap_free))


@_query("select tree_id, count(*) as n from (select distinct cast(user_id as varchar) as tree_id, event_id from events) group by 1")
def x01_streaming_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry arrives twice and is stored once."""
    e, i = _stream(spark, folder), F.col("event_id")
    place = Cut(spark).base
    rows = e.select(F.col("user_id").cast("string").alias("tree_id"), F.explode(F.array(i, i).cast("array<string>")).alias("entry_id"))
    streaming.ingest(rows, f"{place}/entries", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/entries").groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
