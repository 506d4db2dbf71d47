"""Queries for scans, graph operators and verification over the derived history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.operators import dag, hierarchy, verify
from arborfold.plans.history import HISTORY_SQL, History
from arborfold.sources import store
from arborfold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query_into(queries: dict, sqls: dict):  # noqa: ANN202
    """A decorator that registers a query over the derived history, with its SQL after the history's table expressions."""

    def query(sql: str | None):  # noqa: ANN202
        def add(f):  # noqa: ANN001, ANN202
            queries[f.__name__] = lambda spark, folder: f(History(spark, folder))
            if sql is not None:
                sqls[f.__name__] = f"with recursive {HISTORY_SQL} {sql}"
            return f

        return add

    return query


_query = _query_into(QUERIES, SQL)


def _up(name: str, seeds: str, edges: str = "edges", where: str = "") -> str:
    """A recursive table expression with the entries at or above the seeds."""
    return f", {name}(entry_id) as ({seeds} union select parent_id from {name} join {edges} on child_id = entry_id {where})"


def _down(name: str, seeds: str, edges: str = "edges") -> str:
    return f", {name}(entry_id) as ({seeds} union select child_id from {name} join {edges} on parent_id = entry_id)"


# The last entry of every tree's first half, and of its first third, as snapshots in the past.
def _cut(h: History, part: int, store_: bool = False) -> DataFrame:
    rows = h.patches if store_ else h.entries
    keys = ["tree_id", "store"] if store_ else ["tree_id"]
    n = rows.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / part)).alias("_h"))
    return rows.join(n, keys).where("height = _h").select(*keys, "entry_id")


def _cut_sql(part: int, rows: str = "entries_", keys: str = "tree_id") -> str:
    return f"select entry_id from (select *, count(*) over (partition by {keys}) // {part} as h from {rows}) where height = h"


@_query("select tree_id, entry_id, height from entries_ where entry_id = '000000000042'")
def s01_get_entry(h: History) -> DataFrame:
    return store.get(h.entries, "000000000042").select("tree_id", "entry_id", "height")


@_query("select tree_id, entry_id, 2 as status from entries_ where event_id % 3 = 0 union all select tree_id, entry_id, 0 from entries_ where event_id % 3 = 1")
def s02_put_entries(h: History) -> DataFrame:
    """Entries put again keep their status; new ones come in unverified."""
    stored = h.entries.where("event_id % 3 = 1").select("tree_id", "entry_id", F.lit(0).alias("status"))
    arriving = h.entries.where("event_id % 3 <> 2").select("tree_id", "entry_id")
    return store.put(stored, arriving.unionAll(arriving))


@_query("select entry_id, tree_id from entries_ where height = 0")
def s03_all_roots(h: History) -> DataFrame:
    return h.entries.where("height = 0").select("entry_id", "tree_id")


@_query("select entry_id, height, row_number() over (order by height, entry_id) as position from entries_ where tree_id = '7'")
def s04_get_tree(h: History) -> DataFrame:
    return store.ordered(h.entries.where("tree_id = '7'")).select("entry_id", "height", "position")


@_query("select entry_id, height, row_number() over (order by height, entry_id) as position from patches where tree_id = '7' and store = 'view'")
def s05_get_store(h: History) -> DataFrame:
    return store.ordered(h.patches.where("tree_id = '7' and store = 'view'")).select("entry_id", "height", "position")


@_query("""select w.entry_id, case when e.entry_id is null then 'not_found' when e.tree_id <> '7' then 'not_in_tree' else 'ok' end as state
    from (select distinct entry_id from entries_ union all select 'absent') w left join entries_ e using (entry_id)""")
def s06_get_entries_checked(h: History) -> DataFrame:
    wanted = h.entries.select("entry_id").unionAll(h.spark.sql("select 'absent' as entry_id"))
    return store.membership(h.entries, wanted, "7")


@_query("select status, count(*) as n, min(entry_id) as first_id from entries_ group by status")
def s07_by_status(h: History) -> DataFrame:
    return h.entries.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first_id"))


@_query("select entry_id from entries_")
def s15_all_ids(h: History) -> DataFrame:
    return h.entries.select("entry_id")


_TIPS = "select tree_id, entry_id from entries_ e where not exists (select 1 from edges where parent_id = e.entry_id and edges.tree_id = e.tree_id)"


@_query(_TIPS)
def g01_tree_tips(h: History) -> DataFrame:
    return dag.tree_tips(h.entries, h.edges).select("tree_id", "entry_id")


@_query("select tree_id, store, entry_id from patches p where not exists (select 1 from store_edges s where s.parent_id = p.entry_id and s.store = p.store)")
def g02_store_tips(h: History) -> DataFrame:
    return dag.store_tips(h.patches, h.store_edges).select("tree_id", "store", "entry_id")


@_query(f"""{_up("seen", _cut_sql(2))}, kept as (select * from patches where entry_id in (from seen))
    select tree_id, store, entry_id from kept k where not exists (select 1 from store_edges s join kept c on c.entry_id = s.child_id where s.parent_id = k.entry_id)""")
def g04_store_snapshot_at(h: History) -> DataFrame:
    return dag.store_tips_at(h.entries, h.edges, h.patches, h.store_edges, _cut(h, 2)).select("tree_id", "store", "entry_id")


@_query("select entry_id, entry_id not in (select parent_id from edges) as is_tip from entries_")
def g05_is_tip_flag(h: History) -> DataFrame:
    return dag.is_tip(h.entries, h.edges).select("entry_id", "is_tip")


@_query(f"""{_up("seen", _cut_sql(2))} select tree_id, entry_id, height from entries_ where entry_id in (from seen)""")
def g06_tree_from_tips(h: History) -> DataFrame:
    return dag.tree_at(h.entries, h.edges, _cut(h, 2)).select("tree_id", "entry_id", "height")


@_query("""select t.tree_id, t.entry_id, case when e.entry_id is null then 'not_found' else 'not_in_tree' end as error
    from (select '1' as tree_id, entry_id from entries_ union all select '1', 'absent') t left join entries_ e using (entry_id)
    where e.entry_id is null or e.tree_id <> t.tree_id""")
def g06_bad_tips(h: History) -> DataFrame:
    tips = h.entries.select(F.lit("1").alias("tree_id"), "entry_id").unionAll(h.spark.sql("select '1' as tree_id, 'absent' as entry_id"))
    return dag.bad_tips(h.entries, tips)


@_query(f"""{_up("seen", _cut_sql(2, "patches", "tree_id, store"), "store_edges")} select tree_id, store, entry_id, height from patches where entry_id in (from seen)""")
def g07_store_at(h: History) -> DataFrame:
    return dag.store_at(h.patches, h.store_edges, _cut(h, 2, True)).select("tree_id", "store", "entry_id", "height")


@_query("select edges.tree_id, child_id, string_agg(parent_id, ',' order by height, parent_id) as parents from edges join entries_ on entry_id = parent_id group by all")
def g08_sorted_parents(h: History) -> DataFrame:
    return dag.sorted_parents(h.entries, h.edges).select("tree_id", "child_id", F.array_join("parents", ",").alias("parents"))


@_query(f"""{_up("path", _cut_sql(1).replace("height = h", "height = h - 1"), where="where parent_id not in (" + _cut_sql(3) + ")")}
    select entry_id from path where entry_id not in ({_cut_sql(3)})""")
def g09_path_from_to(h: History) -> DataFrame:
    last = h.entries.groupBy("tree_id").agg(F.max_by("entry_id", "height").alias("entry_id"))
    return dag.ancestors(h.edges, last, _cut(h, 3))


@_query("""
    , first as (select child_id, min(parent_id) as parent_id from edges group by child_id),
    chain(entry_id, root_id, steps) as (select entry_id, entry_id, 0 from entries_ where height = 0
        union all select child_id, root_id, steps + 1 from chain join first on parent_id = entry_id)
    select entry_id, steps, root_id from chain""")
def g10_first_parent_chain(h: History) -> DataFrame:
    """The root of every entry over smallest parents, and the steps to it."""
    first = dag.first_parents(h.edges).select(F.col("child_id").alias("c"), F.col("parent_id").alias("p"))
    roots = h.entries.where("height = 0").select(F.col("entry_id").alias("n"))
    found = hierarchy.values(first, roots, "path")
    return found.select(F.col("n").alias("entry_id"), F.col("depth").alias("steps"), F.substring_index("path", hierarchy.SEP, 1).alias("root_id"))


_LAST = "select tree_id, entry_id, row_number() over (partition by tree_id order by height desc) as r, height from entries_"


@_query(f"""
    , wanted as materialized (select tree_id, entry_id from ({_LAST}) where r in (2, 9)),
    links as materialized (select * from edges where tree_id in (select tree_id from wanted)),
    nodes as materialized (select tree_id, entry_id, height from entries_ where tree_id in (select tree_id from wanted)),
    cut(gone, wanted_id, at_id) as (select nodes.entry_id, wanted.entry_id, wanted.entry_id from nodes join wanted using (tree_id) where nodes.entry_id <> wanted.entry_id
        union select gone, wanted_id, parent_id from cut join links on child_id = at_id where parent_id <> gone),
    bypassed as (select gone, wanted_id from cut where at_id in (select entry_id from nodes where height = 0)),
    through as (select tree_id, nodes.entry_id, height from nodes join (select tree_id, count(*) as n from wanted group by 1) using (tree_id)
        where n = (select count(*) from wanted w where w.tree_id = nodes.tree_id and not exists (select 1 from bypassed b where b.gone = nodes.entry_id and b.wanted_id = w.entry_id)))
    select w.tree_id, (select arg_max(entry_id, height) from through where through.tree_id = w.tree_id) as base from (select distinct tree_id from wanted) w""")
def g11_merge_base(h: History) -> DataFrame:
    """The merge base of the second and the ninth entry from the end, for every tree."""
    n = h.entries.groupBy("tree_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = h.entries.join(n, "tree_id").where("height in (_n - 2, _n - 9)").select("tree_id", "entry_id")
    return dag.merge_bases(h.edges, wanted)


@_query(f"""
    , wanted as materialized (select tree_id, entry_id from ({_LAST}) where r = 1),
    links as materialized (select * from edges where tree_id in (select tree_id from wanted)),
    nodes as materialized (select tree_id, entry_id, height from entries_ where tree_id in (select tree_id from wanted)),
    cut(gone, wanted_id, at_id) as (select nodes.entry_id, wanted.entry_id, wanted.entry_id from nodes join wanted using (tree_id) where nodes.entry_id <> wanted.entry_id
        union select gone, wanted_id, parent_id from cut join links on child_id = at_id where parent_id <> gone),
    bypassed as (select gone, wanted_id from cut where at_id in (select entry_id from nodes where height = 0)),
    through as (select tree_id, nodes.entry_id, height from nodes join (select tree_id, count(*) as n from wanted group by 1) using (tree_id)
        where n = (select count(*) from wanted w where w.tree_id = nodes.tree_id and not exists (select 1 from bypassed b where b.gone = nodes.entry_id and b.wanted_id = w.entry_id)))
    select tree_id, entry_id from through""")
def g12_dominators(h: History) -> DataFrame:
    """The entries of every tree through which every way from its last entry up to the root passes."""
    last = h.entries.groupBy("tree_id").agg(F.max_by("entry_id", "height").alias("entry_id"))
    return dag.dominators(h.edges, last)


_PART = "select * from entries_ where event_id % 89 <> 3"


@_query(f"""
    , here as materialized ({_PART}), wanted as (select tree_id, entry_id, height from here where store = 'purchase'), low as (select tree_id, min(height) as low from wanted group by tree_id),
    passing as materialized (select edges.* from edges join here on entry_id = child_id join low on low.tree_id = edges.tree_id where height >= low)
    {_up("seen", _cut_sql(2), "passing")},
    lost as (select tree_id from passing where child_id in (from seen) and parent_id not in (select entry_id from here) union select tree_id from entries_ where entry_id in ({_cut_sql(2)}) and entry_id not in (select entry_id from here))
    select tree_id, entry_id, case when entry_id in (from seen) then 'reachable' when tree_id in (from lost) then 'indeterminate' else 'unreachable' end as state from wanted""")
def g14_reachability(h: History) -> DataFrame:
    """Which purchases each tree's older snapshot has above it, where some entries are not here."""
    here = h.entries.where("event_id % 89 <> 3")
    return dag.reachability(here, h.edges, _cut(h, 2), here.where("store = 'purchase'").select("tree_id", "entry_id"))


_PLACED = "tree_id, entry_id, height, row_number() over (partition by tree_id order by height, entry_id) as position from entries_"


@_query(f"""{_up("old", _cut_sql(3))}{_up("new", _cut_sql(2))} select {_PLACED} where entry_id in (from new) and entry_id not in (from old)""")
def g15_ids_added(h: History) -> DataFrame:
    return dag.ids_added(h.entries, h.edges, _cut(h, 3), _cut(h, 2))


@_query(f"""{_up("path", _cut_sql(2) + " and entry_id not in (" + _cut_sql(3) + ")", where="where parent_id not in (" + _cut_sql(3) + ")")} select {_PLACED} where entry_id in (from path)""")
def g15_ids_added_strict(h: History) -> DataFrame:
    return dag.ids_added(h.entries, h.edges, _cut(h, 3), _cut(h, 2), strict=True)


@_query("select tree_id, entry_id, height, 0 as position from entries_ where false")
def g15_ids_added_backwards(h: History) -> DataFrame:
    """From a later snapshot to an earlier one nothing is added."""
    return dag.ids_added(h.entries, h.edges, _cut(h, 2), _cut(h, 3), strict=True)


@_query("select tree_id, store, entry_id, not exists (select 1 from store_edges s where s.parent_id = p.entry_id and s.store = p.store) as is_tip from patches p")
def g05_is_store_tip(h: History) -> DataFrame:
    return dag.subtree_tips(h.patches, h.store_edges).select("tree_id", "store", "entry_id", "is_tip")


@_query(f"select tree_id, case when tree_id like '%1' then 'empty_list' else 'not_found' end as error from (select distinct tree_id from entries_) where tree_id like '%1' or tree_id like '%2'")
def g11_merge_errors(h: History) -> DataFrame:
    """Trees for which nothing is asked, and those for which an entry of no tree is."""
    trees = h.entries.select("tree_id").distinct()
    asked = h.entries.where("height = 0 and tree_id not like '%1'").select("tree_id", "entry_id")
    absent = trees.where("tree_id like '%2'").select("tree_id", F.lit("absent").alias("entry_id"))
    return dag.merge_errors(h.entries, asked.unionByName(absent), trees)


_KEPT = f"""{_down("bad", "select entry_id from entries_ where status <> 0 and event_id % 89 <> 3 union select child_id from edges where parent_id in (select entry_id from entries_ where event_id % 89 = 3)")},
    kept as materialized (select * from entries_ where event_id % 89 <> 3 and entry_id not in (from bad))"""


@_query(f"{_KEPT} select tree_id, entry_id from kept k where not exists (select 1 from edges join kept c on c.entry_id = child_id where parent_id = k.entry_id)")
def g16_verified_frontier(h: History) -> DataFrame:
    here = h.entries.where("event_id % 89 <> 3")
    inner = h.edges.join(here.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")
    return verify.verified_frontier(here, inner).select("tree_id", "entry_id")


@_query(f"select tree_id, entry_id from ({_TIPS}) join entries_ using (tree_id, entry_id) where status <> 1")
def g17_snapshot_allow_unverified(h: History) -> DataFrame:
    return dag.tree_tips(h.entries, h.edges).where(F.col("status") != verify.FAILED).select("tree_id", "entry_id")


@_query(f""", here as materialized ({_PART}), links as materialized (select * from edges where child_id in (select entry_id from here))
    {_up("seen", "select entry_id from here where store = 'view' union select 'absent'", "links")}
    select entry_id from seen where entry_id not in (select entry_id from here)""")
def g18_missing_ancestors(h: History) -> DataFrame:
    here = h.entries.where("event_id % 89 <> 3")
    inner = h.edges.join(here.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")
    wanted = here.where("store = 'view'").select("entry_id").unionAll(h.spark.sql("select 'absent' as entry_id"))
    return dag.missing_ancestors(here, inner, wanted)


@_query(f"""{_up("send", "select entry_id from (" + _TIPS + ") where entry_id not in (" + _cut_sql(2) + ")", where="where parent_id not in (" + _cut_sql(2) + ")")} select entry_id from send""")
def g19_entries_to_send(h: History) -> DataFrame:
    return dag.ancestors(h.edges, dag.tree_tips(h.entries, h.edges), _cut(h, 2))


# Two peers: A holds seven tenths of the entries, B the other overlapping seven tenths.
_OURS = "select entry_id from entries_ e where event_id % 10 < 7 and not exists (select 1 from edges join entries_ c on c.entry_id = child_id where parent_id = e.entry_id and c.event_id % 10 < 7)"
_THEIRS = "select entry_id from entries_ e where event_id % 10 >= 3 and not exists (select 1 from edges join entries_ c on c.entry_id = child_id where parent_id = e.entry_id and c.event_id % 10 >= 3)"


@_query(f""", ours as materialized ({_OURS}), theirs as materialized ({_THEIRS})
    {_up("send", "select entry_id from ours where entry_id not in (from theirs)", where="where parent_id not in (from theirs)")} select entry_id from send""")
def g20_missing_for_peer(h: History) -> DataFrame:
    def tips(where: str) -> DataFrame:
        own = h.entries.where(where)
        return dag.tree_tips(own, h.edges.join(own.select(F.col("entry_id").alias("child_id")), "child_id", "left_semi")).select("entry_id")

    ours, theirs = tips("event_id % 10 < 7"), tips("event_id % 10 >= 3")
    return dag.ancestors(h.edges, ours.join(theirs, "entry_id", "left_anti"), theirs)


@_query(f"""{_up("seen", _cut_sql(2))} select entry_id, tree_id, row_number() over (partition by tree_id order by height, entry_id) as position from entries_ where entry_id in (from seen)""")
def g21_bootstrap_export(h: History) -> DataFrame:
    return store.ordered(dag.tree_at(h.entries, h.edges, _cut(h, 2)), "tree_id").select("entry_id", "tree_id", "position")


@_query("select tree_id, count(*) as n_entries, count(*) - 1 as n_without_root from entries_ group by tree_id")
def g22_tree_counts(h: History) -> DataFrame:
    return h.entries.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("height") > 0).alias("n_without_root"))


@_query("""select t.tree_id, t.entry_id, t.height, p.height as store_height, coalesce(case when t.store like 'c%' then null else p.height end, t.height) as own_height
    from entries_ t join patches p using (entry_id)""")
def g23_store_heights(h: History) -> DataFrame:
    """Stores whose name starts with c inherit the tree's height."""
    p = h.patches.select("entry_id", F.col("height").alias("store_height"))
    given = F.when(~F.col("store").startswith("c"), F.col("store_height"))
    return h.entries.join(p, "entry_id").select("tree_id", "entry_id", "height", "store_height", F.coalesce(given, "height").alias("own_height"))


@_query(""", ways(entry_id, height) as (select entry_id, 0 from entries_ where height = 0 union select child_id, ways.height + 1 from ways join edges on parent_id = entry_id)
    select entry_id, max(height) as height from ways group by entry_id""")
def g23_heights_incremental(h: History) -> DataFrame:
    """The height of every entry."""
    links = h.edges.select(F.col("child_id").alias("c"), F.col("parent_id").alias("p"))
    roots = h.entries.where("height = 0").select(F.col("entry_id").alias("n"))
    return hierarchy.values(links, roots).select(F.col("n").alias("entry_id"), F.col("depth").alias("height"))


@_query(""", ways(entry_id, height) as (select entry_id, ms // 40000000 from entries_ union select child_id, greatest(ways.height + 1, ms // 40000000) from ways join edges on parent_id = ways.entry_id join entries_ e on e.entry_id = child_id)
    select tree_id, entry_id, max(ways.height) as height from ways join entries_ using (entry_id) group by all""")
def g23_heights_timestamp(h: History) -> DataFrame:
    """Coarse times, so that the parents' heights matter."""
    return dag.timestamp_heights(h.entries.withColumn("ms", F.floor(F.col("ms") / 40000000)), h.edges)


@_query(f"select tree_id, string_agg(entry_id, ',' order by entry_id) as snapshot from ({_TIPS}) group by tree_id")
def g25_canonical_snapshot(h: History) -> DataFrame:
    tips = dag.tree_tips(h.entries, h.edges).groupBy("tree_id").agg(F.collect_list("entry_id").alias("t"))
    return tips.select("tree_id", F.array_join(dag.canonical_snapshot(F.concat("t", "t")), ",").alias("snapshot"))


@_query(f"select tree_id, sha256('merge:' || string_agg(entry_id, ':' order by entry_id)) as cache_key from ({_TIPS}) group by tree_id")
def g26_cache_key(h: History) -> DataFrame:
    tips = dag.tree_tips(h.entries, h.edges).groupBy("tree_id").agg(F.collect_list("entry_id").alias("t"))
    return tips.select("tree_id", dag.merge_key(F.reverse("t")).alias("cache_key"))


_VERIFY = f"""
    , unsettled as materialized (select * from entries_ where status = 2),
    links as materialized (select edges.* from edges join unsettled on entry_id = child_id),
    below_failed as (select child_id from links join entries_ p on p.entry_id = parent_id where p.status = 1)
    {_down("held", "select entry_id from unsettled where valid is null or not valid union select child_id from below_failed", "links")},
    settled as materialized (select entry_id from entries_ where status = 0 union select entry_id from unsettled where entry_id not in (from held))
    {_down("failed", "select entry_id from unsettled where valid = false and not exists (select 1 from links where child_id = unsettled.entry_id and parent_id not in (from settled)) union select child_id from below_failed", "links")},
    judged as (select *, case when status <> 2 then status when entry_id in (from failed) then 1 when entry_id in (from held) then 2 else 0 end as new_status from entries_)"""


@_query(f"{_VERIFY} select entry_id, new_status from judged")
def v01_verify(h: History) -> DataFrame:
    return verify.verify(h.entries, h.edges).select("entry_id", "new_status")


@_query(f"{_VERIFY} select count(*) filter (status = 2 and new_status = 0) as verified, count(*) filter (status = 2 and new_status = 1) as failed, count(*) filter (status = 2 and new_status = 2) as still_unverified from judged")
def v01_verify_report(h: History) -> DataFrame:
    return verify.report(verify.verify(h.entries, h.edges))


@_query(f"""{_down("below", "select entry_id from entries_ where event_id % 31 = 4")}
    select entry_id, case when event_id % 31 = 4 or (status = 0 and entry_id in (from below)) then 2 else status end as new_status from entries_""")
def v14_demote(h: History) -> DataFrame:
    return verify.demote(h.entries, h.edges, h.entries.where("event_id % 31 = 4").select("entry_id")).select("entry_id", "new_status")


def s14_tree_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Roots of the stored entries with the number of distinct entries and of recorded tips of their tree."""
    rows, tips = table(spark, folder, "entries"), table(spark, folder, "tips")
    roots = rows.where("is_root").select("id").distinct()
    n = rows.groupBy(F.col("tree_id").alias("id")).agg(F.count_distinct("id").alias("n_entries"))
    t = tips.where("store_name = ''").groupBy(F.col("tree_id").alias("id")).agg(F.count_distinct("entry_id").alias("n_tips"))
    return roots.join(n, "id", "left").join(t, "id", "left").select("id", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_tips", F.lit(0)).alias("n_tips"))


def s14_stale_tips(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded tips that are parents of a stored link by now."""
    parents = table(spark, folder, "tree_parents").where("parent_id is not null").select(F.col("parent_id").alias("entry_id"))
    return table(spark, folder, "tips").where("store_name = ''").select("entry_id", "tree_id").distinct().join(parents, "entry_id", "left_semi")


QUERIES |= {f.__name__: f for f in (s14_tree_listing, s14_stale_tips)}
SQL |= {
    "s14_tree_listing": """
        with n as (select tree_id, count(distinct id) as n from entries group by 1), t as (select tree_id, count(distinct entry_id) as n from tips where store_name = '' group by 1)
        select id, coalesce(n.n, 0) as n_entries, coalesce(t.n, 0) as n_tips from (select distinct id from entries where is_root) r left join n on n.tree_id = id left join t on t.tree_id = id""",
    "s14_stale_tips": "select distinct entry_id, tree_id from tips where store_name = '' and entry_id in (select parent_id from tree_parents)",
}
