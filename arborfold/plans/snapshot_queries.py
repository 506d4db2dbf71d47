"""Queries for reads at snapshots, commits and peers' exchanges over the derived history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.operators import commits, dag, fold
from arborfold.plans.graph_queries import _TIPS, _cut, _cut_sql, _down, _query_into, _up
from arborfold.plans.history import History

QUERIES: dict = {}
SQL: dict[str, str] = {}
_query = _query_into(QUERIES, SQL)

_LAST = "row_number() over (partition by {keys} order by height desc, entry_id desc) = 1"


@_query(f"""{_up("seen", _cut_sql(2, "patches", "tree_id, store"), "store_edges")}
    select tree_id, store, value, entry_id from patches where entry_id in (from seen) qualify {_LAST.format(keys="tree_id, store")}""")
def m05_state_at_store_tips(h: History) -> DataFrame:
    """Each store's last value at its own snapshot."""
    rows = dag.store_at(h.patches, h.store_edges, _cut(h, 2, True))
    return fold.last_writer(rows, ["tree_id", "store"], ["value"]).select("tree_id", "store", "value", "entry_id")


@_query(f"""{_up("seen", _cut_sql(2))} select tree_id, store, value, entry_id from patches where entry_id in (from seen) qualify {_LAST.format(keys="tree_id, store")}""")
def t19_state_at_snapshot(h: History) -> DataFrame:
    """Each store's last value at a snapshot of its tree."""
    rows = h.patches.join(dag.ancestors(h.edges, _cut(h, 2)), "entry_id", "left_semi")
    return fold.last_writer(rows, ["tree_id", "store"], ["value"]).select("tree_id", "store", "value", "entry_id")


@_query(f"""{_up("seen", _cut_sql(3, "patches", "tree_id, store"), "store_edges")} select store, entry_id, height, props from patches where entry_id in (from seen)""")
def t20_store_entries(h: History) -> DataFrame:
    return dag.store_at(h.patches, h.store_edges, _cut(h, 3, True)).select("store", "entry_id", "height", "props")


@_query("""
    , up(at_entry, entry_id) as (select entry_id, entry_id from entries_ union select at_entry, parent_id from up join edges on child_id = up.entry_id)
    select at_entry, store, value from up join patches using (entry_id) qualify row_number() over (partition by at_entry, store order by height desc, entry_id desc) = 1""")
def v02_pinned_states(h: History) -> DataFrame:
    """The state that each entry was pinned to, all at once."""
    return commits.states_at(h.patches, h.edges, h.entries, ["store"], ["value"]).select("at_entry", "store", "value")


@_query(f"""select 'new-' || tree_id as entry_id, max(height) + 1 as height, string_agg(entry_id, ',' order by entry_id) as parents, false as is_root
    from ({_TIPS}) join entries_ using (tree_id, entry_id) group by tree_id union all select 'new-none', 0, null, true""")
def w01_commit(h: History) -> DataFrame:
    """One new entry on the tips of every tree, and one that starts a tree."""
    trees = h.entries.select("tree_id").distinct().unionAll(h.spark.sql("select 'none' as tree_id"))
    rows, links = commits.commit(h.entries, h.edges, trees.withColumn("entry_id", F.concat(F.lit("new-"), "tree_id")))
    parents = links.groupBy(F.col("child_id").alias("entry_id")).agg(F.array_join(F.sort_array(F.collect_list("parent_id")), ",").alias("parents"))
    return rows.join(parents, "entry_id", "left").select("entry_id", "height", "parents", "is_root")


_SHARED = "event_id % 10 >= 3 and event_id % 10 < 7"


@_query("select entry_id, case when event_id % 10 < 3 then 'to_b' else 'to_a' end as direction from entries_ where event_id % 10 < 3 or event_id % 10 >= 7")
def y02_exchange(h: History) -> DataFrame:
    """What two peers send each other so that both have everything: two differences of id sets."""
    a, b = (h.entries.where(w).select("entry_id") for w in ("event_id % 10 < 7", "event_id % 10 >= 3"))
    to_b = a.join(b, "entry_id", "left_anti").withColumn("direction", F.lit("to_b"))
    return to_b.unionByName(b.join(a, "entry_id", "left_anti").withColumn("direction", F.lit("to_a")))


@_query(f""", theirs as materialized ({_cut_sql(2)}){_up("old", "select entry_id from theirs")}
    select tree_id, count(*) as n_missing, min(entry_id) as first_missing from entries_ where entry_id not in (from old) group by tree_id""")
def y01_incremental_response(h: History) -> DataFrame:
    """Per tree what a peer that stands at an older snapshot is missing."""
    added = dag.ids_added(h.entries, h.edges, _cut(h, 2), dag.tree_tips(h.entries, h.edges))
    return added.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_missing"), F.min("entry_id").alias("first_missing"))


@_query(f"""{_down("below", "select entry_id from entries_ where event_id % 61 = 5")} select tree_id, count(*) as n_below from entries_ where entry_id in (from below) group by tree_id""")
def g03_descendants_of_late_entries(h: History) -> DataFrame:
    """How many entries of each tree hang on entries that came late."""
    late = h.entries.where("event_id % 61 = 5").select("entry_id")
    return h.entries.join(dag.descendants(h.edges, late), "entry_id", "left_semi").groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_below"))
