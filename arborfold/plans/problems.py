"""Queries over the test tables for the hierarchy, percentile, reference, skew and interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.functions.times import utc_date, utc_month
from arborfold.operators import hierarchy, intervals, percentiles, references, skew
from arborfold.sources.tables import table

PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Leading binary digits kept by daily summaries: percentiles are off by at most value / 2**9, 0.2 %, at any magnitude.
BITS = 9
MEASURES = ("duration_ms", "bytes_transferred")


def _forest(spark: SparkSession, folder: str, hashed: bool) -> tuple[DataFrame, DataFrame]:
    """Links and root entries; by 64-bit keys where only numbers are needed and no two ids share a key."""
    links = table(spark, folder, "tree_parents").select(F.col("child_id").alias("c"), F.col("parent_id").alias("p")).dropna()
    roots = table(spark, folder, "entries").where("is_root").select(F.col("id").alias("n"))
    if hashed:
        links = links.select(hierarchy.keyed(F.col("c")).alias("c"), hierarchy.keyed(F.col("p")).alias("p"))
        roots = roots.select(hierarchy.keyed(F.col("n")).alias("n"))
    return links, roots


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries on cycles, and entries whose height is not the length of the longest way up to a root."""
    links_raw, entries_raw = table(spark, folder, "tree_parents"), table(spark, folder, "entries")
    hashed = not hierarchy.keys_collide(links_raw.select("child_id"), links_raw.select("parent_id"), entries_raw.select("id"))
    key = hierarchy.keyed if hashed else (lambda c: c)
    links, roots = _forest(spark, folder, hashed)
    forest = hierarchy.Hierarchy(links, roots)
    found = forest.values
    entries = entries_raw.where("height is not null").groupBy(key(F.col("id")).alias("n")).agg(F.max("id").alias("entry_id"), F.max("height").alias("height"))
    heights = entries.join(found.where("not bad and not cyclic"), "n").where("depth <> height").select("entry_id", F.lit("height").alias("problem"))
    looped = forest.on_cycles()
    names = links_raw.select(key(F.col("child_id")).alias("n"), F.col("child_id").alias("entry_id"))
    cycles = names.join(looped, "n").select("entry_id", F.lit("cycle").alias("problem")).distinct()
    return heights.unionByName(cycles)


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry or linked id: its path from the root, depth, root, and whether a way up fails or runs into a cycle."""
    links, roots = _forest(spark, folder, hashed=False)
    found = hierarchy.values(links, roots, "path")
    return found.select(F.col("n").alias("entry_id"), F.substring_index("path", hierarchy.SEP, 1).alias("root_id"), "depth", "path", "bad", "cyclic")


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every (ancestor, descendant) pair of entries; one on a cycle is its own ancestor."""
    links, roots = _forest(spark, folder, hashed=False)
    found = hierarchy.values(links, roots, "ancestors")
    return found.select(F.explode("ancestors").alias("entry_id"), F.col("n").alias("descendant_id"))


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of every peer, put together from the summaries of single days."""
    rows = table(spark, folder, "sync_history").withColumn("day", utc_date(F.col("started_at")))
    daily = percentiles.value_counts(rows, ["day", "peer_pubkey"], {m: F.col(m) for m in MEASURES}, BITS)
    merged = percentiles.merge_counts([daily], ["peer_pubkey"])
    return percentiles.percentiles(merged, ["peer_pubkey"], PROBABILITIES)


def p2_percentiles_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The same percentiles from counts of the values as they are."""
    rows = table(spark, folder, "sync_history")
    counts = percentiles.value_counts(rows, ["peer_pubkey"], {m: F.col(m) for m in MEASURES})
    return percentiles.percentiles(counts, ["peer_pubkey"], PROBABILITIES)


def p2_daily_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The mergeable form: one frequency for each day, peer, measure and bucket."""
    rows = table(spark, folder, "sync_history").withColumn("day", utc_date(F.col("started_at")))
    return percentiles.value_counts(rows, ["day", "peer_pubkey"], {m: F.col(m) for m in MEASURES}, BITS)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "tree_parents").where("parent_id is not null")
    by_link = links.groupBy("child_id", "parent_id").agg(F.min("recorded_at").alias("at"))
    from_links = by_link.select(F.lit("tree_parents").alias("ref_table"), F.col("child_id").alias("ref_id"), F.col("parent_id").alias("target_id"), "at")
    rows = table(spark, folder, "entries")
    targets = rows.groupBy("id").agg(F.min("received_at").alias("first_at"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"), F.max("tree_id").alias("tree_id"))
    from_entries = targets.where("tree_id is not null").select(F.lit("entries").alias("ref_table"), F.col("id").alias("ref_id"), F.col("tree_id").alias("target_id"), F.col("first_at").alias("at"))
    refs = from_links.unionByName(from_entries)
    found = references.orphans(refs, targets.drop("tree_id"), F.col("ref_table") == "tree_parents")
    return found.withColumn("period", utc_month(F.col("at")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphan references (missing, deleted or late targets), from the result of the cascade that also has the inherited ones."""
    found = _orphans(spark, folder).where("kind = 'direct'")
    return found.select("ref_table", "ref_id", F.col("target_id").alias("missing_id"), "reason", "period")


def p3_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphan reference, direct or inherited."""
    return _orphans(spark, folder).select("ref_table", "ref_id", "target_id", "reason", "kind", "period")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, month, kind and reason."""
    return _orphans(spark, folder).groupBy("ref_table", "period", "kind", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("target_id").alias("n_targets"))


def p4_per_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct entries, heights, arrivals and deleted rows of every tree."""
    rows, height, at = table(spark, folder, "entries"), F.col("height"), F.unix_micros("received_at")
    measures = {"max_height": (height, skew.MAX), "min_height": (height, skew.MIN), "sum_height": (height, skew.SUM), "n_heights": (height, skew.COUNT), "n_deleted": (F.col("deleted_at"), skew.COUNT), "last_received_us": (at, skew.MAX)}
    return skew.per_key(rows, "tree_id", "id", measures).withColumn("mean_height", F.round(F.col("sum_height") / F.col("n_heights"), 6)).drop("sum_height")


def p4_per_store(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct entries and the first and last entry of every store name."""
    return skew.per_key(table(spark, folder, "tips"), "store_name", "entry_id")


def _syncs(spark: SparkSession, folder: str) -> tuple:
    return table(spark, folder, "sync_history"), "peer_pubkey", F.unix_micros("started_at"), F.unix_micros("completed_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps between the continuous periods of each peer."""
    found = intervals.gaps(*_syncs(spark, folder))
    return found.select("peer_pubkey", F.col("gap_start").alias("gap_start_us"), F.col("gap_end").alias("gap_end_us"))


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous periods of each peer."""
    found = intervals.periods(*_syncs(spark, folder))
    return found.select("peer_pubkey", F.col("period_start").alias("period_start_us"), F.col("period_end").alias("period_end_us"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_percentiles, p2_percentiles_exact, p2_daily_summary, p3_found, p3_cascade, p3_report, p4_per_tree, p4_per_store, p5_found, p5_periods)}

_UNPIVOTED = """
    select peer_pubkey, cast(started_at as date) as day, 'duration_ms' as measure, duration_ms as v from sync_history
    union all
    select peer_pubkey, cast(started_at as date), 'bytes_transferred', cast(bytes_transferred as double) from sync_history"""
_ROUNDED = f"""
    select peer_pubkey, day, measure, v, g + case when abs(v) >= pow(2.0, g + 1) then 1 when abs(v) < pow(2.0, g) then -1 else 0 end as e
    from (select *, case when v <> 0 and not isnan(v) and not isinf(v) then floor(log2(abs(v))) end as g from ({_UNPIVOTED}) where v is not null)"""
_BUCKETED = f"""
    select peer_pubkey, day, measure, case when v = 0 then 0.0::double when e is null then v
        else least(floor(abs(v) / pow(2.0, e) * {2 ** (BITS - 1)} + 0.5) / {2 ** (BITS - 1)} * pow(2.0, e), 1.7976931348623157e308) * sign(v) end as value
    from ({_ROUNDED})"""
_RANKED = """
    select peer_pubkey, measure, count(*) as n_values, {columns}
    from (select *, row_number() over (partition by peer_pubkey, measure order by value) as r,
                 count(*) over (partition by peer_pubkey, measure) as n from ({source}))
    group by peer_pubkey, measure"""


def _percentile_sql(source: str) -> str:
    columns = ", ".join(f"min(case when r >= greatest(ceil({p}::decimal(10,6) * n), 1) then value end) as p{100 * p:g}".replace(".", "_", 0) for p in PROBABILITIES)
    return _RANKED.format(columns=columns, source=source)


_ORPHANS = """
    with recursive targets as (select id, min(received_at) as first_at, bool_or(deleted_at is not null) as deleted, max(tree_id) as tree_id from entries group by id),
    refs as (select 'tree_parents' as ref_table, child_id as ref_id, parent_id as target_id, min(recorded_at) as made from tree_parents where parent_id is not null group by child_id, parent_id
             union all select 'entries', id, tree_id, first_at from targets where tree_id is not null),
    judged as materialized (select refs.*, case when id is null then 'missing' when deleted then 'deleted' when first_at > made then 'late' end as reason from refs left join targets on target_id = id),
    tainted(n) as (select ref_id from judged where reason in ('missing', 'deleted')
                   union select ref_id from judged join tainted on target_id = n),
    every as (select ref_table, ref_id, target_id, reason, 'direct' as kind, strftime(made, '%Y-%m') as period from judged where reason is not null
              union all select ref_table, ref_id, target_id, 'inherited', 'inherited', strftime(made, '%Y-%m') from judged where reason is null and target_id in (select n from tainted))"""

_COUNTED = "select peer_pubkey, started_at as a, completed_at as b from sync_history where peer_pubkey is not null and completed_at > started_at"
_REACHED = f"select *, max(b) over (partition by peer_pubkey order by a, b rows between unbounded preceding and 1 preceding) as reach from ({_COUNTED})"

_LINKS = "select distinct child_id as c, parent_id as p from tree_parents where child_id is not null and parent_id is not null"
_CYCLIC = f"""
    links as materialized ({_LINKS}),
    up(n, a) as (select c, p from links union select up.n, links.p from up join links on links.c = up.a),
    looped as materialized (select distinct n from up where n = a),
    cyclic as materialized (select n from looped union select up.n from up join looped on looped.n = up.a)"""

SQL = {
    "p1_found": f"""
        with recursive {_CYCLIC},
        roots as (select distinct id from entries where is_root),
        tops as (select p as n from links where p not in (select c from links) union select id from roots where id not in (select c from links)),
        ways(n, top, d) as (select n, n, 0 from tops union
                            select c, top, d + 1 from ways join links on links.p = ways.n where c not in (select n from cyclic)),
        depths as (select n, max(d) as depth, bool_or(top not in (select id from roots)) as bad from ways group by n)
        select entry_id, 'height' as problem
        from (select id as entry_id, max(height) as height from entries where height is not null group by id) join depths on n = entry_id
        where not bad and depth <> height
        union all select n, 'cycle' from looped""",
    "p1_hierarchy": f"""
        with recursive {_CYCLIC},
        roots as (select distinct id from entries where is_root),
        tops as (select p as n from links where p not in (select c from links) union select id from roots where id not in (select c from links)),
        ways(n, path, d) as (select n, n, 0 from tops union
                             select c, path || '/' || c, d + 1 from ways join links on links.p = ways.n where c not in (select n from cyclic)),
        best as (select n, max(d) as depth, bool_or(split_part(path, '/', 1) not in (select id from roots)) as bad,
                        (array_agg(path order by d desc, path))[1] as path from ways group by n)
        select n as entry_id, split_part(path, '/', 1) as root_id, depth, path, bad, false as cyclic
        from best where n in (select c from links) or n in (select id from roots)
        union all select n, null, null, null, null, true from cyclic""",
    "p1_descendants": f"""
        with recursive {_CYCLIC}
        select distinct a as entry_id, n as descendant_id from up""",
    "p2_percentiles": _percentile_sql(_BUCKETED),
    "p2_percentiles_exact": _percentile_sql(f"select peer_pubkey, measure, v as value from ({_UNPIVOTED}) where v is not null"),
    "p2_daily_summary": f"select day, peer_pubkey, measure, value, count(*) as n from ({_BUCKETED}) group by all",
    "p3_found": f"{_ORPHANS} select ref_table, ref_id, target_id as missing_id, reason, period from every where kind = 'direct'",
    "p3_cascade": f"{_ORPHANS} select * from every",
    "p3_report": f"{_ORPHANS} select ref_table, period, kind, reason, count(*) as n_refs, count(distinct target_id) as n_targets from every group by all",
    "p4_per_tree": """
        select tree_id, count(*) as n_rows, count(distinct id) as n_distinct, min(id) as first_2nd, max(id) as last_2nd,
               max(height) as max_height, min(height) as min_height, count(height) as n_heights, count(deleted_at) as n_deleted,
               max(epoch_us(received_at)) as last_received_us, round(cast(sum(height) as double) / nullif(count(height), 0), 6) as mean_height
        from entries group by tree_id""",
    "p4_per_store": """
        select store_name, count(*) as n_rows, count(distinct entry_id) as n_distinct, min(entry_id) as first_2nd, max(entry_id) as last_2nd
        from tips group by store_name""",
    "p5_found": f"select peer_pubkey, epoch_us(reach) as gap_start_us, epoch_us(a) as gap_end_us from ({_REACHED}) where a > reach",
    "p5_periods": f"""
        select peer_pubkey, epoch_us(min(a)) as period_start_us, epoch_us(max(b)) as period_end_us
        from (select *, sum(case when reach is null or a > reach then 1 else 0 end)
                        over (partition by peer_pubkey order by a, b rows unbounded preceding) as period from ({_REACHED}))
        group by peer_pubkey, period""",
}
