"""An entry graph derived from the events table, the same in Spark and in SQL.

Each user's events form a tree; the event type is the store. An event's parents are its predecessor (every seventh: the
one before that) and, for every fifth, the third before it, in the order of time and id; store parents follow the same
rule within the store. Heights are positions in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfold.sources.tables import table


def _edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    p = {i: F.lag("entry_id", i).over(w).alias(f"p{i}") for i in (1, 2, 3)}
    with_parents = rows.select(*keys, "entry_id", "event_id", *p.values())
    first = F.when(F.col("event_id") % 7 == 0, F.coalesce("p2", "p1")).otherwise(F.col("p1"))
    second = F.when(F.col("event_id") % 5 == 0, F.col("p3"))
    each = with_parents.select(*keys, F.col("entry_id").alias("child_id"), F.explode(F.array_distinct(F.array(first, second))).alias("parent_id"))
    return each.where("parent_id is not null")


class History:
    """entries, edges, patches and store_edges of the derived graph."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        events = table(spark, folder, "events")
        rows = events.select(F.col("user_id").cast("string").alias("tree_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("entry_id"), F.col("event_type").alias("store"), "ts", "event_id", "user_id", "value", "props")
        self.events = rows
        in_tree = Window.partitionBy("tree_id").orderBy("ts", "event_id")
        in_store = Window.partitionBy("tree_id", "store").orderBy("ts", "event_id")
        status = F.when(F.col("event_id") % 97 == 0, 1).when(F.col("event_id") % 11 == 0, 2).otherwise(0)
        valid = F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("boolean")).otherwise(F.col("event_id") % 23 != 0)
        self.entries = rows.select("tree_id", "entry_id", "store", "event_id", (F.row_number().over(in_tree) - 1).cast("bigint").alias("height"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)").alias("ms"), status.alias("status"), valid.alias("valid"))
        self.edges = _edges(rows, ["tree_id"])
        self.patches = rows.select("tree_id", "store", "entry_id", "event_id", (F.row_number().over(in_store) - 1).cast("bigint").alias("height"), "value", "props")
        self.store_edges = _edges(rows, ["tree_id", "store"])


def _edge_sql(keys: str) -> str:
    return f"""
        select distinct {keys}, entry_id as child_id, unnest([case when event_id % 7 = 0 then coalesce(p2, p1) else p1 end, case when event_id % 5 = 0 then p3 end]) as parent_id
        from (select *, lag(entry_id, 1) over w as p1, lag(entry_id, 2) over w as p2, lag(entry_id, 3) over w as p3 from ev window w as (partition by {keys} order by ts, event_id))"""


#: Common table expressions ev, entries_, edges, patches, store_edges, after "with recursive".
HISTORY_SQL = f"""
    ev as (select cast(user_id as varchar) as tree_id, lpad(cast(event_id as varchar), 12, '0') as entry_id, event_type as store, ts, event_id, user_id, value, props from events),
    entries_ as materialized (select tree_id, entry_id, store, event_id, row_number() over (partition by tree_id order by ts, event_id) - 1 as height, epoch_us(ts) // 1000 as ms,
                   case when event_id % 97 = 0 then 1 when event_id % 11 = 0 then 2 else 0 end as status,
                   case when event_id % 13 = 0 then null else event_id % 23 <> 0 end as valid from ev),
    edges as materialized (select * from ({_edge_sql("tree_id")}) where parent_id is not null),
    patches as materialized (select tree_id, store, entry_id, event_id, row_number() over (partition by tree_id, store order by ts, event_id) - 1 as height, value, props from ev),
    store_edges as materialized (select * from ({_edge_sql("tree_id, store")}) where parent_id is not null)"""
