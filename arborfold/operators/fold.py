"""Folding histories into states: last writer wins on flat tables, prefix kills on nested documents.

Merging is associative but neither commutative nor idempotent, so every rule uses the canonical order of entries,
(height, entry_id): a fold is then one aggregate or join, not a walk over the history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("height", "entry_id")


def last_writer(events: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """keys, values and order of the last event of each key, tombstones (kind 'deleted') included.

    This is also the mergeable state of a flat table: folding it with later or earlier events gives the whole fold.
    """
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(*keys).agg(last.alias("_v"), F.max(F.struct(*order)).alias("_o")).select(*keys, *[f"_v.{v}" for v in values], *[f"_o.{o}" for o in order])


def live(state: DataFrame) -> DataFrame:
    """A folded state without tombstones."""
    return state.where("kind <> 'deleted'")


def overlay(state: DataFrame, staged: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A state with staged events laid over it; they come after everything committed, in their own order (seq)."""
    a = state.select(*keys, *values, F.lit(-1).cast("bigint").alias("seq"))
    return last_writer(a.unionByName(staged.select(*keys, *values, F.col("seq").cast("bigint").alias("seq"))), keys, values, ["seq"]).drop("seq")


def live_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The events of nested documents that no later event further up the path kills.

    events has keys, path (array of segments), cont (for each segment d or l, what holds it: a document or a list), kind
    (doc, adoc (atomic), list, deleted, or a leaf: null, bool, int, text), value and the order. An event dies of a later
    leaf, deleted or adoc above it, of a later list above a segment held by a document, and of a later doc above one held
    by a list. The result is
    the mergeable state: with more events, earlier or later ones, it can be given to this function again.
    """
    order = F.struct(*ORDER)
    killers = (
        events.groupBy(*keys, F.col("path").alias("_prefix"))
        .agg(
            F.max(F.when(~F.col("kind").isin("doc", "list"), order)).alias("_hard"),
            F.max(F.when(F.col("kind") == "list", order)).alias("_list"),
            F.max(F.when(F.col("kind") == "doc", order)).alias("_doc"),
        )
    )
    above = events.where(F.size("path") > 0).select(*keys, "path", *ORDER, "cont", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("_n"))
    above = above.withColumn("_prefix", F.slice("path", F.lit(1), F.col("_n"))).withColumn("_held", F.element_at("cont", F.col("_n") + 1))
    killed = (F.col("_hard") > order) | ((F.col("_held") == "d") & (F.col("_list") > order)) | ((F.col("_held") == "l") & (F.col("_doc") > order))
    dead = above.join(killers, [*keys, "_prefix"]).where(killed).select(*keys, "path", *ORDER).distinct()
    return events.join(dead, [*keys, "path", *ORDER], "left_anti")


def decide(alive: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, path, kind, value, atomic of each path: the last live event; a document is atomic since its last other event."""
    order = F.struct(*ORDER)
    folded = alive.groupBy(*keys, "path").agg(
        F.max_by(F.struct("kind", "value"), order).alias("_v"),
        F.max(F.when(F.col("kind") == "adoc", order)).alias("_a"),
        F.max(F.when(~F.col("kind").isin("doc", "adoc"), order)).alias("_n"),
    )
    kind = F.when(F.col("_v.kind") == "adoc", "doc").otherwise(F.col("_v.kind"))
    atomic = F.coalesce((kind == "doc") & F.col("_a").isNotNull() & (F.col("_n").isNull() | (F.col("_a") > F.col("_n"))), F.lit(False))
    return folded.select(*keys, "path", kind.alias("kind"), F.col("_v.value").alias("value"), atomic.alias("atomic"))


def nested(events: DataFrame, keys: Sequence[str], prefix: Sequence[str] = ()) -> DataFrame:
    """The folded documents, tombstones included. With a prefix only events at, above or below it are read."""
    if prefix:
        want = F.array(*[F.lit(p) for p in prefix])
        n = F.least(F.size("path"), F.lit(len(prefix)))
        events = events.where(F.slice("path", F.lit(1), n) == F.slice(want, F.lit(1), n))
    return decide(live_events(events, keys), keys)


def quoted(text: Column) -> Column:
    """A text as JSON, with quotes and escapes."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, 2, F.length(whole) - 2)


def to_json(state: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """keys and json: each document as JSON with sorted keys, tombstones hidden, lists in the order of their positions.

    depth is the longest path. Nodes are joined level by level from below; a document without visible children is {}.
    Numbers, booleans and null are written as such, all other leaves as texts; keys and texts are escaped.
    """
    shown = state.where("kind <> 'deleted'")
    leaf = F.when(F.col("kind") == "null", "null").when(F.col("kind").isin("int", "bool"), F.col("value")).otherwise(quoted(F.col("value")))
    below = None
    for level in range(depth, 0, -1):
        nodes = shown.where(F.size("path") == level)
        if below is not None:
            nodes = nodes.join(below, [*keys, "path"], "left")
        else:
            nodes = nodes.withColumn("_doc", F.lit(None).cast("string")).withColumn("_list", F.lit(None).cast("string"))
        text = F.when(F.col("kind") == "list", F.concat(F.lit("["), F.coalesce("_list", F.lit("")), F.lit("]")))
        text = text.when(F.col("kind") == "doc", F.concat(F.lit("{"), F.coalesce("_doc", F.lit("")), F.lit("}"))).otherwise(leaf)
        each = nodes.select(*keys, F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("k"), text.alias("t")).alias("_e"))
        ordered = F.sort_array(F.collect_list("_e"))
        below = each.groupBy(*keys, "path").agg(
            F.array_join(F.transform(ordered, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["t"])), ",").alias("_doc"),
            F.array_join(ordered.getField("t"), ",").alias("_list"),
        )
    docs = state.select(*keys).distinct().join(below.drop("path"), list(keys), "left")
    return docs.select(*keys, F.concat(F.lit("{"), F.coalesce("_doc", F.lit("")), F.lit("}")).alias("json"))


def merge_settings(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combined sync settings: any enabled, any on commit, the shortest interval that is given."""
    return settings.groupBy(*keys).agg(F.bool_or("sync_enabled").alias("sync_enabled"), F.bool_or("sync_on_commit").alias("sync_on_commit"), F.min("interval_seconds").alias("interval_seconds"))


def merge_properties(properties: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, property, value: the last value given for each property."""
    return properties.groupBy(*keys, "property").agg(F.max_by("value", F.struct(*order)).alias("value"))


def custom(events: DataFrame, keys: Sequence[str], step: Callable[[Any, dict], Any], result: str = "string") -> DataFrame:
    """keys and state: a user's own merge, called as step(state, row) for the events of a key in canonical order.

    state is None at first. Rows are sorted within partitions of the keys and read as a stream, so memory holds one state
    at a time however many events a key has; one key's events are folded by one task, as the merge knows no other order.
    """
    types = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    ordered = events.repartition(*keys).sortWithinPartitions(*keys, *ORDER)
    names = [*keys, "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        key, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if key is not None and now != key:
                    out.append(dict(zip(names, (*key, state))))
                    state = None
                key, state = now, step(state, row)
            schema = pa.schema([*(batch.schema.field(k) for k in keys), ("state", pa.string() if result == "string" else pa.int64())])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if key is not None:
            out.append(dict(zip(names, (*key, state))))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, f"{types}, state {result}")
