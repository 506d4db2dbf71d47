"""Entries and table events as streams: idempotent ingest, tips, folds, promotions and a change feed.

Every entry is accepted however late it comes, so there are no watermarks: the state of the order-independent aggregates
is one row per entry or key, which is what the batch operators would compute from all rows so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborfold.operators.verify import UNVERIFIED, verify


def tips(entries: DataFrame) -> DataFrame:
    """A streaming aggregate of entries (tree_id, entry_id, parents): tree_id, entry_id, seen, has_child.

    Tips are the rows that are seen and have no child; a child may arrive before its parent, and repeated entries change
    nothing. Use it in complete or update mode.
    """
    own = F.array(F.struct(F.col("entry_id").alias("id"), F.lit(True).alias("seen")))
    above = F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.struct(p.alias("id"), F.lit(False).alias("seen")))
    each = entries.select("tree_id", F.explode(F.concat(own, above)).alias("e"))
    return each.groupBy("tree_id", F.col("e.id").alias("entry_id")).agg(F.max("e.seen").alias("seen"), F.max(~F.col("e.seen")).alias("has_child"))


def table_state(events: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """A streaming last-writer-wins fold: one row per key with the values of its last event, tombstones included."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def write_state(state: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps a streaming state in a folder, which read_state() reads; each batch adds the rows that it changed.

    A batch has a sub-folder of its own, so that readers never see half of one and a batch that is run again replaces its
    own. The query ends when what is there has been read; with `every` (30 seconds, say) it goes on and looks again.
    """

    def add(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = state.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return _start(writer, every)


def read_state(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The state that write_state() has kept: the last row of every key."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def compact_state(spark: SparkSession, folder: str, keys: list[str], to: str) -> None:
    """Writes the state as a folder with one batch, for when a state has been changed many times."""
    last = spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    read_state(spark, folder, keys).write.mode("overwrite").parquet(f"{to}/batch={last}")


def _start(writer, every: str | None) -> StreamingQuery:  # noqa: ANN001
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest(entries: DataFrame, folder: str, checkpoint: str, on_new: Callable[[DataFrame, int], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Appends entries whose id is not stored yet, one sub-folder per batch; a batch that is run again replaces its own.

    The query ends when what is there has been read; with `every` (30 seconds, say) it goes on and looks again.

    on_new gets what a batch added, which is the change feed: entries of consecutive batches, without gaps or repeats.
    """

    def add(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(["entry_id"])
        stored = _stored(spark, folder, batch)
        if stored is not None:
            new = new.join(stored.select("entry_id"), "entry_id", "left_anti").select(df.columns)
        new.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if on_new is not None:
            on_new(spark.read.schema(df.schema).parquet(f"{folder}/batch={batch}"), batch)

    return _start(entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint), every)


def changes(spark: SparkSession, folder: str, cursor: int = -1) -> tuple[DataFrame, int]:
    """What ingest() has added to a folder after a cursor, with its batch, and the cursor for the next call.

    A subscriber that keeps its cursor gets every entry once, whenever it asks, without gaps or repeats.
    """
    rows = spark.read.parquet(folder)
    last = rows.agg(F.max("batch")).first()[0]
    upto = cursor if last is None else max(cursor, last)
    return rows.where((F.col("batch") > cursor) & (F.col("batch") <= upto)), upto


def _stored(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder).where(F.col("batch") < batch)


def promote(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """What a batch promotes: unverified entries that are verified now that their ancestors are here."""
    return verify(entries, edges).where((F.col("status") == UNVERIFIED) & (F.col("new_status") != UNVERIFIED)).select("tree_id", "entry_id", "new_status")
