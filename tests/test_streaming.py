from arborfold import streaming
from pyspark.sql import functions as F

SCHEMA = "tree_id string, entry_id string, parents array<string>"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_parents_and_repeats(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    write(spark, source, [("t", "c", ["b"]), ("t", "b", ["a"]), ("t", "c", ["b"])])

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streaming.write_state(streaming.tips(stream), out, check).awaitTermination()
        return {r["entry_id"] for r in streaming.read_state(spark, out, ["tree_id", "entry_id"]).where("seen and not has_child").collect()}

    assert run() == {"c"}
    write(spark, source, [("t", "a", None), ("t", "d", ["a"])])
    assert run() == {"c", "d"}


def test_ingest_is_idempotent_and_feeds_changes(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    feed = []

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streaming.ingest(stream, out, check, lambda df, b: feed.append(sorted(r["entry_id"] for r in df.collect()))).awaitTermination()

    write(spark, source, [("t", "a", None), ("t", "a", None), ("t", "b", ["a"])])
    run()
    write(spark, source, [("t", "b", ["a"]), ("t", "c", ["b"])])
    run()
    assert feed == [["a", "b"], ["c"]]
    assert sorted(r["entry_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    first, cursor = streaming.changes(spark, out)
    assert first.count() == 3 and streaming.changes(spark, out, cursor)[0].count() == 0
    assert sorted(r["entry_id"] for r in streaming.changes(spark, out, 0)[0].collect()) == ["c"]


def test_streaming_fold(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "key string, v int, at int"
    for rows in ([("a", 1, 5), ("b", 1, 1)], [("a", 2, 3), ("b", 2, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        state = streaming.table_state(spark.readStream.schema(schema).parquet(source), ["key"], ["v"], ["at"])
        streaming.write_state(state, out, check).awaitTermination()
    assert {(r["key"], r["v"]) for r in streaming.read_state(spark, out, ["key"]).collect()} == {("a", 1), ("b", 2)}
    streaming.compact_state(spark, out, ["key"], f"{out}-small")
    assert {(r["key"], r["v"]) for r in streaming.read_state(spark, f"{out}-small", ["key"]).collect()} == {("a", 1), ("b", 2)}


def test_promotion(spark):
    entries = spark.createDataFrame([("t", "a", 0, True), ("t", "b", 2, True), ("t", "c", 2, True), ("t", "x", 2, True)], "tree_id string, entry_id string, status int, valid boolean")
    edges = spark.createDataFrame([("t", "b", "a"), ("t", "c", "b"), ("t", "x", "missing")], "tree_id string, child_id string, parent_id string")
    assert {r["entry_id"] for r in streaming.promote(entries, edges).where(F.col("new_status") == 0).collect()} == {"b", "c"}
