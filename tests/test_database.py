import json

import pytest

from arborfold.database import Database, EntryNotFound, EntryNotInTree

EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "c")]
HEIGHT = {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 2}


@pytest.fixture(scope="module")
def db(spark):
    entries = spark.createDataFrame([("t", i, h, 2 if i in "ef" else 0, True) for i, h in HEIGHT.items()] + [("u", "z", 0, 0, True)], "tree_id string, entry_id string, height int, status int, valid boolean")
    edges = spark.createDataFrame([("t", c, p) for c, p in EDGES], "tree_id string, child_id string, parent_id string")
    rows = [("t", "people", i, HEIGHT[i], k, None if n is None else json.dumps({"n": n}), "leaf" if n is not None else "deleted") for i, k, n in (("a", "x", 1), ("b", "x", 2), ("c", "y", 3), ("d", "x", None), ("f", "y", 4))]
    patches = spark.createDataFrame(rows, "tree_id string, store string, entry_id string, height int, key string, row string, kind string")
    store_edges = spark.createDataFrame([("t", "people", "b", "a"), ("t", "people", "c", "a"), ("t", "people", "d", "b"), ("t", "people", "d", "c"), ("t", "people", "f", "c")], "tree_id string, store string, child_id string, parent_id string")
    return Database(entries, edges, patches, store_edges, "t")


def people(db):
    return {(r["key"], r["n"]) for r in db.table("people", "n int").rows().collect()}


def test_states_now_and_then(db):
    assert people(db) == {("y", 4)}
    assert people(db.at(["b", "c"])) == {("x", 2), ("y", 3)}
    assert people(db.at(["a"])) == {("x", 1)}
    assert people(db.at([])) == set()
    assert {r["entry_id"] for r in db.store_snapshot("people").collect()} == {"d", "f"}
    assert {r["entry_id"] for r in db.at(["b", "c"]).store_snapshot("people").collect()} == {"b", "c"}


def test_snapshots_and_differences(db):
    assert db.snapshot() == ["e", "f"] and db.snapshot(verified=True) == ["d"]
    assert sorted(r["entry_id"] for r in db.at(["d"]).entries().collect()) == ["a", "b", "c", "d"]
    assert sorted(r["entry_id"] for r in db.added_since(["b", "c"]).collect()) == ["d", "e", "f"]
    assert sorted(r["entry_id"] for r in db.missing_for(["d"]).collect()) == ["a", "c", "e", "f"]
    assert db.merge_base(["b", "c"]) == "a" and db.merge_base(["e"]) == "e" and db.merge_base(["e", "f"]) == "a"
    assert {r["entry_id"] for r in db.verify().where("new_status = 0").collect()} == set("abcdef")


def test_errors(db):
    assert db.get("a")["height"] == 0
    for call in (lambda: db.get("none"), lambda: db.at(["none"])):
        with pytest.raises(EntryNotFound):
            call()
    for call in (lambda: db.get("z"), lambda: db.at(["z"])):
        with pytest.raises(EntryNotInTree):
            call()
