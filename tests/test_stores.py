"""Registries, settings, transactions and claims on small cases that the test tables do not have."""

import pytest

from arborfold.operators import auth, stores, tables, transactions

EVENTS = "tree_id string, path array<string>, cont array<string>, kind string, value string, height int, entry_id string"


def documents(spark, rows=()):
    return tables.Documents(spark.createDataFrame(list(rows), EVENTS), ["tree_id"])


def test_registry_keeps_settings(spark):
    r, k = stores.Registry(documents(spark)), ("t",)
    r.set_entry(k, "todo", "docstore", "{}")
    r.documents.set(k, "todo.settings", {"color": "red"})
    r.set_entry(k, "todo", "table", "{1}")
    assert r.get_entry(k, "todo") == {"type": "table", "config": "{1}", "settings": {"color": "red"}} and r.settings(k, "todo") == {"color": "red"}
    assert r.contains(k, "todo") and not r.contains(k, "absent") and r.list(k) == ["todo"]
    assert r.documents.delete(k, "todo") and r.list(k) == [] and r.all().count() == 0
    with pytest.raises(tables.KeyNotFound):
        r.get_entry(k, "todo")


def test_settings_and_finding_by_name(spark):
    s = stores.SettingsStore(documents(spark), ("t",))
    assert s.name() is None and s.height_strategy() == "incremental"
    s.set_name("mine")
    s.set_height_strategy("timestamp")
    s.set_auth_key("k1", "Admin", 0, "me")
    s.revoke("k1")
    assert s.name() == "mine" and s.height_strategy() == "timestamp" and s.auth_keys()["k1"] == {"permission": "Admin", "priority": 0, "name": "me", "status": "Revoked"}
    with pytest.raises(tables.KeyNotFound):
        s.revoke("k2")
    with pytest.raises(ValueError):
        s.set_height_strategy("other")
    folded = stores.settings(s.documents)
    assert [tuple(r) for r in folded.collect()] == [("t", "mine", "timestamp", "set", 1)]
    tracked = spark.createDataFrame([("t",), ("u",)], "tree_id string")
    assert stores.find_database(tracked, folded, "mine").count() == 1
    with pytest.raises(stores.DatabaseNotFound):
        stores.find_database(tracked, folded, "yours")


def test_transactions_are_all_or_nothing(spark):
    none = {n: spark.createDataFrame([], s) for n, s in (("entries", "tree_id string, entry_id string, height long"), ("edges", "tree_id string, child_id string, parent_id string"), ("patches", "tree_id string, store string, entry_id string, height long"), ("store_edges", "tree_id string, store string, child_id string, parent_id string"))}
    new = spark.createDataFrame([("t", "a", ["x", "x", "y"], True), ("t", "a", ["x"], True), ("u", "b", ["x"], False), ("v", "c", None, None)], "tree_id string, entry_id string, stores array<string>, signed boolean")
    rules = spark.createDataFrame([("u", "set"), ("w", "corrupted")], "tree_id string, auth string")
    b = transactions.transact(**none, new=new.where("stores is null or size(stores) <> 1 or tree_id = 'u'"), auth=rules)
    assert {(r["entry_id"], r["height"], r["is_root"]) for r in b.entries.collect()} == {("a", 0, True), ("c", 0, True)}
    assert {(r["store"], r["entry_id"], r["height"]) for r in b.patches.collect()} == {("x", "a", 0), ("y", "a", 0)}
    assert [tuple(r) for r in b.errors.collect()] == [("b", "AuthenticationRequired")] and b.edges.count() == 0 == b.store_edges.count()
    again = transactions.transact(none["entries"].unionByName(b.entries.select("tree_id", "entry_id", "height")), none["edges"], none["patches"], none["store_edges"], new.where("entry_id = 'a'"))
    assert again.entries.count() == 0 == again.errors.count()
    kept = []
    assert transactions.with_transaction(list, lambda t: t.append(1), lambda t: kept.append(t) or "done") == "done" and kept == [[1]]
    with pytest.raises(ZeroDivisionError):
        transactions.with_transaction(list, lambda t: 1 / 0, kept.append)
    assert kept == [[1]]


def test_claims_that_do_not_hold(spark):
    entries = spark.createDataFrame([("t", x) for x in "abcd"] + [("u", "z")], "tree_id string, entry_id string")
    edges = spark.createDataFrame([("t", "b", "a"), ("t", "c", "b"), ("t", "d", "a")], "tree_id string, child_id string, parent_id string")
    floors = spark.createDataFrame([("t", "b")], "tree_id string, entry_id string")
    cases = {"ok": ["c"], "below_floor": ["d"], "not_found": ["c", "absent"], "not_in_tree": ["c", "z"], "no_tips": [], "too_many_tips": [f"n{i}" for i in range(65)], "null": None, "two": ["d", "b", "b"]}
    asked = spark.createDataFrame([(k, "t", v) for k, v in cases.items()] + [("free", "u", ["z"])], "id string, tree_id string, tips array<string>")
    got = {r["id"]: r["state"] for r in auth.claims(asked, floors, entries, edges).collect()}
    assert got == {**{k: k for k in cases}, "null": "no_tips", "two": "ok", "free": "ok"}
