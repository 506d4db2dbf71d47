import json
import random

from arborfold.operators import fold, tables

LEAF, GONE = "leaf", "deleted"


def merge_doc(a, b):
    """Documents as {'atomic', 'children'}; values as ('doc', d), ('list', {pos: value}), (leaf, x) or (deleted, None)."""
    if b["atomic"]:
        return b
    out = {"atomic": a["atomic"], "children": dict(a["children"])}
    for k, v in b["children"].items():
        out["children"][k] = merge_value(out["children"][k], v) if k in out["children"] else v
    return out


def merge_value(a, b):
    if a[0] == GONE or b[0] == GONE:
        return b
    if a[0] == b[0] == "doc":
        return "doc", merge_doc(a[1], b[1])
    if a[0] == b[0] == "list":
        return "list", {**a[1], **{k: merge_value(a[1][k], v) if k in a[1] else v for k, v in b[1].items()}}
    return b


def random_value(rng, depth):
    kind = rng.choice(["leaf", "leaf", "deleted", "doc", "doc", "list"]) if depth else rng.choice([LEAF, GONE])
    if kind == "doc":
        return "doc", random_doc(rng, depth - 1, rng.random() < 0.2)
    if kind == "list":
        return "list", {f"p{rng.randrange(2)}": random_value(rng, depth - 1) for _ in range(rng.randrange(3))}
    return kind, str(rng.randrange(100)) if kind == LEAF else None


def random_doc(rng, depth, atomic=False):
    return {"atomic": atomic, "children": {f"k{rng.randrange(3)}": random_value(rng, depth) for _ in range(rng.randrange(1, 4))}}


def events(value, path=(), cont=()):
    kind, x = value
    if kind == "doc":
        if path:
            yield path, cont, "adoc" if x["atomic"] else "doc", None
        for k, v in x["children"].items():
            yield from events(v, (*path, k), (*cont, "d"))
    elif kind == "list":
        yield path, cont, "list", None
        for k, v in x.items():
            yield from events(v, (*path, k), (*cont, "l"))
    else:
        yield path, cont, kind, x


def shown(value, path=()):
    kind, x = value
    if path:
        yield path, kind, x if kind == LEAF else None, kind == "doc" and x["atomic"]
    for k, v in (x["children"] if kind == "doc" else x if kind == "list" else {}).items():
        yield from shown(v, (*path, k))


def test_nested_fold_equals_merging_one_by_one(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for case in range(150):
        docs = [random_doc(rng, 3) for _ in range(rng.randint(1, 6))]
        state = {"atomic": False, "children": {}}
        for h, d in enumerate(docs):
            state = merge_doc(state, d)
            rows += [(case, list(p), list(c), kind, value, h, f"e{h}") for p, c, kind, value in events(("doc", d))]
        want |= {(case, *x) for x in shown(("doc", state))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "case int, path array<string>, cont array<string>, kind string, value string, height int, entry_id string")

    def got(state):
        return {(r["case"], tuple(r["path"]), r["kind"], r["value"], r["atomic"]) for r in state.collect()}

    assert got(fold.nested(df, ["case"])) == want
    early = fold.live_events(df.where("height % 2 = 1"), ["case"])
    assert got(fold.decide(fold.live_events(early.unionByName(df.where("height % 2 = 0")), ["case"]), ["case"])) == want
    below = {x for x in want if x[1][:1] == ("k1",)}
    assert got(fold.nested(df, ["case"], ["k1"]).where("path[0] = 'k1'")) == below
    texts = [json.loads(r["json"]) for r in fold.to_json(fold.nested(df, ["case"]), ["case"], 8).collect()]
    assert len(texts) == 150 and all(isinstance(t, dict) for t in texts)


def test_last_writer_ties_nulls_and_repeats(spark):
    rows = [("a", "1", "leaf", 1, "x"), ("a", "2", "leaf", 1, "y"), ("a", "2", "leaf", 1, "y"), ("b", "1", "leaf", 5, "x"), ("b", None, "deleted", 6, "a"), (None, "n", "leaf", 0, "q")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "key string, row string, kind string, height int, entry_id string, _v int")
    state = fold.last_writer(df, ["key"], ["row", "kind"])
    assert {(r["key"], r["row"]) for r in fold.live(state).collect()} == {("a", "2"), (None, "n")}
    assert fold.last_writer(df.where("false"), ["key"], ["row", "kind"]).count() == 0


def people(spark):
    rows = [("1", '{"name": "Alice Johnson", "age": 25, "email": "alice@example.com"}'), ("2", '{"name": "Bob Smith", "age": 30, "email": "bob@company.com"}'), ("3", '{"name": "Charlie Brown", "age": 25, "email": "charlie@example.com"}'), ("4", '{"name": "Diana Prince", "age": 35, "email": "diana@hero.org"}')]
    df = spark.createDataFrame([(k, r, "leaf", i, f"e{i}") for i, (k, r) in enumerate(rows)], "key string, row string, kind string, height int, entry_id string")
    return tables.Table(df, "name string, age int, email string")


def test_table_search_and_staged_changes(spark):
    t = people(spark)
    assert t.search("age = 25").count() == 2
    assert t.search("email like '%example.com%'").count() == 2
    assert t.search("name like 'B%'").count() == 1
    assert t.search("age > 100").count() == 0
    assert t.get("2")["name"] == "Bob Smith"
    t.set("2", '{"name": "Bob", "age": 31}')
    assert t.get("2") == {"name": "Bob", "age": 31, "email": None}
    assert t.search("age = 30").count() == 0  # no older version shows up again
    assert t.delete("3") and not t.delete("3") and not t.delete("absent")
    assert t.search("age = 25").count() == 1
    key = t.insert('{"name": "Eve", "age": 1}')
    assert t.get(key)["age"] == 1 and t.rows().count() == 4
    try:
        t.get("3")
        raise AssertionError
    except tables.KeyNotFound:
        pass


def test_custom_merge_sees_canonical_order(spark):
    rows = [(k, h, f"e{h:02d}", str(h)) for k in ("x", "y") for h in range(30)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, height int, entry_id string, v string").repartition(7)
    got = {r["k"]: r["state"] for r in fold.custom(df, ["k"], lambda s, r: (s or "") + r["v"] + ",").collect()}
    assert got == {k: "".join(f"{h}," for h in range(30)) for k in ("x", "y")}


def test_documents_with_staged_changes(spark):
    rows = [(1, ["a"], ["d"], "doc", None, 0, "e0"), (1, ["a", "b"], ["d", "d"], "leaf", "old", 0, "e0"), (1, ["c"], ["d"], "leaf", "x", 1, "e1"), (2, ["a"], ["d"], "leaf", "y", 0, "e0")]
    df = spark.createDataFrame(rows, "id int, path array<string>, cont array<string>, kind string, value string, height int, entry_id string")
    d = tables.Documents(df, ["id"])
    assert d.get((1,), "a.b") == "old" and d.get((2,), "a") == "y"
    d.set((1,), "a.b", "new")
    d.set((1,), "c.deep", "z")  # a leaf on the way becomes a document
    assert d.get((1,), "a.b") == "new" and d.get((1,), "c.deep") == "z"
    assert d.delete((1,), "a") and not d.delete((1,), "a") and not d.delete((2,), "none")
    for path, error in (("a.b", tables.KeyNotFound), ("c", tables.TypeMismatch)):
        try:
            d.get((1,), path)
            raise AssertionError(path)
        except error:
            pass
    assert d.modify_or_insert((2,), "n", "0", lambda v: v + "1") == "01" and d.get((2,), "n") == "01"
    assert {r["id"]: r["json"] for r in d.json(3).collect()} == {1: '{"c":{"deep":"z"}}', 2: '{"a":"y","n":"01"}'}


def test_typed_values_lists_and_editors(spark):
    none = spark.createDataFrame([], "id int, path array<string>, cont array<string>, kind string, value string, height int, entry_id string")
    d, k = tables.Documents(none, ["id"]), (1,)
    assert d.set(k, "n", 5) is None and d.insert(k, "n", 6) == 5 and d.get(k, "n") == 6 and d.get(k, "n", "int") == 6
    for path, value in (("b", True), ("none", None), ("t", 'say "hi"\n'), ('odd"key', "x")):
        d.set(k, path, value)
        assert d.get(k, path) == value
    for path, kind, error in (("n", "text", tables.TypeMismatch), ("absent", None, tables.KeyNotFound), ("n.deep", None, tables.KeyNotFound)):
        try:
            d.get(k, path, kind)
            raise AssertionError(path)
        except error:
            pass
    assert d.get_option(k, "n", "text") is None and d.get_option(k, "n", "int") == 6 and d.get_option(k, "absent") is None
    d.set(k, "doc", {"a": 1, "deep": {"x": False}, "l": [1, "two", None]})
    assert d.get_node(k, "doc") == {"a": 1, "deep": {"x": False}, "l": [1, "two", None]} and d.names(k, "doc") == ["a", "deep", "l"]
    assert d.get(k, "doc.l.1") == "two" and d.get_option(k, "doc.l.3") is None
    d.set(k, "doc", {"only": 1})  # replaces the document
    assert d.get_node(k, "doc") == {"only": 1}
    assert d.get_or_insert(k, "n", 9) == 6 and d.get_or_insert(k, "new", 9) == 9 and d.get(k, "new") == 9
    assert d.modify(k, "n", lambda v: v + 1) == 7 and d.modify_or_insert(k, "count", 0, lambda v: v + 1) == 1
    d.set_json(k, "j", {"b": [1, 2]})
    assert d.get_json(k, "j") == {"b": [1, 2]}
    e = d.editor(k, "doc")
    e.child("more.inner").set("v")
    assert e.get() == {"only": 1, "more": {"inner": "v"}} and e.delete_child("only") and e.get() == {"more": {"inner": "v"}}
    assert d.is_tombstone(k, "doc.only") and not d.is_tombstone(k, "doc.more") and e.child("more").delete_self() and e.get() == {}
    d.set(k, "list", [10, 20, 30])
    assert {(r["kind"], r["value"]) for r in d.lookup("list.2").collect()} == {("int", "30")} and d.lookup("list.7").count() == 0
    text = d.json(4).first()["json"]
    assert json.loads(text)["t"] == 'say "hi"\n' and json.loads(text)["n"] == 7 and json.loads(text)["none"] is None and json.loads(text)['odd"key'] == "x" and json.loads(text)["list"] == [10, 20, 30]


def test_list_edits(spark):
    rows = [("a", 1, 1, "u1", "x", False), ("a", 2, 1, "u2", "y", False), ("a", 3, 1, "u3", "gone", True), ("a", 5, 2, "u4", "z", False), ("b", 1, 1, "u5", "gone", True)]
    df = spark.createDataFrame(rows, "k string, num int, den int, uid string, value string, deleted boolean")

    def after(*edits):
        items = df
        for i, (what, index, value) in enumerate(edits):
            items = tables.list_edit(items, ["k"], what, index, value, f"n{i}")
        out = {}
        for r in sorted(tables.list_items(items, ["k"]).collect(), key=lambda r: r["index"]):
            out.setdefault(r["k"], []).append(r["value"])
        return out

    assert after() == {"a": ["x", "y", "z"]}
    assert after(("push", 0, "p")) == {"a": ["x", "y", "z", "p"], "b": ["p"]}
    assert after(("insert", 0, "p"), ("insert", 2, "q"), ("insert", 99, "r")) == {"a": ["p", "x", "q", "y", "z", "r"], "b": ["p", "q", "r"]}
    assert after(("set", 1, "s"), ("remove", 0, None), ("remove", 9, None)) == {"a": ["s", "z"]}
