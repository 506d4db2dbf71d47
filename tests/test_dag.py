import itertools
import random

from pyspark.sql import functions as F

from arborfold.operators import dag, verify


def test_bypass_is_no_merge_base():
    links = [("A", "R"), ("X", "R"), ("B", "A"), ("C", "A"), ("C", "X"), ("D", "B")]
    assert dag.lowest_dominator(iter(links), ["C", "D"]) == "R"
    assert dag.lowest_dominator(iter(links), ["B", "D"]) == "B"
    assert dag.lowest_dominator(iter(links), ["D"]) == "D"
    assert dag.lowest_dominator(iter([("A", "R"), ("B", "S")]), ["A", "B"]) is None


def test_dominators_equal_removing_each_node():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randint(2, 12)
        links = [(i, p) for i in range(1, n) for p in {rng.randrange(i) for _ in range(rng.choice([1, 1, 2]))}]
        up = {}
        for c, p in links:
            up.setdefault(c, []).append(p)

        def ways(node):
            return [[node, *w] for p in up[node] for w in ways(p)] if node in up else [[node]]

        wanted = rng.sample(range(n), min(n, rng.randint(1, 3)))
        every = [set(w) for x in wanted for w in ways(x)]
        depth = lambda x: max(len(w) for w in ways(x))
        common = set.intersection(*every)
        want = max(common, key=depth) if common else None
        assert dag.lowest_dominator(iter(links), wanted) == want


def history(spark, edges, more=()):
    ids = sorted({x for e in edges for x in e} | set(more))
    entries = spark.createDataFrame([("t", i, h) for h, i in enumerate(ids)], "tree_id string, entry_id string, height int")
    return entries, spark.createDataFrame([("t", c, p) for c, p in edges], "tree_id string, child_id string, parent_id string")


def ids(df):
    return sorted(r["entry_id"] for r in df.collect())


def test_tips_do_not_depend_on_arrival(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "c")]
    for order in itertools.islice(itertools.permutations(edges), 0, 720, 240):
        entries, links = history(spark, order)
        assert ids(dag.tree_tips(entries, links)) == ["e", "f"]


def test_closures_stops_and_reachability(spark):
    entries, links = history(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("z", "gone")], ["z"])
    entries = entries.where("entry_id <> 'gone'")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "entry_id string")
    assert ids(dag.ancestors(links, one("d"))) == ["a", "b", "c", "d"]
    assert ids(dag.ancestors(links, one("e"), one("b"))) == ["a", "c", "d", "e"]
    assert ids(dag.ancestors(links, one())) == []
    assert ids(dag.descendants(links, one("c"))) == ["c", "d", "e"]
    assert ids(dag.ids_added(entries, links, one("b"), one("d"))) == ["c", "d"] and ids(dag.ids_added(entries, links, one("d"), one("b"), strict=True)) == []
    assert ids(dag.missing_ancestors(entries, links, one("z", "absent"))) == ["absent", "gone"]
    tree = entries.first()["tree_id"]
    own = lambda *x: spark.createDataFrame([(tree, i) for i in x], "tree_id string, entry_id string")
    state = {r["entry_id"]: r["state"] for r in dag.reachability(entries, links, own("z"), own("a", "z")).collect()}
    assert state == {"a": "indeterminate", "z": "reachable"}
    assert ids(dag.lost_ids(entries, links, own("z"), own("a", "z"))) == ["gone"]
    assert [r["state"] for r in dag.reachability(entries, links, own(), own("a")).collect()] == ["unreachable"]
    foreign = own("a").withColumn("tree_id", F.lit("another"))
    assert [r["state"] for r in dag.reachability(entries, links, own("d"), foreign.unionAll(own("b"))).orderBy("entry_id").collect()] == ["not_in_tree", "reachable"]


def test_closures_in_blocks_of_any_size(spark):
    chain = [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 120)] + [("n050", "n020"), ("n003", "n003")]
    edges = spark.createDataFrame([("t", c, p) for c, p in chain], "tree_id string, child_id string, parent_id string")
    start = spark.createDataFrame([("n100",), ("absent",), (None,)], "entry_id string")
    for rows in (20, 1000):
        up, down = dag.Blocks(edges, True, rows), dag.Blocks(edges, False, rows)
        assert ids(up.reach(start)) == ["absent", *[f"n{i:03d}" for i in range(101)]]
        assert ids(down.reach(start)) == ["absent", *[f"n{i:03d}" for i in range(100, 120)]]


def plain_verify(status, valid, up, order):
    out = dict(status)
    for n in order:
        if status[n] != 2:
            continue
        parents = [out.get(p) for p in up.get(n, ())]
        out[n] = 1 if 1 in parents else 2 if any(p != 0 for p in parents) or valid[n] is None else 0 if valid[n] else 1
    return out


def test_verification_equals_one_pass(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        n = 60
        names = [f"n{i:02d}" for i in range(n)]
        up = {names[i]: {names[rng.randrange(i)] for _ in range(rng.choice([1, 2]))} for i in range(1, n)}
        up[names[9]].add("missing")
        status = {x: rng.choice([0, 0, 1, 2, 2, 2, 2, 2]) for x in names}
        valid = {x: rng.choice([True] * 8 + [False, None]) for x in names}
        entries = spark.createDataFrame([("t", x, status[x], valid[x]) for x in names], "tree_id string, entry_id string, status int, valid boolean")
        links = spark.createDataFrame([("t", c, p) for c, ps in up.items() for p in ps], "tree_id string, child_id string, parent_id string")
        got = {r["entry_id"]: r["new_status"] for r in verify.verify(entries, links).collect()}
        assert got == plain_verify(status, valid, up, names)
