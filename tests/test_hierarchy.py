import random

import pytest

from arborfold.operators import hierarchy


def brute(links, roots):
    """Values and cycle members by plain walks over all ways up."""
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    above = {}
    for n in up:
        seen, todo = set(), list(up[n])
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += up.get(a, ())
        above[n] = seen
    looped = {n for n in up if n in above[n]}
    cyclic = {n for n in up if n in looped or above[n] & looped}
    best = {}

    def value(n):
        if n not in best:
            if n not in up:
                best[n] = (0, n not in roots, n, set())
            else:
                ways = [value(p) for p in up[n]]
                depth = max(w[0] for w in ways) + 1
                path = min(w[2] for w in ways if w[0] + 1 == depth) + "/" + n
                best[n] = (depth, any(w[1] for w in ways), path, above[n])
        return best[n]

    nodes = set(up) | roots
    return {n: (None, None, True, None, None) if n in cyclic else (*value(n)[:2], False, *value(n)[2:]) for n in nodes}, looped


def random_links(seed):
    rng = random.Random(seed)
    n = rng.randint(30, 120)
    ids = [f"n{i:03d}" for i in range(n)]
    links = []
    for i in range(1, n):
        if rng.random() < 0.05:
            continue
        chain = rng.random() < 0.4
        for _ in range(rng.choice([1, 1, 1, 1, 2, 3])):
            links.append((ids[i], ids[i - 1] if chain else ids[rng.randrange(i)]))
    if seed % 2:  # cycles, some with tails and bridges between them
        for _ in range(rng.randint(1, 4)):
            a, b = sorted(rng.sample(range(n), 2))
            links.append((ids[a], ids[b]))
        links.append((ids[5], ids[5]))
    links += rng.sample(links, 5) + [(ids[3], "absent"), (ids[4], ""), (None, ids[1]), (ids[2], None)]
    roots = {i for i in ids if rng.random() < 0.8}
    rng.shuffle(links)
    return links, roots


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("payload", [None, "path", "ancestors"])
@pytest.mark.parametrize(("core", "stuck"), [(0, 0), (8, 1000)])
def test_values_equal_plain_walks(spark, seed, payload, core, stuck):
    links, roots = random_links(seed)
    df = spark.createDataFrame([(*x, 1, "clash") for x in links], "c string, p string, w long, mark_n string")
    top = spark.createDataFrame([(r, 0) for r in roots] + [(next(iter(roots)), 0)], "n string, depth long")
    forest = hierarchy.Hierarchy(df, top, payload, core, stuck)
    found = forest.values
    got = {r["n"]: r for r in found.collect()}
    want, looped = brute(links, roots)
    assert found.count() == len(got) and got.keys() == want.keys()
    for n, (depth, bad, cyclic, path, above) in want.items():
        assert (got[n]["depth"], got[n]["bad"], got[n]["cyclic"]) == (depth, bad, cyclic), n
        if payload == "path":
            assert got[n]["path"] == path
        if payload == "ancestors" and not cyclic:
            assert len(got[n]["ancestors"]) == len(above) and set(got[n]["ancestors"]) == above
    if payload is None:
        rows = [r["n"] for r in forest.on_cycles().collect()]
        assert len(rows) == len(set(rows)) and set(rows) == looped


def test_empty_links(spark):
    empty = spark.createDataFrame([], "c string, p string")
    top = spark.createDataFrame([("r",)], "n string")
    assert [tuple(r) for r in hierarchy.values(empty, top).collect()] == [("r", 0, False, False)]
    assert hierarchy.values(empty, top.where("false")).count() == 0
    assert hierarchy.Hierarchy(empty, top).on_cycles().count() == 0


def test_long_chain_and_star(spark):
    chain = [(f"c{i:05d}", f"c{i - 1:05d}") for i in range(1, 3000)] + [(f"s{i:05d}", "c00000") for i in range(2000)]
    forest = hierarchy.Hierarchy(spark.createDataFrame(chain, "c string, p string"), spark.createDataFrame([("c00000",)], "n string"), core_links=500)
    assert len(forest._done.records) > 3
    got = {r["n"]: r["depth"] for r in forest.values.collect()}
    assert got["c02999"] == 2999 and got["s01999"] == 1 and got["c00000"] == 0 and len(got) == 5000


def test_key_collisions_are_seen(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "i string")
    assert not hierarchy.keys_collide(ids, ids)


def test_floors_by_contraction(spark):
    rng = random.Random(3)
    n = 150
    ids, own = [f"n{i:03d}" for i in range(n)], [rng.randrange(60) for _ in range(n)]
    links = [(i, p) for i in range(1, n) if rng.random() > 0.05 for p in {i - 1 if rng.random() < 0.6 else rng.randrange(i) for _ in range(rng.choice([1, 1, 2]))}]
    want = {}
    for i in range(n):
        want[i] = max([own[i], *(want[p] + 1 for c, p in links if c == i)])
    df = spark.createDataFrame([(ids[c], ids[p], own[c]) for c, p in links] + [("late", "absent", 7)], "c string, p string, m long")
    roots = spark.createDataFrame(list(zip(ids, own)), "n string, m long")
    got = {r["n"]: r["floor"] for r in hierarchy.values(df, roots, "floor", core_links=5).collect()}
    assert got == {**{ids[i]: want[i] for i in range(n)}, "late": 7}


def test_one_large_cycle(spark):
    """A cycle of 1,500 links with a tail above and one below shrinks to a node that is its own parent."""
    n = 1_500
    rows = spark.range(n).selectExpr("id as c", f"(id + 1) % {n} as p").unionAll(spark.sql("values (0L, 900000L), (900001L, 5L), (900002L, 900001L)"))
    forest = hierarchy.Hierarchy(rows, spark.sql("select 900000L as n"), core_links=100, stuck_links=0)
    assert forest._done.live.count() <= 100
    assert sorted(r["n"] for r in forest.on_cycles().collect()) == list(range(n))
    assert forest.values.where("cyclic").count() == n + 2


def test_below_seeds(spark):
    for seed in (1, 2):
        links, _ = random_links(seed)
        seeds = {"n010", "n020", "absent"}
        up = {}
        for c, p in links:
            if c and p:
                up.setdefault(c, set()).add(p)
        want, grown = set(), True
        while grown:
            new = {c for c, ps in up.items() if c not in seeds and ps & (seeds | want)}
            grown, want = new != want, new
        df = spark.createDataFrame(links, "c string, p string")
        for core, stuck in ((5, 0),):
            got = [r["n"] for r in hierarchy.below(df, spark.createDataFrame([(s,) for s in [*seeds, "n010"]], "n string"), core, stuck).collect()]
            assert len(got) == len(set(got)) and set(got) == want
