import random

from arborfold.operators import references


def test_cascade_crosses_blocks_and_cycles(spark):
    rng = random.Random(5)
    ids = [f"r{i:03d}" for i in range(200)]
    links = [(ids[i], ids[rng.randrange(max(0, i - 6), i)]) for i in range(1, 200) for _ in range(rng.choice([1, 1, 2]))]
    links += [(ids[7], ids[90]), (ids[3], ids[3]), (ids[9], None), (None, ids[5])]
    seeds = {ids[40], ids[120], "absent"}
    want, grown = set(), True
    while grown:
        new = {c for c, p in links if c and p and c != p and (p in seeds or p in want)}
        grown, want = new != want, new
    rows = [(c, p) for c, p in links]
    for share in (0, 3):  # every third link is a wide one
        deep = [r for i, r in enumerate(rows) if not share or i % share]
        wide = [r for i, r in enumerate(rows) if share and i % share == 0]
        d, w = (spark.createDataFrame(x, "c string, p string") for x in (deep, wide))
        for core, hot in (((20, 0),) if share else ((20, 50_000),)):
            got = [r["n"] for r in references.cascade(d, w, spark.createDataFrame([(s,) for s in seeds], "n string"), core, hot).collect()]
            assert len(got) == len(set(got)) and set(got) == want | seeds
    none = d.where("false")
    assert references.cascade(d, w, spark.createDataFrame([], "n string")).count() == 0
    assert references.cascade(none, none, spark.createDataFrame([("r000",)], "n string")).count() == 1


def test_rounds_do_not_grow_with_depth(spark):
    """A chain of 3,000 records below one seed: some dozen rounds of semi-joins, not 3,000."""
    chain = spark.range(1, 3000).selectExpr("id as c", "id - 1 as p")
    contracted = references.below(chain, spark.sql("select 0L as n"), core_links=200)
    assert contracted.count() == 2999


def test_hot_targets(spark):
    """One target has most references; its rows are joined by a broadcast of that target alone."""
    refs = spark.range(400).selectExpr("'t' as ref_table", "concat('r', id) as ref_id", "case when id % 4 = 0 then concat('x', id) else 'hot' end as target_id", "cast(id as int) as at")
    targets = spark.createDataFrame([("hot", 200, False)] + [(f"x{i}", 0, i % 8 == 0) for i in range(0, 400, 20)], "id string, first_at int, deleted boolean")
    for hot in (0, 50_000):
        got = references.orphans(refs, targets, refs["ref_id"].isNull(), hot_rows=hot).groupBy("reason").count().collect()
        assert {r["reason"]: r["count"] for r in got} == {"late": 150, "missing": 80, "deleted": 10}


def test_reasons_kinds_and_nulls(spark):
    targets = spark.createDataFrame([("a", 10, False), ("b", 10, True), ("c", 50, False), ("d", None, False)], "id string, first_at int, deleted boolean")
    rows = [("t", "x", "a", 20), ("t", "y", "b", 20), ("t", "z", "c", 20), ("t", "a", "", 20), ("t", "w", "a", None), ("t", "v", None, 1), ("t", "u", "y", 5), (None, None, "gone", None), ("t", "q", "d", 3)]
    refs = spark.createDataFrame([(*r, "clash", 1, True) for r in rows], "ref_table string, ref_id string, target_id string, at int, id string, first_at int, deleted boolean")
    for hot in (0, 10):
        got = {(r["ref_id"], r["target_id"], r["reason"], r["kind"]) for r in references.orphans(refs, targets, refs["ref_table"] == "t", core_links=0, hot_rows=hot).collect()}
        # a refers to an empty id, so what refers to a inherits that
        assert got == {("y", "b", "deleted", "direct"), ("z", "c", "late", "direct"), ("a", "", "missing", "direct"), ("u", "y", "missing", "direct"), (None, "gone", "missing", "direct"), ("x", "a", "inherited", "inherited"), ("w", "a", "inherited", "inherited")}
