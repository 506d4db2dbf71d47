import functools
import random
from collections import Counter

from pyspark.sql import functions as F

from arborfold.operators import skew


def rows_with_a_hot_key(n=3000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else None if rng.random() < 0.05 else f"k{rng.randrange(40)}"
        rows.append((key, f"s{rng.randrange(500)}" if rng.random() > 0.02 else None, rng.randrange(100) if rng.random() > 0.1 else None, i))
    return rows + rows[:50]


def test_per_key_equals_counting(spark):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "k string, s string, v int, i int, _part string, n_rows int")
    v = F.col("v")
    measures = {"top": (v, skew.MAX), "low": (v, skew.MIN), "sum": (v, skew.SUM), "n": (v, skew.COUNT), "bits": (v, (F.bit_or, F.bit_or))}
    got = {r["k"]: (r["n_rows"], r["n_distinct"], r["top"], r["low"], r["sum"], r["n"], r["bits"]) for r in skew.per_key(df, "k", "s", measures).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        known = [r[2] for r in own if r[2] is not None]
        want[k] = (len(own), len({r[1] for r in own} - {None}), max(known), min(known), sum(known), len(known), functools.reduce(int.__or__, known))
    assert got == want


def test_a_hot_key_is_split_into_several_states(spark):
    df = spark.createDataFrame(rows_with_a_hot_key(), "k string, s string, v int, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        states = skew.per_key_states(df, "k", "s", {}).where("_key = 'hot'").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert states > 1


def test_per_key_on_an_empty_table(spark):
    assert skew.per_key(spark.createDataFrame([], "k string, s string"), "k", "s").count() == 0


def test_positions_number_every_group(spark):
    rows = rows_with_a_hot_key()
    df = spark.createDataFrame(rows, "k string, s string, v int, i int")
    got = skew.positions(df, ["k"], ["i", "v"]).collect()
    seen = Counter(r["k"] for r in rows_as_dicts(rows))
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["position"], r["i"]))
    assert len(got) == len(rows)
    for k, places in by_key.items():
        places.sort()
        assert [p for p, _ in places] == list(range(1, seen[k] + 1))
        assert [i for _, i in places] == sorted(i for _, i in places)
    assert skew.positions(df.where("false"), [], ["i"]).count() == 0
    assert [r["position"] for r in skew.positions(df.limit(5), [], ["i"]).orderBy("position").collect()] == [1, 2, 3, 4, 5]


def rows_as_dicts(rows):
    return [dict(zip(("k", "s", "v", "i"), r)) for r in rows]
