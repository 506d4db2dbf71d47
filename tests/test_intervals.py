import random

import numpy as np
from pyspark.sql import functions as F

from arborfold.operators import intervals


def plain(rows):
    """Continuous periods of (entity, start, end) rows by one sweep."""
    out = set()
    for e in {r[0] for r in rows if r[0] is not None}:
        own = sorted((s, t) for x, s, t in rows if x == e and s is not None and t is not None and t > s)
        current = None
        for s, t in own:
            if current and s <= current[1]:
                current = (current[0], max(current[1], t))
            else:
                if current:
                    out.add((e, *current))
                current = (s, t)
        if current:
            out.add((e, *current))
    return out


def plain_gaps(periods):
    ordered = sorted(periods)
    return {(a[0], a[2], b[1]) for a, b in zip(ordered, ordered[1:]) if a[0] == b[0]}


def test_merging_chunks_in_a_tree():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 50))
        e, s = rng.integers(0, 4, n), rng.integers(0, 70, n)
        t = s + rng.integers(1, 9, n)
        tree = intervals.Reduction()
        for i in range(0, n, 6):
            tree.add(intervals.from_rows(e[i : i + 6], s[i : i + 6], t[i : i + 6]))
        got = set(zip(*(x.tolist() for x in tree.result())))
        assert got == plain(list(zip(e.tolist(), s.tolist(), t.tolist())))


def test_merging_with_little_room_for_keys():
    """Values so far apart that only a few entities share one number range, or one alone."""
    rng = np.random.default_rng(3)
    for scale in (1 << 40, 1 << 54, 1 << 58):
        n = 200
        e, s = rng.integers(0, 40, n), rng.integers(-7, 7, n) * scale
        t = s + rng.integers(1, 3, n) * (scale // 2 + 1)
        tree = intervals.Reduction()
        for i in range(0, n, 11):
            tree.add(intervals.from_rows(e[i : i + 11], s[i : i + 11], t[i : i + 11]))
        assert set(zip(*(x.tolist() for x in tree.result()))) == plain(list(zip(e.tolist(), s.tolist(), t.tolist())))


def test_periods_and_gaps(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randrange(6)}", (s := rng.randrange(4000)), s + rng.choice([-3, 0, 1, 2, 5, 40])) for _ in range(1500)]
    rows += [("long", 0, 9000), ("long", 10, 20), ("long", 8999, 9001), ("touch", 1, 2), ("touch", 2, 3), (None, 1, 2), ("x", None, 5), ("x", 5, None)] + rows[:30]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "e string, s long, t long, _start int, _part int")
    got = {tuple(r) for r in intervals.periods(df, "e", F.col("s"), F.col("t")).collect()}
    assert got == plain(rows)
    found = [tuple(r) for r in intervals.gaps(df, "e", F.col("s"), F.col("t")).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_gaps(got)


def test_lists_given_out_early_change_nothing(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(3)}", (s := rng.randrange(900)), s + rng.randrange(1, 30)) for _ in range(800)]
    df = spark.createDataFrame(rows, "e string, s long, t long").repartition(5)
    pieces = intervals.disjoint(df, "e", F.col("s"), F.col("t"), keep_at_most=10)
    reached = intervals._carried(pieces).where("_start > _reach")
    assert {(r["_entity"], r["_reach"], r["_start"]) for r in reached.collect()} == plain_gaps(plain(rows))


def test_nothing_comes_of_nothing(spark):
    empty = spark.createDataFrame([], "e string, s long, t long")
    assert intervals.gaps(empty, "e", F.col("s"), F.col("t")).count() == 0
    assert intervals.periods(empty, "e", F.col("s"), F.col("t")).count() == 0
