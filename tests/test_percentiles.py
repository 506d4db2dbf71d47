import math
import random

from pyspark.sql import functions as F

from arborfold.operators import percentiles

PS = (0.01, 0.5, 0.9, 1.0)


def data():
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.05 else f"g{rng.randrange(5)}", rng.choice([None, 0.0, -5.0, 7.0, 1e12, rng.lognormvariate(5, 3), -rng.lognormvariate(5, 3)]), i % 3) for i in range(2000)]
    return rows + [("nulls", None, 0), ("one", 4.0, 1)]


def exact(rows, p):
    by = {}
    for g, v, _ in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    return {g: sorted(v)[max(1, math.ceil(round(p * len(v), 6))) - 1] for g, v in by.items()}


def test_exact_counts_give_exact_percentiles(spark):
    df = spark.createDataFrame([(*r, 1.5, 9) for r in data()], "g string, v double, day int, value double, n int")
    got = percentiles.percentiles(percentiles.value_counts(df.drop("value", "n"), ["g"], {"v": F.col("v")}), ["g"], PS).collect()
    for p, name in zip(PS, ("p1", "p50", "p90", "p100")):
        assert {r["g"]: r[name] for r in got} == exact(data(), p)


def test_summaries_of_days_merge_with_bounded_error(spark):
    df = spark.createDataFrame(data(), "g string, v double, day int")
    parts = [percentiles.value_counts(df.where(F.col("day") == d), ["g"], {"v": F.col("v")}, 9) for d in range(3)]
    got = percentiles.percentiles(percentiles.merge_counts(parts, ["g"]), ["g"], PS).collect()
    for p, name in zip(PS, ("p1", "p50", "p90", "p100")):
        want = exact(data(), p)
        assert {r["g"] for r in got} == want.keys()
        for r in got:
            assert abs(r[name] - want[r["g"]]) <= abs(want[r["g"]]) / 2**9


def test_no_values_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert percentiles.percentiles(percentiles.value_counts(empty, ["g"], {"v": F.col("v")}), ["g"], PS).count() == 0


def test_every_double_has_a_bucket(spark):
    """No value fails; the error is bounded at every magnitude; whole numbers below 512 are exact."""
    rng = random.Random(4)
    special = [0.0, -0.0, 0.3, -0.3, 1e300, -1e300, 1e19, -9.3e18, 2.0**63, 5e-324, 2.2e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 1e-9, 511.0, 512.0, 513.0]
    special += [2.0**e * (1 + d) for e in range(-1060, 1020, 37) for d in (0.0, 2.0**-52, 0.75)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1000, 41)]
    values = special + [rng.choice([-1, 1]) * rng.lognormvariate(0, 40) for _ in range(2000)] + [float(i) for i in range(-511, 512)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", percentiles.bucket(F.col("v"), 9).alias("b")).collect():
        assert math.isfinite(r["b"]) and abs(r["b"] - r["v"]) <= abs(r["v"]) / 2**9, r
        if abs(r["v"]) < 512 and r["v"] == int(r["v"]):
            assert r["b"] == r["v"]


def test_nan_and_infinities_are_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", v) for v in (nan, 1.0, -inf, inf, None, nan)] + [("b", nan), ("c", 2.0)], "g string, v double")
    for bits in (None, 9):
        got = {r["g"]: (r["n_values"], repr(r["p1"]), repr(r["p50"]), repr(r["p100"])) for r in percentiles.percentiles(percentiles.value_counts(df, ["g"], {"v": F.col("v")}, bits), ["g"], PS).collect()}
        assert got == {"a": (5, "-inf", "inf", "nan"), "b": (1, "nan", "nan", "nan"), "c": (1, "2.0", "2.0", "2.0")}
