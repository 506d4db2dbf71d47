"""Filling containers of fixed capacity: a grouping genetic algorithm on islands with migrating elites.

Texts are measured in tokens and spread over shards of bounded size. Each shard and capacity has several islands, each
with a population of packings. A crossover takes one packing, injects whole well-filled bins of another, breaks up the
bins that hold a copy of an injected item, and puts the displaced items back by best fit, one at a time or, with new bins,
by the two items that fit best together; a mutation breaks up the worst bins. After an epoch every island passes its
elites to the next one of its shard. The best packing of a shard counts. A shard that needs no more bins than its tokens
fill is not worked on any more.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from arborfold.plans.cut import Cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary splits texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items in a shard. A shard wastes less than one container; with some thousand containers a shard that is no loss.
SHARD_ITEMS = 20_000
ISLANDS, EPOCHS = 3, 3
POPULATION, OFFSPRING, ELITES = 6, 16, 2
#: An epoch of an island ends early when so many offspring in a row are no better than its best packing.
IDLE = 6
#: Items that a bin-by-bin search for the best two looks through; more are cut into runs of this length, by size in turn.
SEARCH_ITEMS = 2_000


@functools.lru_cache(2)
def _encoder(ranks: bytes):  # noqa: ANN202
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text under a public byte-level vocabulary (a file that the driver reads); null stays null."""
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoder(ranks.value).encode_ordinary  # its batch call took 1.33 s where this took 0.91 s
        return pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)


class Bins:
    """A packing in the making: free space of each bin, and the bins by free space for best fit."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.present = 0  # bit r is set if a bin with free space r is known

    def hold(self, bin_: int) -> None:
        r = self.free[bin_]
        self.by_free.setdefault(r, []).append(bin_)
        self.present |= 1 << r

    def open(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self.hold(len(self.free) - 1)

    def best_fit(self, item: int, size: int) -> None:
        at = self.present >> size
        if not at:
            self.open([item], self.capacity - size)
            return
        r = size + (at & -at).bit_length() - 1
        held = self.by_free[r]
        bin_ = held.pop()
        if not held:
            self.present &= ~(1 << r)
        self.items[bin_].append(item)
        self.free[bin_] = r - size
        self.hold(bin_)


def _value(bins: Bins) -> float:
    """How well filled the bins are: the mean of their squared fill, higher if few bins are full and none half empty."""
    fill = 1 - np.array(bins.free) / bins.capacity
    return float((fill * fill).mean()) if len(fill) else 1.0


def first_fit(sizes: list[int], capacity: int, rng: np.random.Generator | None) -> Bins:
    """Best fit in order of falling size; with rng sizes are blurred by up to an eighth for another order."""
    s = np.array(sizes, float)
    order = np.argsort(-(s * (1 + 0.125 * rng.random(len(s))) if rng is not None else s), kind="stable")
    out = Bins(capacity)
    for i in order.tolist():
        out.best_fit(i, sizes[i])
    return out


def fill_new(out: Bins, items: list[int], sizes: list[int]) -> None:
    """Puts items into new bins: the largest one that is left, then again and again the one or two that fill it best."""
    order = sorted(items, key=sizes.__getitem__)
    runs = max(1, -(-len(order) // SEARCH_ITEMS))
    for r in range(runs):
        ids = np.array(order[r::runs], np.int64)
        left = np.array([sizes[i] for i in ids], np.int64)  # rising
        while len(ids):
            chosen, free = [int(ids[-1])], out.capacity - int(left[-1])
            ids, left = ids[:-1], left[:-1]
            while len(ids) and left[0] <= free:
                one = int(np.searchsorted(left, free, "right")) - 1
                take, best = [one], int(left[one])
                n = one + 1
                if n > 1 and best < free:
                    other = np.minimum(np.searchsorted(left[:n], free - left[:n], "right") - 1, np.arange(n) - 1)
                    total = np.where(other >= 0, left[:n] + left[other], -1)
                    k = int(total.argmax())
                    if total[k] > best:
                        take, best = [k, int(other[k])], int(total[k])
                chosen += [int(ids[k]) for k in take]
                free -= best
                keep = np.ones(len(ids), bool)
                keep[take] = False
                ids, left = ids[keep], left[keep]
            out.open(chosen, free)


def put_back(out: Bins, displaced: list[int], sizes: list[int], rng: np.random.Generator) -> None:
    """Displaced items by best fit, or all of them into new bins; the emptier new bins are then put back by best fit."""
    if rng.random() < 0.5:
        for i in sorted(displaced, key=sizes.__getitem__, reverse=True):
            out.best_fit(i, sizes[i])
        return
    new = Bins(out.capacity)
    fill_new(new, displaced, sizes)
    rest = []
    for items, free in zip(new.items, new.free):
        if free <= out.capacity // 20:
            out.open(items, free)
        else:
            rest += items
    for i in sorted(rest, key=sizes.__getitem__, reverse=True):
        out.best_fit(i, sizes[i])


def crossover(a: Bins, b: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    """a with some whole bins of b, those filled best being the likeliest, and what they displace put back."""
    n = len(b.free)
    order = np.argsort(np.array(b.free) + rng.random(n) * b.capacity * 0.05)
    share = 0.1 + 0.4 * rng.random()
    chosen = order[: max(1, int(n * share))].tolist()
    injected = set()
    for k in chosen:
        injected.update(b.items[k])
    out, displaced = Bins(a.capacity), []
    for items, free in zip(a.items, a.free):
        if injected.isdisjoint(items):
            out.open(list(items), free)
        else:
            displaced += [i for i in items if i not in injected]
    for k in chosen:
        out.open(list(b.items[k]), b.free[k])
    put_back(out, displaced, sizes, rng)
    return out


def mutate(a: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    """a with a part of its emptiest bins and a few others broken up and their items put back."""
    n = len(a.free)
    share = rng.choice([0.02, 0.1, 0.3])
    worst = set(np.argsort(-np.array(a.free))[: max(1, int(n * share))].tolist()) | set(rng.integers(0, n, max(1, n // 50)).tolist())
    out, displaced = Bins(a.capacity), []
    for k, (items, free) in enumerate(zip(a.items, a.free)):
        if k in worst:
            displaced += items
        else:
            out.open(list(items), free)
    put_back(out, displaced, sizes, rng)
    return out


def evolve(sizes: list[int], capacity: int, start: list[Bins], seed: int, offspring: int = OFFSPRING) -> list[Bins]:
    """The elites of one island after an epoch; start is its population so far, with those that migrated to it."""
    rng = np.random.default_rng(seed)
    needed = max(1, -(-sum(sizes) // capacity)) if capacity else 1
    people = [(_value(b), b) for b in start]
    if not people:
        people = [(_value(b), b) for b in [first_fit(sizes, capacity, None)]]
        if len(people[0][1].free) > needed:
            paired = Bins(capacity)
            fill_new(paired, [i for i, n in enumerate(sizes) if n], sizes)
            for i, n in enumerate(sizes):
                if not n:
                    paired.best_fit(i, n)
            people += [(_value(b), b) for b in (paired, *(first_fit(sizes, capacity, rng) for _ in range(POPULATION - 2)))]
    idle, best = 0, None
    for _ in range(offspring):
        people.sort(key=lambda p: -p[0])
        idle = idle + 1 if people[0][0] == best else 0
        best = people[0][0]
        if len(people[0][1].free) <= needed or idle > IDLE:
            break  # no packing has fewer bins, or none is found
        i, j = rng.integers(0, min(2, len(people))), rng.integers(0, len(people))
        child = crossover(people[i][1], people[j][1], sizes, rng) if i != j else mutate(people[i][1], sizes, rng)
        people = [*people[: POPULATION + ELITES - 1], (_value(child), child)]
    people.sort(key=lambda p: -p[0])
    return [b for _, b in people[:ELITES]]


def _restore(bin_of: list[int], sizes: list[int], capacity: int) -> Bins:
    out = Bins(capacity)
    items: list[list[int]] = [[] for _ in range(max(bin_of, default=-1) + 1)]
    free = [capacity] * len(items)
    for i, b in enumerate(bin_of):
        items[b].append(i)
        free[b] -= sizes[i]
    for its, f in zip(items, free):
        out.open(its, f)
    return out


def _bin_of(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins.items):
        for i in items:
            out[i] = b
    return out


_ISLAND = "size_name string, capacity int, shard bigint, island int, rows array<bigint>, pieces array<bigint>, sizes array<int>, elites array<array<int>>, fill double"


def _epoch(epoch: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes, capacity = row["sizes"], row["capacity"]
                start = [_restore(e, sizes, capacity) for e in row["elites"] or []]
                seed = (row["shard"] * ISLANDS + row["island"]) * EPOCHS + epoch
                elites = evolve(sizes, capacity, start, seed)
                row["elites"] = [_bin_of(b, len(sizes)) for b in elites]
                row["fill"] = _value(elites[0])
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return run


def pack(items: DataFrame, sizes: DataFrame, item: str, tokens: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Where each item goes: size_name, item, piece, tokens, container.

    items has an item column (a whole number) and its tokens; sizes has size_name and capacity_tokens, a short list of
    which the driver reads the names. An item larger than a container is split: its full pieces fill containers of
    their own (piece 0, 1, ...) and what is left over is packed like any other item; no other item is split. Items
    without tokens (null) have no place; those of 0 tokens go into any container; repeated items are separate items;
    sizes without a name or a positive capacity are left out; an empty table gives no rows.
    """
    cut = Cut(items.sparkSession)
    given = [(r[0], r[1]) for r in sizes.select("size_name", "capacity_tokens").collect() if r[0] is not None and (r[1] or 0) > 0]
    rows = items.select(F.col(item).cast("bigint").alias("row"), F.col(tokens).cast("bigint").alias("tokens"))
    rows = cut.write(rows).where("tokens is not null")  # written first: a filter on it would count the tokens twice
    every = _for_each_size(rows, given)
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    split = every.withColumn("full", full).withColumn("rest", (F.col("tokens") - F.col("full") * F.col("capacity")).cast("int"))
    shards = max(1, -(-rows.count() // shard_items))
    spread = F.pmod(F.xxhash64("row"), F.lit(shards)) + F.pmod(F.monotonically_increasing_id(), F.lit(shards))  # repeated ids too
    shard = F.pmod(spread, F.lit(shards)).cast("bigint")
    left = split.where("rest > 0 or full = 0").select("size_name", "capacity", shard.alias("shard"), F.struct("row", "rest", "full").alias("i"))
    groups = left.groupBy("size_name", "capacity", "shard").agg(F.sort_array(F.collect_list("i")).alias("i"))
    state = groups.select(
        "size_name", "capacity", "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.col("i.row").alias("rows"), F.col("i.full").alias("pieces"), F.col("i.rest").alias("sizes"),
        F.lit(None).cast("array<array<int>>").alias("elites"), F.lit(None).cast("double").alias("fill"),
    )
    n_tasks = min(10_000, max(1, shards * len(given) * ISLANDS))
    for epoch in range(EPOCHS):
        spread = (_migrate(state) if epoch else state).repartition(n_tasks, "size_name", "shard", "island")
        state = spread.mapInArrow(_epoch(epoch), _ISLAND)
    best = state.groupBy("size_name", "shard").agg(F.max_by(F.struct("rows", "pieces", "sizes", "elites"), F.struct("fill", (-F.col("island")).alias("i"))).alias("b"))
    zipped = F.arrays_zip(F.col("b.rows").alias("row"), F.col("b.pieces").alias("piece"), F.col("b.sizes").alias("tokens"), F.col("b.elites")[0].alias("bin"))
    placed = best.select("size_name", "shard", F.explode(zipped).alias("p"))
    rest = placed.select(
        "size_name", F.col("p.row").alias(item), F.col("p.piece").alias("piece"), F.col("p.tokens").cast("bigint").alias("tokens"),
        F.concat_ws("-", F.lit("shared"), F.col("shard").cast("string"), F.col("p.bin").cast("string")).alias("container"),
    )
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1))
    own = split.where("full > 0").select("size_name", F.col("row").alias(item), pieces.alias("piece"), F.col("capacity").cast("bigint").alias("tokens"))
    own = own.withColumn("container", F.concat_ws("-", F.lit("own"), F.col(item).cast("string"), F.col("piece").cast("string")))
    return rest.unionByName(own)


def _for_each_size(rows: DataFrame, given: list[tuple[str, int]]) -> DataFrame:
    """rows once for each size; the sizes are a short fixed list and become a literal."""
    each = F.array(*[F.struct(F.lit(n).alias("size_name"), F.lit(c).cast("int").alias("capacity")) for n, c in given or [("", 1)]])
    return rows.where(F.lit(bool(given))).select(F.explode(each).alias("s"), "row", "tokens").select("s.size_name", "s.capacity", "row", "tokens")


def _migrate(state: DataFrame) -> DataFrame:
    """Every island with its own elites and those of the island before it in its shard's ring."""
    sent = F.pmod(F.col("island") + 1, F.lit(ISLANDS))
    to = state.select("size_name", "capacity", "shard", F.explode(F.array(F.col("island"), sent)).alias("to"), "island", "rows", "pieces", "sizes", "elites")
    best = F.when(F.col("to") == F.col("island"), F.col("elites")).otherwise(F.slice("elites", 1, 1))
    return (
        to.groupBy("size_name", "capacity", "shard", F.col("to").alias("island"))
        .agg(F.first("rows").alias("rows"), F.first("pieces").alias("pieces"), F.first("sizes").alias("sizes"), F.flatten(F.sort_array(F.collect_list(best))).alias("elites"))
        .select("size_name", "capacity", "shard", "island", "rows", "pieces", "sizes", "elites", F.lit(None).cast("double").alias("fill"))
    )
