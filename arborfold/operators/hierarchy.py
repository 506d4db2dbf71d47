"""Parent-child links to full hierarchies by tree contraction.

A round of the contraction looks at every node's number of parents and children and then
- rakes leaves: a node without children leaves, its links are recorded;
- compresses unary chains: a node with one parent (and any children) leaves, its children are linked to its parent with
  the sum of the lengths. A coin per node and round picks which nodes leave, so that none leaves together with its parent.
Every recorded link points to a node that stays, links never become more, and about half of them leave in a round. A
cycle shrinks like a chain, to a node that is its own parent.

Rounds end when few links are left or when they do not help any more: every node left then has a cycle at or below it.
Such a core is solved in one task while its links and what its paths or ancestors will hold are few (fixed bounds), and
level by level from above otherwise; nodes that no order reaches run into a cycle. The records are then replayed
backwards, last round first: a node's value is the best of its recorded parents' values, and a node that left between
two nodes of one cycle is on it.

Nodes may have several parents (merges): depth is the number of links on the longest way up, the path is that way (of
several longest ones the smallest in the order of ids), and ancestors are those over any way.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.plans.cut import Cut

#: Rounds end at this many links.
CORE_LINKS = 2_000
#: Rounds also end when two in a row leave more than this share of the links; up to so many links are then solved in one
#: task, if all paths or ancestors in it have at most so many elements (eight characters of a path count as one).
SLOW, STUCK_LINKS, CORE_ELEMENTS = 0.9, 20_000, 20_000_000
SEP = "/"


#: The column of a link that carries a payload.
_EXTRA = {"path": ["seg"], "ancestors": ["between"], "floor": ["m"], None: []}
_TYPE = {"path": "string", "ancestors": "array<string>", "floor": "bigint"}


def _coin(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def _round(links: DataFrame, turn: int, payload: str | None) -> DataFrame:
    """links (c, p, w[, seg | between]) after one round, with _gone for the recorded ones."""
    extra = _EXTRA[payload]
    null = {"seg": F.lit(None).cast("string"), "between": F.lit(None).cast("array<string>"), "m": F.lit(None).cast("bigint")}
    as_child = links.select(F.col("c").alias("n"), "p", "w", *extra, F.lit(0).alias("kids"))
    as_parent = links.select(F.col("p").alias("n"), F.lit(None).cast(links.schema["p"].dataType).alias("p"), F.lit(None).cast("bigint").alias("w"), *[null[e].alias(e) for e in extra], F.lit(1).alias("kids"))
    if payload == "path":
        best = [F.min(F.when(F.col("w").isNotNull(), F.struct((-F.col("w")).alias("v"), "seg"))).alias("best")]
        up_w, up = -F.col("best.v"), [F.col("best.seg").alias("u_seg")]
    elif payload == "ancestors":
        best = [F.max("w").alias("mw"), F.array_distinct(F.flatten(F.collect_list("between"))).alias("mb")]
        up_w, up = F.col("mw"), [F.col("mb").alias("u_between")]
    else:
        best = [F.max("w").alias("mw"), *([F.max("m").alias("mm")] if payload else [])]
        up_w, up = F.col("mw"), [F.col("mm").alias("u_m")] if payload else []
    nodes = as_child.unionAll(as_parent).groupBy("n").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.sum("kids").alias("kids"), *best)
    splice = (F.col("p0") == F.col("p1")) & (F.col("kids") > 0) & (F.col("n") != F.col("p0")) & _coin(F.col("n"), turn) & ~_coin(F.col("p0"), turn) & up_w.isNotNull()
    mark = nodes.select(F.col("n").alias("mark_n"), ((F.col("kids") == 0) | F.coalesce(splice, F.lit(False))).alias("_gone"))
    spliced = nodes.where(splice).select(F.col("n").alias("u_n"), F.col("p0").alias("u_p"), up_w.alias("u_w"), *up)
    marked = links.join(mark, F.col("c") == F.col("mark_n")).drop("mark_n")
    moved = marked.join(spliced, F.col("p") == F.col("u_n"), "left")
    on = F.col("u_n").isNotNull()
    columns = ["c", F.coalesce("u_p", "p").alias("p"), (F.col("w") + F.coalesce("u_w", F.lit(0))).alias("w")]
    if payload == "path":
        columns.append(F.when(on, F.concat("u_seg", "u_n", F.lit(SEP), "seg")).otherwise(F.col("seg")).alias("seg"))
    if payload == "floor":
        columns.append(F.greatest("m", F.col("u_m") + F.col("w")).alias("m"))
    if payload == "ancestors":
        columns.append(F.when(on, F.array_distinct(F.concat("u_between", F.array("u_n"), "between"))).otherwise(F.col("between")).alias("between"))
    return moved.select(*columns, "_gone")


def _solve(rows: list[tuple], payload: str | None) -> Iterator[tuple]:
    """Values of the core's nodes from its links (c, p, w, root_ok, extra), in an order in which parents come first."""
    parents: dict = {}
    kids: dict = {}
    ok: set = set()
    floor: dict = {}
    for c, p, w, root_ok, root_m, extra in rows:
        parents.setdefault(c, []).append((p, w, extra))
        kids.setdefault(p, []).append(c)
        if root_ok:
            ok.add(p)
            floor[p] = root_m
    left = {n: len(x) for n, x in parents.items()}
    value: dict = {}
    ready = []
    for p in kids:
        if p not in parents:
            value[p] = (0, p not in ok, {"path": str(p), "ancestors": [], "floor": floor.get(p)}.get(payload))
            ready.append(p)
    while ready:
        n = ready.pop()
        for c in kids.get(n, ()):
            left[c] -= 1
            if left[c]:
                continue
            ways = [(value[p], p, w, extra) for p, w, extra in parents[c]]
            depth = max(v[0] + w for v, _, w, _ in ways)
            bad = any(v[1] for v, _, _, _ in ways)
            more = None
            if payload == "path":
                more = min(v[2] + SEP + extra + str(c) for v, _, w, extra in ways if v[0] + w == depth)
            elif payload == "ancestors":
                more = list(dict.fromkeys(a for v, p, _, extra in ways for a in (*v[2], p, *extra)))
            elif payload == "floor":
                more = max((x for v, _, w, extra in ways for x in (extra, None if v[2] is None else v[2] + w) if x is not None), default=None)
            value[c] = (depth, bad, more)
            ready.append(c)
    above = _cyclic_ancestors(parents, value) if payload == "ancestors" else {}
    for n in parents:
        depth, bad, more = value.get(n, (None, None, above.get(n)))
        yield n, depth, bad, n not in value, more


def _cyclic_ancestors(parents: dict, value: dict) -> dict:
    """Ancestors of the core's nodes without a value: those on one cycle share them and are among them."""
    above: dict = {}
    for part in _parts({c: {p for p, _, _ in ways if p not in value} for c, ways in parents.items() if c not in value}):
        ways = [w for c in part for w in parents[c]]
        every = list(dict.fromkeys(a for p, _, extra in ways for a in (*(value[p][2] if p in value else above.get(p, ())), p, *extra)))
        above.update(dict.fromkeys(part, every))
    return above


def _one_task(df: DataFrame) -> DataFrame:
    return df.repartition(1)


def _size(live: DataFrame, payload: str | None) -> tuple[int, int]:
    """Links, and at most how many elements all paths or ancestors of their nodes have."""
    held = {"path": F.ceil((F.length("seg") + F.length("c") + 1) / 8), "ancestors": F.size("between") + 1}.get(payload, F.lit(0))
    n, all_ = live.agg(F.count(F.lit(1)), F.sum(held)).first()
    return n, n * (all_ or 0)


class _Contracted:
    """Links after all rounds (live), and for each round what it recorded and the links before it."""

    def __init__(self, live: DataFrame, payload: str | None, cut: Cut, core_links: int, stuck_links: int) -> None:
        self.records: list[DataFrame] = []
        self.before: list[DataFrame] = []
        slow = 0
        count, held = _size(live, payload)
        while (count > core_links or held > CORE_ELEMENTS) and slow < 2:
            done = cut.write(_round(live, len(self.records), payload), partition_by="_gone")
            self.records.append(done.where("_gone").drop("_gone"))
            self.before.append(live)
            live, was = done.where("not _gone").drop("_gone"), count
            count, held = _size(live, payload)
            slow = slow + 1 if count > SLOW * was else 0
        self.live, self.small = live, count <= max(core_links, stuck_links) and held <= CORE_ELEMENTS


class Hierarchy:
    """The contraction of links, the values of all nodes, and the nodes on cycles; see values()."""

    def __init__(self, links: DataFrame, roots: DataFrame, payload: str | None = None, core_links: int = CORE_LINKS, stuck_links: int = STUCK_LINKS) -> None:
        spark = links.sparkSession
        self._cut = cut = Cut(spark)
        self._stuck_links = stuck_links
        key = links.schema["c"].dataType
        live = links.where(F.col("c").isNotNull() & F.col("p").isNotNull()).select("c", "p", F.lit(1).cast("bigint").alias("w"), *(["m"] if payload == "floor" else []))
        if payload == "path":
            live = live.withColumn("seg", F.lit(""))
        if payload == "ancestors":
            live = live.withColumn("between", F.array().cast("array<string>"))
        live = cut.write(live)
        top = roots.groupBy("n").agg((F.max("m") if payload == "floor" else F.lit(None)).cast("bigint").alias("m")).where("n is not null").join(live.select(F.col("c").alias("n")), "n", "left_anti")
        top = cut.write(top)
        self._done = done = _Contracted(live, payload, cut, core_links, stuck_links)
        live = done.live
        own = {"path": F.col("n"), "ancestors": F.array().cast("array<string>"), "floor": F.col("m")}.get(payload)
        start = top.select("n", F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("bad"), F.lit(False).alias("cyclic"), *([own.alias(payload)] if payload else []))
        if done.small:
            schema = f"n {key.simpleString()}, depth bigint, bad boolean, cyclic boolean" + (f", {payload} {_TYPE[payload]}" if payload else "")
            flagged = live.join(top.select(F.col("n").alias("p"), F.col("m").alias("root_m"), F.lit(True).alias("ok")), "p", "left")
            extra = F.col(_EXTRA[payload][0]) if payload else F.lit(None).cast("string")
            rows = flagged.select("c", "p", "w", F.coalesce("ok", F.lit(False)).alias("ok"), "root_m", extra.alias("extra"))
            core = cut.write(_one_task(rows).mapInArrow(_solver(payload, key.simpleString()), schema))
            self._cyclic = live
        else:
            core, self._cyclic = _descend(live, start, payload, cut)
        self._core = core
        parts = [start, core]
        for record in reversed(done.records):
            parts.append(cut.write(_replay(record, reduce(DataFrame.unionByName, parts), payload)))
        self.values = reduce(DataFrame.unionByName, parts)

    def on_cycles(self) -> DataFrame:
        """n of every node that is its own ancestor."""
        cut, stuck = self._cut, self._core.where("cyclic").select("n")
        links = self._cyclic.select("c", "p").distinct()
        links = links.join(stuck.withColumnRenamed("n", "c"), "c", "left_semi").join(stuck.withColumnRenamed("n", "p"), "p", "left_semi")
        labels = _strong_parts(cut.write(links), cut, self._stuck_links)
        if labels is None:
            return stuck.where("false")
        parts = [labels]
        for record, before in zip(reversed(self._done.records), reversed(self._done.before)):
            known = reduce(DataFrame.unionAll, parts)
            over = record.select("c", "p").distinct().join(known.select(F.col("n").alias("p"), "part"), "p")
            kids = before.select(F.col("c").alias("kid"), F.col("p").alias("c")).join(known.select(F.col("n").alias("kid"), F.col("part").alias("kid_part")), "kid")
            parts.append(cut.write(over.join(kids, "c").where("part = kid_part").select(F.col("c").alias("n"), "part").distinct()))
        return reduce(DataFrame.unionAll, parts).select("n")


def _solver(payload: str | None, key: str):  # noqa: ANN202
    arrow = pa.string() if key == "string" else pa.int64()
    more_type = {"path": pa.string(), "ancestors": pa.list_(pa.string()), "floor": pa.int64()}.get(payload)
    types, names = [arrow, pa.int64(), pa.bool_(), pa.bool_(), more_type], ["n", "depth", "bad", "cyclic", payload]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        out = list(_solve(rows, payload))
        size = 20_000
        for i in range(0, len(out), size):
            part = list(zip(*out[i : i + size]))[: 5 if payload else 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, types)], names[: len(part)])

    return solve


def values(links: DataFrame, roots: DataFrame, payload: str | None = None, core_links: int = CORE_LINKS, stuck_links: int = STUCK_LINKS) -> DataFrame:
    """The value of every node: n, depth, bad, cyclic[, path | ancestors | floor]; a union of written tables.

    links has (c, p), of any one key type (strings for a payload); repeated links change nothing, rows with a null do
    not count. roots has (n), the keys of root entries. Nodes with links upwards have a value, and so have roots without
    any. bad: some way up ends at a node that is not a root. cyclic: some way up runs into a cycle; depth, bad and payload
    are then null, except for ancestors. payload "path": ids from the root to the node, joined by "/"; "ancestors": an
    array of all of them, over cycles too, so that a node on a cycle is its own ancestor;
    "floor": the larger of the node's own number (m, a column of links for the child and of roots) and one more than the
    largest floor of its parents, where parents without links or number do not count.
    """
    return Hierarchy(links, roots, payload, core_links, stuck_links).values


def _descend(live: DataFrame, start: DataFrame, payload: str | None, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """Values of a core that is too large for one task, and the links between its cyclic nodes.

    Level by level from above: a link to a node with a value takes that value with it (ground) and is not read again as a
    link; a node of which all links have done so has a value. What is left in the end has a cycle above it.
    """
    extra = _EXTRA[payload]
    parts: list[DataFrame] = []
    new, first = start, True
    ground = None
    while True:
        known = new.select(F.col("n").alias("p"), F.col("depth").alias("p_depth"), F.col("bad").alias("p_bad"), F.col("cyclic").alias("p_cyclic"), *([F.col(payload).alias("p_more")] if payload else []))
        if first:  # parents without links upwards, whether they are roots or not
            tops = live.select("p").join(live.select(F.col("c").alias("p")), "p", "left_anti").distinct()
            known = tops.join(known, "p", "left")
        passed = live.join(known, "p").select("c", "p", "w", *extra, "p_depth", "p_bad", F.col("p_cyclic").alias("cyclic"), *(["p_more"] if payload else []))
        ground = cut.write(passed if ground is None else ground.unionByName(passed))
        live = cut.write(live.join(known.select("p"), "p", "left_anti"))
        ready = ground.join(live.select("c").distinct(), "c", "left_anti")
        new, first = cut.write(_best(ready, payload)), False
        if new.isEmpty():
            break
        parts.append(new)
        ground = cut.write(ground.join(live.select("c").distinct(), "c", "left_semi"))
    none = [F.lit(None).cast(t).alias(x) for x, t in (("depth", "bigint"), ("bad", "boolean"))]
    if payload == "ancestors":
        stuck = _closed(live, ground, cut).select("n", *none, F.lit(True).alias("cyclic"), "ancestors")
    else:
        stuck = live.select(F.col("c").alias("n")).distinct().select("n", *none, F.lit(True).alias("cyclic"), *([F.lit(None).cast(_TYPE[payload]).alias(payload)] if payload else []))
    return reduce(DataFrame.unionByName, parts, cut.write(stuck)), live


def _closed(live: DataFrame, ground: DataFrame, cut: Cut) -> DataFrame:
    """n, ancestors of the nodes of a core in which every node has a cycle above: the ways between them, doubled in each round."""
    inner = live.select("c", F.concat(F.array("p"), "between").alias("a"))
    outer = ground.select("c", F.concat(F.coalesce("p_more", F.array().cast("array<string>")), F.array("p"), "between").alias("a"))
    own = cut.write(inner.unionAll(outer).groupBy(F.col("c").alias("n")).agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("ancestors")))
    reach = cut.write(live.select("c", "p").distinct())
    before, count = -1, reach.count()
    while before < count:
        on = reach.select(F.col("c").alias("p"), F.col("p").alias("q"))
        longer = cut.write(reach.unionAll(reach.join(on, "p").select("c", F.col("q").alias("p"))).distinct())
        cut.drop(reach)
        reach, before, count = longer, count, longer.count()
    over = reach.join(own.withColumnRenamed("n", "p"), "p").select(F.col("c").alias("n"), "ancestors")
    pairs = own.unionAll(over).select("n", F.explode("ancestors").alias("a")).distinct()
    return pairs.groupBy("n").agg(F.collect_list("a").alias("ancestors"))


def _replay(record: DataFrame, known: DataFrame, payload: str | None) -> DataFrame:
    """Values of the nodes that left in one round, from those of the nodes that stayed; an unknown parent is no root."""
    up = known.select(F.col("n").alias("p"), F.col("depth").alias("p_depth"), F.col("bad").alias("p_bad"), "cyclic", *([F.col(payload).alias("p_more")] if payload else []))
    return _best(record.join(up, "p", "left"), payload)


def _best(joined: DataFrame, payload: str | None) -> DataFrame:
    """Values of nodes from all their links, which carry the values of the parents (null: no root)."""
    no = F.lit(False)
    depth = F.when(~F.coalesce("cyclic", no), F.coalesce("p_depth", F.lit(0)) + F.col("w"))
    out = [F.max(depth).alias("depth"), F.max(F.coalesce("p_bad", F.col("cyclic").isNull())).alias("bad"), F.max(F.coalesce("cyclic", no)).alias("cyclic")]
    if payload == "path":
        path = F.concat(F.coalesce("p_more", "p"), F.lit(SEP), "seg", "c")
        out.append(F.min(F.when(depth.isNotNull(), F.struct((-depth).alias("v"), path.alias("path")))).alias("more"))
    if payload == "ancestors":
        whole = F.concat(F.coalesce("p_more", F.array().cast("array<string>")), F.array("p"), "between")
        out.append(F.array_distinct(F.flatten(F.collect_list(whole))).alias("more"))
    if payload == "floor":
        out.append(F.max(F.greatest("m", F.col("p_more") + F.col("w"))).alias("more"))
    values_ = joined.groupBy(F.col("c").alias("n")).agg(*out)
    clean = [F.when(~F.col("cyclic"), F.col(c)).alias(c) for c in ("depth", "bad")]
    known_more = F.col("more.path" if payload == "path" else "more")
    more = [(known_more if payload == "ancestors" else F.when(~F.col("cyclic"), known_more)).alias(payload)] if payload else []
    return values_.select("n", *clean, "cyclic", *more)


def below(links: DataFrame, seeds: DataFrame, core_links: int = CORE_LINKS, stuck_links: int = STUCK_LINKS) -> DataFrame:
    """n of every node with a seed above it, over one or more links; without the seeds themselves. A union of written tables.

    links has (c, p), seeds (n). The links of a seed do not matter, so they are left out; the rest is contracted, and
    the rounds are followed downwards by semi-joins: a recorded node is below a seed if one of its recorded parents is a
    seed or below one. Cycles and repeated links do no harm; rows with a null do not count.
    """
    cut = Cut(links.sparkSession)
    key = links.schema["c"].dataType.simpleString()
    seeds = cut.write(seeds.where("n is not null").select("n").distinct())
    live = links.where("c is not null and p is not null and c <> p").join(seeds.withColumnRenamed("n", "c"), "c", "left_anti")
    done = _Contracted(cut.write(live.select("c", "p", F.lit(1).cast("bigint").alias("w"))), None, cut, core_links, stuck_links)
    core = done.live.select("c", "p")
    if done.small:
        rows = core.unionAll(seeds.join(core, seeds["n"] == core["p"], "left_semi").select(F.lit(None).cast(key).alias("c"), F.col("n").alias("p")))
        parts = [seeds, cut.write(_one_task(rows).mapInArrow(_follower(key), f"n {key}"))]
    else:
        parts = [seeds]
        new = seeds
        while not new.isEmpty():
            reached = core.join(new.withColumnRenamed("n", "p"), "p", "left_semi").select(F.col("c").alias("n")).distinct()
            new = cut.write(reached.join(reduce(DataFrame.unionAll, parts), "n", "left_anti"))
            parts.append(new)
    for record in reversed(done.records):
        known = reduce(DataFrame.unionAll, parts).withColumnRenamed("n", "p")
        parts.append(cut.write(record.join(known, "p", "left_semi").select(F.col("c").alias("n")).distinct()))
    return reduce(DataFrame.unionAll, parts[1:])


def _follower(key: str):  # noqa: ANN202
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under: dict = {}
        todo, seen = [], set()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x is None:
                    todo.append(y)
                else:
                    under.setdefault(y, []).append(x)
        while todo:
            for x in under.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string() if key == "string" else pa.int64())], ["n"])

    return follow


def _strong_parts(links: DataFrame, cut: Cut, stuck_links: int) -> DataFrame | None:
    """n, part of the nodes on cycles of the links (c, p), equal for nodes of one strongly connected part; None if there are no links.

    Few links are solved in one task. Otherwise: every node takes the largest node at or above it as its colour, round by
    round; what is reached downwards from a node of its own colour inside the colour has that node above it, and what
    reaches it upwards inside the colour is its part. Parts are taken out, and the rest goes on.
    """
    kind = links.schema["c"].dataType.simpleString()
    if links.isEmpty():
        return None
    parts: list[DataFrame] = []
    while (count := links.count()) > stuck_links:
        nodes = links.select(F.col("c").alias("n")).unionAll(links.select("p")).distinct()
        last = colour = cut.write(nodes.select("n", F.col("n").alias("col")))
        while True:
            up = links.join(colour.select(F.col("n").alias("p"), F.col("col").alias("p_col")), "p").groupBy(F.col("c").alias("n")).agg(F.max("p_col").alias("p_col"))
            held = cut.write(colour.join(up, "n", "left").select("n", F.greatest("col", "p_col").alias("col"), F.col("col").alias("was")))
            cut.drop(last)
            last, colour = held, held.drop("was")
            if held.where("col <> was").isEmpty():
                break
        a, b = colour.select(F.col("n").alias("c"), F.col("col").alias("col")), colour.select(F.col("n").alias("p"), F.col("col").alias("p_col"))
        inside = cut.write(links.join(a, "c").join(b, "p").where("col = p_col").select("c", "p", "col"))
        # upwards from each colour's own node
        own = inside.where("c = col")
        found = cut.write(own.select(F.col("p").alias("n")).distinct())
        new = found
        while not new.isEmpty():
            above = inside.join(new.withColumnRenamed("n", "c"), "c", "left_semi").select(F.col("p").alias("n")).distinct()
            new = cut.write(above.join(found, "n", "left_anti"))
            found = cut.write(found.unionAll(new))
        # all that the colour's node reaches upwards has that node above it too, as its colour says: one part
        part = cut.write(colour.join(found, "n", "left_semi").select("n", F.col("col").alias("part")))
        parts.append(part)
        gone = colour.where("n = col").select("n").unionAll(part.select("n")).distinct()
        left = links.join(gone.withColumnRenamed("n", "c"), "c", "left_anti").join(gone.withColumnRenamed("n", "p"), "p", "left_anti")
        links = cut.write(left)
    if count:
        parts.append(cut.write(_one_task(links).mapInArrow(_part_finder(kind), f"n {kind}, part {kind}")))
    return reduce(DataFrame.unionAll, parts)


def _part_finder(kind: str):  # noqa: ANN202
    arrow = pa.string() if kind == "string" else pa.int64()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                up.setdefault(x, set()).add(y)
        rows = [(n, part[0]) for part in _parts(up) if len(part) > 1 or part[0] in up[part[0]] for n in part]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], arrow), pa.array([r[1] for r in rows], arrow)], ["n", "part"])

    return find


def _parts(up: dict) -> Iterator[list]:
    """The strongly connected parts of nodes with their parents, each after those above it: one walk numbers them."""
    number: dict = {}
    low: dict = {}
    stack: list = []
    inside: set = set()
    for first in up:
        if first in number:
            continue
        walk = [(first, iter(up[first]))]
        number[first] = low[first] = len(number)
        stack.append(first)
        inside.add(first)
        while walk:
            n, rest = walk[-1]
            for p in rest:
                if p not in up:
                    continue
                if p not in number:
                    number[p] = low[p] = len(number)
                    stack.append(p)
                    inside.add(p)
                    walk.append((p, iter(up[p])))
                    break
                if p in inside:
                    low[n] = min(low[n], number[p])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[n])
                if low[n] == number[n]:
                    part = []
                    while not part or part[-1] != n:
                        part.append(stack.pop())
                        inside.discard(part[-1])
                    yield part


def keyed(ids: Column) -> Column:
    """A 64-bit key of an id."""
    return F.xxhash64(ids)


def keys_collide(*ids: DataFrame) -> bool:
    """Whether two different ids of these one-column tables share a key; a second hash tells them apart."""
    every = reduce(DataFrame.unionAll, [d.select(F.col(d.columns[0]).alias("i")) for d in ids]).where("i is not null")
    pairs = every.select(keyed(F.col("i")).alias("k"), F.xxhash64(F.lit(sys.maxsize), F.reverse("i")).alias("k2"))
    return not pairs.groupBy("k").agg((F.min("k2") != F.max("k2")).alias("two")).where("two").isEmpty()
