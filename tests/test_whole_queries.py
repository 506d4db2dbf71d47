"""Queries over whole tables against plain Python, beside their SQL."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborfold.operators import hierarchy, sync
from tests.test_hierarchy import random_links
from tools import compare


def make_events():
    """(event_id, user_id, event_type, ts, value): eight users, the first with a fourth of the events, some with few."""
    rng = random.Random(5)
    users = [1] * 40 + [2] * 25 + [3] * 9 + [4] * 2 + [5] + [u for u in (6, 7, 900) for _ in range(28)]
    rng.shuffle(users)
    start = datetime.datetime(2024, 1, 1)
    return [(i, u, rng.choice(["click", "view", "buy"]), start + datetime.timedelta(seconds=rng.randrange(10**6)), rng.randrange(1000) / 4) for i, u in enumerate(users)]


EVENTS = make_events()


def trees():
    """Per tree its entries in order, and the parents of every entry, by the rule of plans/history.py."""
    order, up = {}, {}
    for i, u, *_ in sorted(EVENTS, key=lambda r: (r[3], r[0])):
        order.setdefault(str(u), []).append(i)
    for ids in order.values():
        back = lambda k, n: ids[k - n] if k >= n else None
        for k, i in enumerate(ids):
            first = (back(k, 2) if back(k, 2) is not None else back(k, 1)) if i % 7 == 0 else back(k, 1)
            up[i] = {p for p in (first, back(k, 3) if i % 5 == 0 else None) if p is not None}
    return order, up


def name_of(i):
    return f"{i:012d}"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("events")
    ids, users, types, ts, values = zip(*EVENTS)
    columns = {"event_id": pa.array(ids, pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": types, "value": pa.array(values, pa.float64()), "props": ["{}"] * len(ids)}
    pq.write_table(pa.table(columns), place / "events.parquet")
    return str(place)


def ours(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def by_sql(folder, name):
    got = compare.views(folder).execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def holds(rows, part):
    """The rows are those of the SQL."""
    assert part
    mine = {tuple(sorted(r.asDict().items())) for r in rows}
    assert {tuple(sorted(r.items())) for r in part} == mine


def test_merge_base_of_every_tree(spark, folder):
    order, up = trees()

    def closed(wanted, gone):
        """Whether no way up from wanted ends at a root without passing gone."""
        seen, todo = set(), [wanted]
        while todo:
            n = todo.pop()
            if n != gone and n not in seen:
                if not up[n]:
                    return False
                seen.add(n)
                todo += up[n]
        return True

    want = {}
    for tree, ids in order.items():
        asked = [ids[-k] for k in (2, 9) if len(ids) >= k]
        if asked:
            through = [i for i in ids if all(closed(w, i) for w in asked)]
            want[tree] = name_of(through[-1]) if through else None
    rows = ours(spark, folder, "g11_merge_base")
    assert {r["tree_id"]: r["base"] for r in rows} == want and len(rows) == len(want) == 7
    holds(rows, by_sql(folder, "g11_merge_base"))


def test_heights_of_every_entry(spark, folder):
    order, up = trees()
    want = {}
    for ids in order.values():
        for i in ids:
            want[i] = max((want[p] + 1 for p in up[i]), default=0)
    rows = ours(spark, folder, "g23_heights_incremental")
    assert {r["entry_id"]: r["height"] for r in rows} == {name_of(i): d for i, d in want.items()} and len(rows) == len(EVENTS)
    holds(rows, by_sql(folder, "g23_heights_incremental"))


def test_custom_merge_and_ingest_of_every_event(spark, folder):
    letters = {}
    for _, u, kind, *_ in sorted(EVENTS):
        letters[u] = letters.get(u, "") + kind[0]
    rows = ours(spark, folder, "x00_custom_merge")
    assert {r["user_id"]: r["state"] for r in rows} == letters and len(rows) == len(letters)
    rows = ours(spark, folder, "x01_streaming_ingest")
    assert {r["tree_id"]: r["n"] for r in rows} == {str(u): len(x) for u, x in letters.items()} and len(rows) == len(letters)


def closure(links):
    """(ancestor, descendant) pairs by a walk up from every node."""
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    pairs = set()
    for n in up:
        seen, todo = set(), [*up[n]]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += up.get(a, ())
        pairs |= {(a, n) for a in seen}
    return pairs


@pytest.mark.parametrize(("core", "stuck"), [(0, 0), (8, 1000)])
@pytest.mark.parametrize("seed", [3])
def test_ancestors_over_cycles(spark, seed, core, stuck):
    links, roots = random_links(seed)
    found = hierarchy.values(spark.createDataFrame(links, "c string, p string"), spark.createDataFrame([(r,) for r in roots], "n string"), "ancestors", core, stuck).collect()
    got = [(a, r["n"]) for r in found for a in r["ancestors"]]
    assert any(r["cyclic"] for r in found) and len(got) == len(set(got)) and set(got) == closure(links)


def test_descendants_below_a_cycle(spark, tmp_path):
    """b and c form a cycle near the top; d hangs below it and on a, e and f below d."""
    links = [("b", "a"), ("b", "c"), ("c", "b"), ("d", "c"), ("d", "x"), ("x", "a"), ("e", "d"), ("f", "e"), ("g", "a"), ("f", "e")]
    pq.write_table(pa.table({"child_id": [c for c, _ in links], "parent_id": [p for _, p in links]}), tmp_path / "tree_parents.parquet")
    pq.write_table(pa.table({"id": ["a"], "is_root": [True]}), tmp_path / "entries.parquet")
    got = [tuple(r) for r in ours(spark, str(tmp_path), "p1_descendants")]
    assert len(got) == len(set(got)) and set(got) == closure(links) and {("b", "b"), ("a", "f"), ("c", "e")} <= set(got)


def test_first_parent_chain_of_every_entry(spark, folder):
    order, up = trees()
    want = {}
    for ids in order.values():
        for i in ids:
            root, steps = want[min(up[i])] if up[i] else (name_of(i), -1)
            want[i] = root, steps + 1
    rows = ours(spark, folder, "g10_first_parent_chain")
    assert {r["entry_id"]: (r["root_id"], r["steps"]) for r in rows} == {name_of(i): w for i, w in want.items()} and len(rows) == len(EVENTS)
    holds(rows, by_sql(folder, "g10_first_parent_chain"))


def test_pinned_state_of_every_entry(spark, folder):
    order, up = trees()
    above = {}
    for ids in order.values():
        for i in ids:
            above[i] = {i}.union(*(above[p] for p in up[i]))
    place = {i: k for ids in order.values() for k, i in enumerate(ids)}
    want = {}
    for i, seen in above.items():
        for kind in {EVENTS[a][2] for a in seen}:
            want[name_of(i), kind] = EVENTS[max((a for a in seen if EVENTS[a][2] == kind), key=place.get)][4]
    rows = ours(spark, folder, "v02_pinned_states")
    assert {(r["at_entry"], r["store"]): r["value"] for r in rows} == want and len(rows) == len(want)
    holds(rows, by_sql(folder, "v02_pinned_states"))


def test_fanout_and_queues_of_every_entry(spark, tmp_path):
    """Tree t is synced by p and q, u by p only and not on commit, v by nobody; heights are of any kind, or null."""
    trees_of = [("t", f"e{i}", i if i % 3 else None) for i in range(12)] + [("u", "e90", 3), ("v", "e91", 53), (None, "e92", 3)]
    rows = trees_of + trees_of[:2]
    pq.write_table(pa.table({"tree_id": pa.array([r[0] for r in rows], pa.string()), "id": [r[1] for r in rows], "height": pa.array([r[2] for r in rows], pa.int64())}), tmp_path / "entries.parquet")
    syncs = [("s1", "t", "p", True, 20), ("s2", "t", "q", True, 1), ("s3", "u", "p", True, 1), ("s4", "v", None, True, 20), ("s1", "t", "p", True, 20)]
    names = ["sync_id", "tree_id", "peer_pubkey", "success", "entries_count"]
    pq.write_table(pa.table(dict(zip(names, zip(*syncs))) | {"duration_ms": [1.0] * len(syncs)}), tmp_path / "sync_history.parquet")
    want = {(p, "t", f"e{i}") for p in "pq" for i in range(12)}
    got = [(r["peer"], r["tree_id"], r["entry_id"]) for r in ours(spark, str(tmp_path), "y03_fanout")]
    assert len(got) == len(want) and set(got) == want
    queues = {r["peer"]: (r["n_entries"], r["first_entry"], r["last_entry"]) for r in ours(spark, str(tmp_path), "y04_queue_drain")}
    assert queues == {"p": (12, "e0", "e9"), "q": (12, "e0", "e9")}


def test_fanout_of_a_large_tree_is_shared_out(spark, monkeypatch):
    """One tree makes nearly all rows; no task has more than a fourth of them, and none is lost or doubled."""
    monkeypatch.setattr(sync, "PART_ROWS", 500, raising=False)
    monkeypatch.setattr(sync, "TASK_ROWS", 2_000, raising=False)
    entries = [("big", f"e{i}") for i in range(400)] + [("small", f"s{i}") for i in range(5)] + [("off", "o"), (None, "x"), ("nobody's", "y")]
    peers = [("big", f"p{i}") for i in range(50)] + [("small", "p0"), ("off", "p1")]
    settings = [("big", True, True), ("small", True, True), ("off", True, None), ("nobody's", True, True)]
    df = sync.fan_out(spark.createDataFrame(entries, "tree_id string, entry_id string"), spark.createDataFrame(peers, "tree_id string, peer string"), spark.createDataFrame(settings, "tree_id string, sync_enabled boolean, sync_on_commit boolean"))
    got = [(r["peer"], r["tree_id"], r["entry_id"]) for r in df.collect()]
    want = {(p, t, e) for t, e in entries for u, p in peers if t == u and t in ("big", "small")}
    assert len(got) == len(want) == 20_005 and set(got) == want
    each = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(each) < len(want) / 4
    assert sync.fan_out(df.select("tree_id", "entry_id").limit(0), spark.createDataFrame(peers, "tree_id string, peer string"), spark.createDataFrame(settings, "tree_id string, sync_enabled boolean, sync_on_commit boolean")).count() == 0
