import random

import numpy as np
import pyarrow as pa
import regex

from arborfold.llm import leaks
from arborfold.llm.textform import canonical_array

VOCABULARY = [f"{a}{b}" for a in ("tree", "node", "Größe", "клад", "x1", "page") for b in ("", "s", "ing", "7")]


def form(text):
    return canonical_array(pa.array([text])).to_pylist()[0]


def words(text):
    """Words without case; a small letter whose capital looks like a Latin one is that one's small letter."""
    low = form(text).lower()
    return regex.findall(r"[\p{L}\p{N}]+", form("".join(c.upper() if len(c.upper()) == 1 else c for c in low)).lower())


def plain(docs, items, n=12):
    """(document, item): places of the item's words that stand in a run of n words of both."""
    runs = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), []).append((i, k))
    found = {}
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            for i, at in runs.get(tuple(w[k : k + n]), ()):
                found.setdefault((d, i), set()).update(range(at, at + n))
    return found


def similar(docs, items, threshold, size=5):
    """(document, item): the best weighted similarity of any window of the item's size, if it reaches the threshold."""
    def runs(w):
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    own = {i: runs(words(t or "")) for i, t in items}
    n = {}
    for s in own.values():
        for x in s:
            n[x] = n.get(x, 0) + 1

    def weigh(s):
        return sum(1 / n.get(x, 1) for x in s)

    found = {}
    for d, t in docs:
        w = words(t or "")
        for i, t2 in items:
            if len(own[i] & runs(w)) < 0.5 * len(own[i]):
                continue
            length = len(words(t2 or ""))
            for k in range(-length // 2, len(w)):  # windows are cut at the ends of the text
                here = runs(w[max(0, k) : k + length])
                shared = weigh(here & own[i])
                if shared and (v := shared / weigh(here | own[i])) >= threshold:
                    found[d, i] = max(v, found.get((d, i), 0))
    return found


def dirty(rng, text):
    out = []
    for c in text:
        r = rng.random()
        out.append(c.upper() if r < 0.1 else {" ": "\n", "e": "е", "o": "ο"}.get(c, c) if r < 0.2 else c + "​" if r < 0.23 else c)
    return "".join(out).replace(" ", ", " if rng.random() < 0.3 else " ")


def cases(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(8, 40)))) for i in range(30)]
    items += [(90, items[0][1] + " what then?"), (91, None), (92, ""), (93, "too short")]
    docs = []
    for d in range(150):
        parts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(0, 30)))]
        if rng.random() < 0.5:
            w = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(w))
            parts += [dirty(rng, " ".join(w[a : a + rng.choice([10, 11, 12, 13, 40])])), " ".join(rng.choices(VOCABULARY, k=5))]
        docs.append((d, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "…"), (903, items[3][1]), (903, items[3][1])], items


def test_found_equals_brute_force(spark):
    docs, items = cases(1)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, similarity int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    rows = leaks.leaks(d, i).where("covered_words > 0").collect()
    want = plain(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["covered_words"] for r in rows} == {k: len(v) for k, v in want.items()}
    assert all(12 <= r["covered_words"] <= r["item_words"] and 0 < r["similarity"] <= 1 for r in rows)
    whole = [r for r in rows if (r["doc_id"], r["item_id"]) == (903, 3)]
    assert all(r["covered_words"] == r["item_words"] and r["similarity"] == 1 for r in whole)
    assert leaks.leaks(d.where("false"), i).count() == 0 == leaks.leaks(d, i.where("false")).count()


def test_slices_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = cases(2)
    monkeypatch.setattr(leaks, "SLICE_WINDOWS", 40)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    parts = leaks.leaks(d, i)
    assert {(r["doc_id"], r["item_id"]) for r in parts.where("covered_words >= 12").collect()} == set(plain(docs, items))


def edited(rng, w, n):
    """w with n words replaced, dropped or doubled."""
    w = list(w)
    for k in rng.sample(range(len(w)), n):
        w[k] = rng.choice([rng.choice(VOCABULARY) + "new", "", f"{w[k]} {w[k]}"])
    return " ".join(w)


def test_edited_items_are_found(spark):
    """Items with some words changed: every row is right, and nine of ten windows of a similarity of 0.8 are found."""
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(17, 150)) if i % 4 else rng.choices(VOCABULARY[:12], k=300))) for i in range(60)]
    items += [(100 + i, t + " " + " ".join(rng.choices(VOCABULARY, k=12))) for i, t in items[:20]]  # items that share a passage
    docs = []
    for d in range(150):
        w = rng.choice(items)[1].split()
        docs.append((d, " ".join([*rng.choices(VOCABULARY, k=rng.randint(0, 60)), dirty(rng, edited(rng, w, min(len(w) - 1, rng.randint(0, max(1, len(w) // 50))))), *rng.choices(VOCABULARY, k=rng.randint(0, 60))])))
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in leaks.leaks(d, i).collect()}
    exact, near = plain(docs, items), similar(docs, items, 0.8)
    assert set(exact) <= set(rows)
    got = {k for k, r in rows.items() if r["similarity"] >= 0.8}
    assert set(rows) == set(exact) | got and got <= set(near)
    assert all(rows[k]["similarity"] <= near[k] + 1e-9 for k in got)
    assert len(near) > 40 and len(got) >= 0.9 * len(near)
    # the windows alone, without the parts
    index = leaks.Index([(k, leaks_words(t)) for k, t in items], 12, 7, 5)
    index.levels = index.levels[1:]
    alone = set()
    for k, t in docs:
        h = leaks_words(t)
        alone |= {(k, int(index.ids[j])) for j in index.search(h, np.array([0, len(h)]), 0.8)[1]}
    assert alone <= set(near) and len(alone) >= 0.9 * len(near)


def leaks_words(text):
    (_, _, hashes, _), = leaks.text_words(pa.array([text]))
    return hashes


def test_very_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 50)
    text = " ".join(random.Random(1).choices(VOCABULARY, k=400))
    (_, _, got, offsets), = leaks.text_words(pa.array([text]))
    monkeypatch.undo()
    (_, _, want, _), = leaks.text_words(pa.array([text]))
    assert (got == want).all() and list(offsets) == [0, 400]
    monkeypatch.setattr(leaks, "PIECE", 50)
    index = leaks.Index([(5, want[100:160])], 12, 7, 5)
    _, item, covered, best = index.search(want, np.array([0, 400]), 0.8)
    assert list(item) == [0] and list(covered) == [60] and list(best) == [1]


def test_fingerprints_count_bits():
    h = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    for window in (5, 12, 81, 254):
        got = leaks.fingerprints(leaks.planes(h), window)
        assert len(got) == 300 - window + 1
        for k in range(0, len(got), 7):
            for b in range(64):
                ones = sum(int(x) >> b & 1 for x in h[k : k + window])
                assert int(got[k]) >> b & 1 == (ones > window // 2)


def test_blocks_find_everything_within_the_distance():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for distance, n in ((0, 1), (1, 2), (3, 4), (5, 3), (7, 4)):
        blocks = leaks.Blocks(prints, distance, n)
        queries = prints.copy()
        for k in range(len(queries)):
            for b in rng.choice(64, rng.integers(0, distance + 3), replace=False):
                queries[k] ^= np.uint64(1) << np.uint64(b)
        left, right = blocks.candidates(queries)
        want = {(q, i) for q in range(len(queries)) for i in range(len(prints)) if int(queries[q] ^ prints[i]).bit_count() <= distance}
        assert set(zip(left.tolist(), right.tolist())) == want and len(left) == len(want)
