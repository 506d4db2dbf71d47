"""Test items leaking into documents: SimHash windows, multi-index Hamming blocks, exact verification.

Windows of two kinds get a 64-bit SimHash of their words:
- item-sized ones: a window at either end of every item, as long as the item down to the next of a few lengths (LENGTHS;
  items longer than the last have windows all along), and every window of these lengths of a document;
- parts: every run of `part` words of an item and of a document, as a document may hold only a part of an item.
The item fingerprints are cut into blocks of bits. Two fingerprints within a distance of d differ in one of m blocks by at
most d // m bits, so an index of all block values that near finds every one within the distance. Each candidate says
where in the document the item would begin; there an item-sized window is compared with the whole item by the weighted
similarity of their shingles, and parts word by word. Items are few; they are indexed in slices of bounded size, and each
slice is sent to all tasks, which read every document once and move none.

The radius of item-sized windows is 7 of 64 bits: with one word replaced, the distance of windows of 54 words was 3.5 in
the mean and at most 7 for 98 % of 1,500 random ones (two of 81: 94 %, three of 122: 92 %), and each item has two windows.
Windows that are equal have distance 0 and cannot be missed; parts count only if they are equal, so their radius is 0.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborfold.llm.textform import LIMIT, canonical, tables, to_points

#: Item windows in one index (about 200 bytes each), and code points handled at a time.
SLICE_WINDOWS = 500_000
PIECE = 1_000_000
#: Words of item-sized windows; the last is the longest that a byte can count.
LENGTHS = (16, 24, 36, 54, 81, 122, 183, 254)
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(_M1)
    x = (x ^ (x >> _U(27))) * _U(_M2)
    return x ^ (x >> _U(31))


class _Words:
    """Tables that make words of code points: what is part of a word, its form without case, its hash."""

    def __init__(self) -> None:
        one = tables().one
        self.inside = np.fromiter((chr(i).isalnum() for i in range(LIMIT)), bool, LIMIT)
        fold = np.arange(LIMIT, dtype=np.uint32)
        for cp in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x2E00), *range(0xA640, 0xAC00), *range(0xFB00, 0x10600), *range(0x1E900, 0x1E944)):
            if not self.inside[cp]:
                continue
            form = self._lower(int(one[cp]))
            upper = chr(form).upper()  # a look-alike capital makes the small letters of both scripts one
            fold[cp] = self._lower(int(one[ord(upper)])) if len(upper) == 1 else form
        self.hash = _mix((fold.astype(np.uint64) + _U(1)) * _U(_BASE))

    @staticmethod
    def _lower(cp: int) -> int:
        low = chr(cp).lower()
        return ord(low) if len(low) == 1 else cp


@functools.cache
def _word_tables() -> _Words:
    return _Words()


@functools.cache
def _powers() -> list[np.ndarray]:
    return [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    held = _powers()
    if len(held[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            held[i] = np.multiply.accumulate(p)
    return held


def word_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts in consistent form: one 64-bit hash each, and the offsets of each text's words."""
    t = _word_tables()
    if not len(points):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = t.inside[points]
    before = np.r_[False, inside[:-1]]
    begins = offsets[:-1][offsets[:-1] < len(points)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power(max(len(points), 1024))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(t.hash[points] * up[: len(points)], out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


def planes(hashes: np.ndarray) -> list[np.ndarray]:
    """Running counts of the set bits of hashes, eight bits at a time in fields of a byte, modulo 2**64."""
    out = []
    for j in range(8):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((hashes >> _U(j)) & _U(0x0101010101010101), out=sums[1:])
        out.append(sums)
    return out


def fingerprints(sums: list[np.ndarray], window: int) -> np.ndarray:
    """The SimHash of every run of `window` (at most 254) hashes, from their planes: a bit is set if more than half have it."""
    n = len(sums[0]) - window
    if n <= 0:
        return np.empty(0, np.uint64)
    if window > LENGTHS[-1]:
        raise ValueError(f"windows of more than {LENGTHS[-1]} words cannot be counted")
    ones, tops, lift = _U(0x0101010101010101), _U(0x8080808080808080), _U(127 - window // 2)
    out = np.zeros(n, np.uint64)
    for j, s in enumerate(sums):  # differences of the running sums are exact in each field
        out |= ((s[window:] - s[:-window] + ones * lift) & tops) >> _U(7 - j)
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = _mix(out * _U(_BASE) + words[k : k + n])
    return out


class Blocks:
    """A multi-index of fingerprints: what lies within the distance of a given one, none missed."""

    def __init__(self, prints: np.ndarray, distance: int, n_blocks: int) -> None:
        self.prints, self.distance = prints, distance
        width, near = 64 // n_blocks, distance // n_blocks
        if near > 1:
            raise ValueError("a block value is looked up with at most one bit changed")
        self.mask, self.low = _U((1 << width) - 1), _U((1 << min(width, 20)) - 1)
        changes = np.array([0, *(1 << i for i in range(width))] if near else [0], np.uint64)
        self.blocks = []
        for b in range(n_blocks):
            shift = _U(b * width)
            key = (((prints >> shift) & self.mask)[:, None] ^ changes).ravel()
            order = np.argsort(key, kind="stable")
            some = np.zeros(int(self.low) + 1, bool)
            some[key & self.low] = True
            self.blocks.append((shift, key[order], order // len(changes), some))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of prints, indexed row) pairs within the distance, each once."""
        found = [np.empty(0, np.int64)]
        if len(self.prints):
            for shift, keys, rows, some in self.blocks:
                key = (prints >> shift) & self.mask
                at = np.flatnonzero(some[key & self.low])
                low, high = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
                n = high - low
                ends = np.cumsum(n)
                for a, b in _parts_of(ends, 5_000_000):
                    k = n[a:b]
                    left = np.repeat(at[a:b], k)
                    right = rows[np.repeat(low[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                    near = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.distance
                    found.append(left[near] * len(self.prints) + right[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def _parts_of(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes (given by their running sum) add up to about the limit."""
    a = 0
    while a < len(ends):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield a, b
        a = b


class Index:
    """The windows of a slice of items by length, their words, and the weights of their shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]], part: int, distance: int, shingle: int) -> None:
        self.part, self.shingle = part, shingle
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes = np.array([len(w) for _, w in items], np.int64)
        self.words = np.concatenate([w for _, w in items]) if items else np.empty(0, np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        sums = planes(self.words)
        windows: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            length = max((c for c in LENGTHS if c <= n), default=0)
            if length:
                windows.setdefault(length, []).extend((i, o) for o in sorted({*range(0, n - length, LENGTHS[-1]), n - length}))
        #: whether parts, length, item and offset of each window, index
        self.levels = []
        of = np.repeat(np.arange(len(items)), np.maximum(0, self.sizes - part + 1))
        at = np.arange(len(of)) - np.searchsorted(of, of)
        for exact, length, item, offset, d, m in [(True, part, of, at, 0, 1)] + [(False, c, *np.array(w).T, distance, distance // 2 + 1) for c, w in sorted(windows.items())]:
            if len(item):
                self.levels.append((exact, length, item, offset, Blocks(fingerprints(sums, length)[self.first[item] + offset], d, m)))
        # a shingle weighs less the more items have it
        rows = [np.unique(shingles(w, shingle)) for _, w in items]
        every = np.concatenate(rows) if rows else np.empty(0, np.uint64)
        self.known, n = np.unique(every, return_counts=True)
        self.weight = 1.0 / n
        self.low = _U((1 << 20) - 1)
        self.some = np.zeros(1 << 20, bool)
        self.some[self.known & self.low] = True
        self.total = np.array([self.weight[np.searchsorted(self.known, r)].sum() for r in rows])
        self.pairs = np.sort(_mix(every + np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.uint64) * _U(_BASE)))

    def _known(self, every: np.ndarray) -> np.ndarray:
        """The place of each shingle among those that items have, -1 for others."""
        out = np.full(len(every), -1)
        at = np.flatnonzero(self.some[every & self.low])
        place = np.minimum(np.searchsorted(self.known, every[at]), max(0, len(self.known) - 1))
        if len(at):
            out[at] = np.where(self.known[place] == every[at], place, -1)
        return out

    def similarity(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, wanted: np.ndarray | None = None, threshold: float = 0.0) -> np.ndarray:
        """Weighted Jaccard similarity of the shingles of each window [low, high) with those of the whole item.

        A shingle that repeats counts once; one that no item has weighs 1. Windows that are not wanted and cannot reach
        the threshold, as items have too few of their shingles, get 0 without a closer look.
        """
        out = np.zeros(len(low))
        if not len(low):
            return out
        every = shingles(hashes, self.shingle)
        known = self._known(every)
        weight = np.where(known >= 0, self.weight[known], 1.0) if len(self.known) else np.ones(len(every))
        last = np.maximum(low, high - self.shingle + 1)
        most = np.r_[0, np.cumsum(np.where(known >= 0, weight, 0.0))]
        look = (most[np.minimum(last, len(every))] - most[np.minimum(low, len(every))]) >= threshold * self.total[item] - 1e-9
        rows = np.flatnonzero(look if wanted is None else look | wanted)
        n = last[rows] - low[rows]
        # a shingle counts where it has not been in the window before
        inside = np.zeros(len(every) + 1, np.int64)
        np.add.at(inside, low[rows][n > 0], 1)
        np.add.at(inside, last[rows][n > 0], -1)
        used = np.flatnonzero(np.cumsum(inside)[:-1])
        order = used[np.argsort(every[used], kind="stable")]
        before = np.full(len(every), -1)
        same = every[order[1:]] == every[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        for a, b in _parts_of(np.cumsum(n), 1_000_000):
            k, part = n[a:b], rows[a:b]
            row = np.repeat(np.arange(b - a), k)
            at = np.repeat(low[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            once = before[at] < low[part][row]
            row, at = row[once], at[once]
            own = np.flatnonzero(known[at] >= 0)
            code = _mix(every[at[own]] + item[part][row[own]].astype(np.uint64) * _U(_BASE))
            place = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            hit = own[self.pairs[place] == code] if len(own) else own
            shared = np.bincount(row[hit], weight[at[hit]], b - a)
            whole = np.bincount(row, weight[at], b - a) + self.total[item[part]] - shared
            out[part] = np.divide(shared, whole, out=np.zeros(b - a), where=whole > 0)
        return out

    def search(self, hashes: np.ndarray, offsets: np.ndarray, threshold: float) -> list[np.ndarray]:
        """For texts given by word hashes: text, item, item words covered word by word, best similarity."""
        none = np.empty(0, np.int64)
        text, item, begin, part_at = [none], [none], [none], [none]
        longest = max((x[1] for x in self.levels), default=1)
        for a in range(0, len(hashes), PIECE):  # pieces overlap by a window less one word
            piece = hashes[a : a + PIECE + longest - 1]
            sums = planes(piece)
            for exact, length, of_item, offset, blocks in self.levels:
                prints = fingerprints(sums, length)[:PIECE]
                left, right = blocks.candidates(prints)
                at = left + a
                of = np.searchsorted(offsets, at, "right") - 1
                whole = at + length <= offsets[np.minimum(of + 1, len(offsets) - 1)]
                at, right, of = at[whole], right[whole], of[whole]
                start = self.first[of_item[right]] + offset[right]
                if exact:
                    same = np.ones(len(at), bool)
                    for k in range(length):
                        same &= hashes[at + k] == self.words[start + k]
                    at, right, of, start = at[same], right[same], of[same], start[same]
                    part_at.append(offset[right])
                else:
                    part_at.append(np.full(len(at), -1))
                text.append(of)
                item.append(of_item[right])
                begin.append(at - offset[right])
        text, item, begin, part_at = (np.concatenate(v) for v in (text, item, begin, part_at))
        pair = text * max(1, len(self.ids)) + item
        # the best item-sized window of each pair
        margin = int(self.sizes.max(initial=0))
        span = len(hashes) + margin + 1
        places, first = np.unique(pair * span + begin + margin, return_index=True)
        low = np.maximum(begin[first], offsets[text[first]])
        high = np.minimum(begin[first] + self.sizes[item[first]], offsets[text[first] + 1])
        pairs, back = np.unique(places // span, return_inverse=True)
        # words covered by equal parts: each adds what the next one does not cover
        exact = part_at >= 0
        covered = np.zeros(len(pairs), np.int64)
        if exact.any():
            which, where = np.divmod(np.unique(np.searchsorted(pairs, pair[exact]) * (margin + 1) + part_at[exact]), margin + 1)
            step = np.full(len(which), self.part)
            step[:-1] = np.where(which[1:] == which[:-1], np.minimum(self.part, where[1:] - where[:-1]), self.part)
            np.add.at(covered, which, step)
        near = self.similarity(hashes, low, high, item[first], covered[back] > 0, threshold)
        best = np.zeros(len(pairs))
        np.maximum.at(best, back, near)
        keep = (covered > 0) | (best >= threshold)
        return [pairs[keep] // max(1, len(self.ids)), pairs[keep] % max(1, len(self.ids)), covered[keep], best[keep]]


def text_words(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of an Arrow string array as words: first row, row after the last, hashes, offsets."""
    for row, stop, points, offsets in to_points(array):
        if len(points) <= 4 * PIECE:
            yield row, stop, *word_hashes(*canonical(points, offsets))
            continue
        parts, a = [], 0  # one very long text: pieces that end between words
        space = np.flatnonzero((points == 0x20) | (points == 0x0A))
        while a < len(points):
            at = np.searchsorted(space, a + PIECE)
            b = int(space[at]) if at < len(space) else len(points)
            parts.append(word_hashes(*canonical(points[a:b], np.array([0, b - a])))[0])
            a = b
        every = np.concatenate(parts)
        yield row, stop, every, np.array([0, len(every)])


def _slices(items: DataFrame, item_id: str, text: str, part: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with their words, in slices with a bounded number of windows; rows come to the driver a batch at a time."""
    held, size = [], 0
    rows = items.select(item_id, text).where(f"`{item_id}` is not null and `{text}` is not null").orderBy(item_id).toLocalIterator()
    while batch := list(itertools.islice(rows, 1_000)):
        for row, _, hashes, offsets in text_words(pa.array([r[1] for r in batch], pa.string())):
            for k in range(len(offsets) - 1):
                words = hashes[offsets[k] : offsets[k + 1]]
                held.append((batch[row + k][0], words))
                size += max(1, len(words) - part + 1)
                if size >= SLICE_WINDOWS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", part: int = 12, distance: int = 7, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Documents with passages of items: doc_id, item_id, covered_words, item_words, similarity.

    A row is a document that has `part` words in a row of the item, or a window of the item's size that is similar to it
    (weighted Jaccard similarity of runs of `shingle` words, at least the threshold). covered_words is how many words of
    the item stand in equal parts, similarity the best one of an item-sized window among those found. Words are runs of
    letters and digits in consistent form, without case. Null and empty texts are in no row, nor are items of fewer
    words than a part; repeated documents and items give a row each; an empty table gives no rows. Ids are whole numbers.
    distance (at most 7) is the radius of item-sized windows in bits; part is at most 254.
    """
    spark = documents.sparkSession
    schema = f"`{doc_id}` bigint, `{item_id}` bigint, covered_words bigint, item_words bigint, similarity double"
    corpus = documents.select(doc_id, text)

    def against(index) -> DataFrame:  # noqa: ANN001
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in batches:
                for row, _, hashes, offsets in text_words(batch.column(1)):
                    of, item, covered, best = held.search(hashes, offsets, threshold)
                    ids = batch.column(0).cast(pa.int64()).take(pa.array(of + row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(held.ids[item]), pa.array(covered), pa.array(held.sizes[item]), pa.array(best)], names=[doc_id, item_id, "covered_words", "item_words", "similarity"])

        return corpus.mapInArrow(search, schema)

    parts = [against(spark.sparkContext.broadcast(Index(s, part, distance, shingle))) for s in _slices(items, item_id, text, part)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
