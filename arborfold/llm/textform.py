"""One consistent form for texts that look the same, computed on code-point arrays.

A batch of Arrow strings becomes one array of code points with document offsets. Lookup tables give each code point its
form; removals and expansions are offsets; letters with following marks are decomposed, reordered and composed for all
such places at once. No string function is called per row.

Equal in the result: full-width and half-width forms, composed and separate accents, invisible characters (removed),
kinds of blank (a space), look-alike letters of other scripts (Latin), joined letters (their parts), kinds of hyphen.
Kept apart: everything else, such as letter case, accents, punctuation, raised digits, line breaks, and letters whose
style shows (bold, italic or circled ones).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts and the Latin letters that they look like.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ү": "Y",
    # Greek
    "ο": "o", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "Օ": "O", "հ": "h", "ս": "u", "ո": "n", "ց": "g", "զ": "q", "յ": "j",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y",
    "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
}
# Kinds of hyphen besides the full-width one.
HYPHENS = "‐‑﹣"
# Characters without a sign of their own that are no format characters.
FILLERS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
# Format characters that do show (number signs and the like).
SHOWN = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)

LIMIT = 0x110000
CHUNK = 500_000
# Letters joined to one character, such as ligatures, digraphs and Roman numerals (their parts are in the Unicode data).
JOINED = (*range(0xFB00, 0xFB18), 0x0132, 0x0133, *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), *range(0x2160, 0x2180))
#: Decompositions that only tell how a character is drawn: widths, and shapes of joined letters.
_SHAPES = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
_KEEP, _ONE, _NONE, _MANY, _MARK = 0, 1, 2, 3, 4
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _shape(ch: str) -> str:
    """ch, or what it is a width, joined form or ligature of."""
    tag, _, parts = unicodedata.decomposition(ch).partition(" ")
    if tag in _SHAPES or tag == "<compat>" and ord(ch) in JOINED:
        text = "".join(chr(int(x, 16)) for x in parts.split())
        if not text.startswith(" "):
            return "".join(map(_shape, text))
    return ch


class _Tables:
    """Lookup tables over all code points, built from the rules above."""

    def __init__(self) -> None:
        self.kind = np.zeros(LIMIT, np.uint8)
        self.one = np.arange(LIMIT, dtype=np.uint32)
        self.ccc = np.zeros(LIMIT, np.uint8)
        self.look = np.arange(LIMIT, dtype=np.uint32)
        self.apart: dict[int, list[int]] = {}
        many: dict[int, list[int]] = {}
        pairs: list[tuple[int, int, int]] = []
        for a, b in LOOK_ALIKE.items():
            self.look[ord(a)] = ord(b)
        hidden = set(FILLERS)
        for cp in (*range(0x80, 0x32000), *range(0xE0000, 0xE0200)):
            if 0x3400 <= cp < 0xA000 or _S <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900 or 0x17000 <= cp < 0x1D000:
                continue  # ideographs, syllables, surrogates and private use have forms of their own
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind == "Cf" and cp not in SHOWN or cp in hidden:
                self.kind[cp] = _NONE
                continue
            if kind == "Zs":
                self.kind[cp], self.one[cp] = _ONE, 0x20
                continue
            if ccc := unicodedata.combining(ch):
                self.ccc[cp], self.kind[cp] = ccc, _MARK
            shaped = "-" if ch in HYPHENS else _shape(ch)
            apart = unicodedata.normalize("NFD", shaped)
            form = unicodedata.normalize("NFC", "".join(chr(self.look[ord(x)]) for x in apart))
            if apart != ch:
                self.apart[cp] = list(map(ord, apart))
            split = unicodedata.decomposition(ch)
            if split and split[0] != "<" and len(split.split()) == 2 and unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch)) == ch:
                pairs.append((*(int(x, 16) for x in split.split()), cp))
            if self.kind[cp] == _MARK and (len(apart) > 1 or apart == ch):
                continue
            if unicodedata.combining(form[0]):
                self.kind[cp] = _MARK
            elif form != ch:
                self.kind[cp] = _ONE if len(form) == 1 else _MANY
                if len(form) == 1:
                    self.one[cp] = ord(form)
                else:
                    many[cp] = list(map(ord, form))
        for _, second, _ in pairs:
            self.kind[second] = _MARK
        self.kind[0x1161:0x1176] = self.kind[0x11A8:0x11C3] = _MARK
        self.many_cp = np.array(sorted(many), np.uint32)
        self.many_len = np.array([len(many[c]) for c in sorted(many)], np.int64)
        self.many = np.array([many[c] + [0] * (self.many_len.max() - len(many[c])) for c in sorted(many)], np.uint32)
        pairs.sort()
        self.pair = np.array([a << 21 | b for a, b, _ in pairs], np.int64)
        self.pair_to = np.array([c for _, _, c in pairs], np.uint32)

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composed code points of the pairs, 0 where there is none."""
        key = a.astype(np.int64) << 21 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        out = np.where(self.pair[at] == key, self.pair_to[at], 0).astype(np.int64)
        x, y = a.astype(np.int64), b.astype(np.int64)
        lv = (x >= _L) & (x < _L + 19) & (y >= _V) & (y < _V + 21)
        out = np.where(lv, _S + ((x - _L) * 21 + (y - _V)) * 28, out)
        lvt = (x >= _S) & (x < _S + 11172) & ((x - _S) % 28 == 0) & (y > _T) & (y < _T + 28)
        return np.where(lvt, x + y - _T, out).astype(np.uint32)


@functools.cache
def tables() -> _Tables:
    return _Tables()


def _expand(points: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """points with each repeated counts times; the new offsets; where each one now starts."""
    ends = np.cumsum(counts)
    starts = ends - counts
    return np.repeat(points, counts), np.r_[0, ends][offsets], starts


def canonical(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of texts given as code points and offsets (n + 1 of them)."""
    t = tables()
    kind = t.kind[points]
    if not kind.any():
        return points, offsets
    points = t.one[points] if (kind == _ONE).any() else points
    if ((kind == _NONE) | (kind == _MANY)).any():
        many = np.flatnonzero(kind == _MANY)
        row = np.searchsorted(t.many_cp, points[many])
        counts = (kind != _NONE).astype(np.int64)
        counts[many] = t.many_len[row]
        points, offsets, starts = _expand(points, offsets, counts)
        for j in range(t.many.shape[1]):
            on = t.many_len[row] > j
            points[starts[many[on]] + j] = t.many[row[on], j]
        kind = t.kind[points]
    if (kind == _MARK).any():
        points, offsets = _compose_marks(t, points, offsets, kind == _MARK)
    return points, offsets


def _compose_marks(t: _Tables, points: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first_of_text = np.zeros(len(points) + 1, bool)
    first_of_text[offsets] = True
    head = ~mark | first_of_text[:-1]
    with_marks = np.zeros(len(points), bool)  # heads that marks follow
    with_marks[:-1] = head[:-1] & ~head[1:]
    with_marks |= head & mark  # a text that starts with a mark
    group_of_head = np.cumsum(with_marks) - 1
    member = with_marks | ~head
    at = np.flatnonzero(member)
    if not len(at):
        return points, offsets
    group = group_of_head[at]
    heads = np.flatnonzero(with_marks)
    # decompose the members of all groups
    seen, back = np.unique(points[at], return_inverse=True)
    parts = [t.apart.get(int(c), [int(c)]) for c in seen]
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.array([c for p in parts for c in p], np.uint32)
    first = np.cumsum(sizes) - sizes
    n = sizes[back]
    start = np.cumsum(n) - n
    ch = flat[np.repeat(first[back], n) + np.arange(n.sum()) - np.repeat(start, n)]
    g = np.repeat(group, n)
    ccc = t.ccc[ch].astype(np.int64)
    order = np.lexsort((ccc, np.cumsum(ccc == 0), g))  # stable: canonical order of the marks
    ch, ccc = t.look[ch[order]], ccc[order]
    lengths = np.bincount(g, minlength=len(heads))
    base = np.cumsum(lengths) - lengths
    alive = np.ones(len(ch), bool)
    starter, last = base.copy(), np.where(ccc[base] > 0, 255, 0)
    can_start = ccc[base] == 0
    for j in range(1, int(lengths.max())):
        on = np.flatnonzero(lengths > j)
        i = base[on] + j
        c, cc = ch[i], ccc[i]
        free = can_start[on] & np.where(cc == 0, last[on] == 0, last[on] < cc)
        to = t.compose(ch[starter[on]], c)
        joined = free & (to > 0)
        ch[starter[on[joined]]] = to[joined]
        alive[i[joined]] = False
        rest, r = on[~joined], i[~joined]
        new = ccc[r] == 0
        starter[rest[new]], can_start[rest[new]], last[rest[new]] = r[new], True, 0
        last[rest[~new]] = ccc[r[~new]]
    counts = np.ones(len(points), np.int64)
    counts[at] = 0
    left = np.bincount(g[alive], minlength=len(heads))
    counts[heads] = left
    points, offsets, starts = _expand(points, offsets, counts)
    kept = g[alive]
    where = np.cumsum(left) - left
    points[starts[heads][kept] + np.arange(len(kept)) - where[kept]] = ch[alive]
    return points, offsets


def to_points(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of an Arrow string array: first row, row after the last, code points, offsets. Nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type)
    ends = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2] if len(array) else None
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(array):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
        part, offsets = raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        if len(part) and part.max() >= 0x80:
            lead = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]
            points, offsets = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[offsets]
        else:
            points = part.astype(np.uint32)
        yield row, stop, points, offsets
        row = stop


def to_arrow(points: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
    """Code points and offsets as an Arrow string array, null where null is true."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) == len(points):
        ends = offsets
    else:
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.r_[0, np.cumsum(size)][offsets]
    valid = pa.array(~null).buffers()[1] if null.any() else None
    return pa.LargeStringArray.from_buffers(len(null), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data), valid)


def canonical_array(array: pa.Array) -> pa.Array:
    """The consistent form of every string of an Arrow array; null stays null."""
    null = array.is_null().to_numpy(zero_copy_only=False)
    out = [to_arrow(*canonical(points, offsets), null[row:stop]) for row, stop, points, offsets in to_points(array)]
    return pa.chunked_array(out, pa.large_string()).combine_chunks().cast(pa.string()) if out else pa.array([], pa.string())


@functools.cache
def _udf():
    @F.arrow_udf(StringType())
    def form(text: pa.Array) -> pa.Array:
        return canonical_array(text)

    return form


def consistent(text: Column) -> Column:
    """The consistent form of a text column. ASCII texts are their own form and stay in the JVM; null stays null."""
    return F.coalesce(_udf()(F.when(F.octet_length(text) != F.char_length(text), text)), text)


def look_alike_pairs(keyed: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of rows (doc_id, text_key, form_key) with one form and different texts, the smaller id first.

    Only forms that several different texts have take part. Texts are paired first, then the copies of each text, so no
    two copies of one text ever meet, however many there are.
    """
    mixed = keyed.groupBy("form_key").agg((F.min("text_key") != F.max("text_key")).alias("mixed")).where("mixed").select("form_key")
    kept = keyed.join(mixed, "form_key", "left_semi")
    texts = kept.select("form_key", "text_key").distinct()
    pairs = texts.join(texts.withColumnRenamed("text_key", "other_key"), "form_key").where("text_key < other_key").select("text_key", "other_key")
    copies = kept.select("text_key", "doc_id")
    first = pairs.join(copies, "text_key").select("other_key", F.col("doc_id").alias("one"))
    both = first.join(copies.withColumnRenamed("text_key", "other_key"), "other_key").where("one <> doc_id")
    return both.select(F.least("one", "doc_id").alias("doc_id_a"), F.greatest("one", "doc_id").alias("doc_id_b")).distinct()


def look_alike_classes(keyed: DataFrame) -> DataFrame:
    """doc_id, class_id, n_texts, n_docs for rows (doc_id, text_key, form_key) of forms that several different texts have.

    One row per document instead of all pairs: class_id is the smallest doc_id of the form.
    """
    texts = keyed.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
    classes = texts.groupBy("form_key").agg(F.min("_first").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("_n").alias("n_docs"))
    return keyed.join(classes.where("n_texts > 1"), "form_key").select("doc_id", "class_id", "n_texts", "n_docs")
