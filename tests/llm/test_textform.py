import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from arborfold.llm import queries, textform


def plain(text):
    """The form one character at a time."""
    out = []
    for c in text:
        if (unicodedata.category(c) == "Cf" and ord(c) not in textform.SHOWN) or ord(c) in textform.FILLERS:
            continue
        out.append(" " if unicodedata.category(c) == "Zs" else "-" if c in textform.HYPHENS else textform._shape(c))
    apart = unicodedata.normalize("NFD", "".join(out))
    return unicodedata.normalize("NFC", "".join(textform.LOOK_ALIKE.get(c, c) for c in apart))


ALPHABET = [
    chr(c)
    for c in (*range(0x20, 0x7F), 9, 10, *range(0xA0, 0x180), *range(0x300, 0x345), *range(0x370, 0x400), *range(0x400, 0x460), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0xAC00, 0xAC01, 0xAC1C, *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0x2100, 0x2150), *range(0xFB00, 0xFB50), *range(0xFF01, 0xFFDD), 0x304B, 0x3099, 0x309A, 0x1D15E, 0x0F73)
    if unicodedata.category(chr(c)) != "Cn"
]


def test_arrays_equal_characters():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["", "e" + "́" * 60 + "̣", "́a", "​́", None, "x" * 700_000, "é" * 700_000, "á" * 300_000]
    for array in (pa.array(texts), pa.array(["skipped", *texts], pa.large_string()).slice(1)):
        got = textform.canonical_array(array).to_pylist()
        assert got == [None if t is None else plain(t) for t in texts]
    assert textform.canonical_array(pa.array(got)).to_pylist() == got
    assert textform.canonical_array(pa.array([], pa.string())).to_pylist() == []


def test_what_looks_the_same_and_what_does_not():
    same = [("ﬁne", "fine"), ("Ａｂ１", "Ab1"), ("café", "café"), ("а", "a"), ("a b", "a b"), ("co­op", "coop"), ("a‑b", "a-b"), ("й", "й"), ("﻿x", "x"), ("Ⅳ ⅲ", "IV iii"), ("ĳs", "ijs"), ("νoice", "voice"), ("ᎪᏴ", "AB")]
    differ = [("x²", "x2"), ("A", "a"), ("e", "é"), ("a\nb", "a b"), ("—", "-"), ("œ", "oe"), ("a.", "a"), ("…", "..."), ("𝐀", "A"), ("ⓐ", "a"), ("β", "b")]
    form = lambda x: textform.canonical_array(pa.array([x])).to_pylist()[0]
    assert all(form(a) == form(b) for a, b in same)
    assert all(form(a) != form(b) for a, b in differ)


def test_column_and_pairs(spark):
    rows = [(1, "fine"), (2, "ﬁne"), (3, "fine"), (4, None), (5, ""), (6, " "), (7, " "), (8, "Fine"), (9, "f​ine")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, form string")
    forms = df.select("doc_id", "text", textform.consistent(F.col("text")).alias("f"))
    assert {r["doc_id"]: r["f"] for r in forms.collect()} == {1: "fine", 2: "fine", 3: "fine", 4: None, 5: "", 6: " ", 7: " ", 8: "Fine", 9: "fine"}
    pairs = textform.look_alike_pairs(forms.where("trim(f) <> ''").select("doc_id", F.col("text").alias("text_key"), F.col("f").alias("form_key")))
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9)}
    classes = textform.look_alike_classes(forms.where("trim(f) <> ''").select("doc_id", F.col("text").alias("text_key"), F.col("f").alias("form_key")))
    assert {tuple(r) for r in classes.collect()} == {(i, 1, 3, 4) for i in (1, 2, 3, 9)}


def test_found_leaves_out_blank_texts(spark, tmp_path):
    rows = [(1, "ab c"), (2, "аb c"), (3, " "), (4, " "), (5, None), (6, ""), (7, "​")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in queries.p8_found(spark, str(tmp_path)).collect()} == {(1, 2)}
