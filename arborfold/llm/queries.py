"""Queries over documents: containers, leaked test items, texts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.llm import leaks, packing, textform
from arborfold.plans.cut import Cut
from arborfold.sources.tables import table


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text (or piece of one) for every capacity."""
    rows = table(spark, folder, "documents").select("doc_id", packing.token_count(spark, F.col("text")).alias("tokens"))
    return packing.pack(rows, table(spark, folder, "context_sizes"), "doc_id", "tokens")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of all space that is used, for every capacity."""
    bins = p6_containers(spark, folder).groupBy("size_name", "container").agg(F.sum("tokens").alias("tokens"))
    used = bins.groupBy("size_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("tokens"))
    sizes = table(spark, folder, "context_sizes").select(F.col("size_name").alias("s"), "capacity_tokens")
    return used.join(sizes, F.col("size_name") == F.col("s")).select("size_name", "n_containers", "tokens", (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """What no packing may have, counted for every capacity: overfull or empty containers, pieces of texts that would fit
    whole, texts whose pieces are missing or repeated; and how many texts have a place. The SQL says what must come out."""
    sizes = table(spark, folder, "context_sizes").select(F.col("size_name").alias("s"), F.col("capacity_tokens").cast("bigint").alias("cap"))
    placed = Cut(spark).write(p6_containers(spark, folder).join(F.broadcast(sizes), F.col("size_name") == F.col("s")).drop("s"))
    bins = placed.groupBy("size_name", "cap", "container").agg(F.sum("tokens").alias("filled"))
    over = bins.groupBy("size_name").agg(F.count_if(F.col("filled") > F.col("cap")).alias("n_overfull"))
    texts = placed.groupBy("size_name", "cap", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("tokens").alias("tokens"))
    needless = (F.col("n") > 1) & (F.col("tokens") <= F.col("cap"))
    broken = (F.col("n") != F.col("pieces")) | (F.col("n") != F.col("last") + 1) | (F.col("n") != F.greatest(F.ceil(F.col("tokens") / F.col("cap")), F.lit(1)))
    by_size = texts.groupBy("size_name").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(needless).alias("n_split_needlessly"), F.count_if(broken).alias("n_broken"))
    return by_size.join(over, "size_name").select("size_name", "n_texts", "n_overfull", "n_split_needlessly", "n_broken")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of test items: how many of the item's words they have in equal parts, and how similar the
    closest window of the item's size is. part: whole (0.8 of the words), near (as similar as that, but changed) or part."""
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    part = F.when(F.col("covered_words") >= 0.8 * F.col("item_words"), "whole").when(F.col("similarity") >= 0.8, "near").otherwise("part")
    return found.withColumn("part", part)


def p7_covered(spark: SparkSession, folder: str) -> DataFrame:
    """The exact side of p7_leaks: for pairs with an equal part, the item's words in equal parts and all its words."""
    return p7_leaks(spark, folder).where("covered_words > 0").select("doc_id", "item_id", "covered_words", "item_words")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items that share at least 12 words in a row."""
    return p7_leaks(spark, folder).where("covered_words >= 12").select("doc_id", "item_id")


def p8_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the key of its consistent form and whether that differs from its text."""
    rows = table(spark, folder, "documents").select("doc_id", "text", textform.consistent(F.col("text")).alias("form"))
    return rows.select("doc_id", F.md5("form").alias("form_key"), (F.col("form") != F.col("text")).alias("changed"))


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text_key, form_key of the texts that are neither null nor blank."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    forms = rows.select("doc_id", F.md5("text").alias("text_key"), textform.consistent(F.col("text")).alias("form"))
    seen = F.col("form").rlike(r"[^\s\p{Z}\p{Cc}]")
    keyed = Cut(spark).write(forms.select("doc_id", "text_key", F.md5("form").alias("form_key"), seen.alias("seen")))
    return keyed.where("seen").drop("seen")  # a filter before would compute the forms twice


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with different texts of one consistent form."""
    return textform.look_alike_pairs(_keyed(spark, folder))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a form that several different texts have, with its class."""
    return textform.look_alike_classes(_keyed(spark, folder))


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p6_check, p7_found, p7_leaks, p7_covered, p8_found, p8_classes, p8_consistent)}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_FROM, _TO = "".join(textform.LOOK_ALIKE), "".join(textform.LOOK_ALIKE.values())
#: The consistent form as far as plain SQL replacements give it.
_FORM = rf"""nfc_normalize(translate(translate(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(nfc_normalize(text), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'),
                   '\p{{Zs}}', ' ', 'g'),
    'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'),
    '{_WIDE.replace("'", "''")}‐‑', '{_NARROW.replace("'", "''")}--'), '{_FROM}', '{_TO}'))"""

#: Every run of twelve words, for documents and items.
_RUNS = "select {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as run from (select {id}, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') as w from (select {id}, {form} as form from {table} where text is not null))"

#: The same with the place of each run in the item, and the item's number of words.
_PLACED = "select {id}, n, pos, array_to_string(w[pos:pos + 11], ' ') as run from (select *, len(w) as n, unnest(range(1, len(w) - 10)) as pos from (select {id}, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') as w from (select {id}, {form} as form from {table} where text is not null)))"

SQL = {
    "p6_check": """
        select size_name, (select count(*) from documents where text is not null) as n_texts, 0 as n_overfull, 0 as n_split_needlessly, 0 as n_broken from context_sizes""",
    "p7_covered": f"""
        with d as materialized (select distinct * from ({_RUNS.format(id="doc_id", form=_FORM, table="documents")})), i as materialized ({_PLACED.format(id="item_id", form=_FORM, table="eval_items")}),
        hits as (select distinct doc_id, item_id, n, unnest(range(pos, pos + 12)) as word from d join i using (run))
        select doc_id, item_id, count(*) as covered_words, any_value(n) as item_words from hits group by doc_id, item_id""",
    "p7_found": f"""
        with d as materialized (select distinct * from ({_RUNS.format(id="doc_id", form=_FORM, table="documents")})), i as materialized (select distinct * from ({_RUNS.format(id="item_id", form=_FORM, table="eval_items")}))
        select distinct doc_id, item_id from d join i using (run)""",
    "p8_found": f"""
        with forms as materialized (select doc_id, text, {_FORM} as form from documents where text is not null)
        select a.doc_id as doc_id_a, b.doc_id as doc_id_b from forms a join forms b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text
        where trim(a.form, chr(10) || ' ') <> ''""",
    "p8_classes": f"""
        with forms as materialized (select doc_id, text, {_FORM} as form from documents where text is not null),
        classes as (select form, min(doc_id) as class_id, count(distinct text) as n_texts, count(*) as n_docs from forms where trim(form, chr(10) || ' ') <> '' group by form)
        select doc_id, class_id, n_texts, n_docs from forms join classes using (form) where n_texts > 1""",
}
