"""Glossary terms from web pages, from page layout and from corrections."""

from __future__ import annotations

import html as markup

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.scalars import category_of

#: What a term in Latin letters looks like; words of headings that stand before one by mistake; the kanji at the start of an entry; kana alone.
ROMAJI = r"^[A-Za-z][A-Za-z'./()\- ]{1,34}$"
LEADING = r"(?i)^(attacks?|techniques?|directions?|stances?|weapons?|counting|general|practice|body|terms?)\s+"
KANJI, KANA = r"^[\s　]*([぀-ヿ㐀-鿿々]+(?:[\s　][぀-ヿ㐀-鿿々]+)*)", r"^[぀-ヿ]+$"
HEADING, ENTRY = r"(?s)^<h[1-6][^>]*>(.*?)</h[1-6]>", r"(?s)^<strong>\s*(.*?)\s*</strong>\s*(?:&#8211;|&#8212;|–|—|-)\s*(.*?)$"
ROWS = r"(?s)(<h[1-6][^>]*>.*?</h[1-6]>|<strong>\s*.*?\s*</strong>\s*(?:&#8211;|&#8212;|–|—|-)\s*.*?(?=<br|</p))"
FULL = r"^\s*([^():：]*?)\s*(?:（|\()([^）)]*)(?:）|\))\s*[:：]\s*(.*)$"


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Character references as characters; of short texts."""
    return s.map(lambda x: None if x is None else markup.unescape(x))


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def _plain(c: Column) -> Column:
    return F.trim(unescaped(F.regexp_replace(c, "<[^>]+>", "")))


def html_terms(pages: DataFrame, key: str, html: str, source: str) -> DataFrame:
    """(key, at, romaji, kanji, kana, english, category, source) of bold terms with a dash; headings set the category of what follows."""
    clean = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(ROWS))).alias("at", "m"))
    head = F.when(F.col("m").rlike(HEADING), category_of(F.regexp_replace(F.regexp_extract("m", HEADING, 1), "<[^>]+>", "")))
    rows = rows.withColumn("category", F.last(head, ignorenulls=True).over(W.partitionBy(key).orderBy("at"))).filter(~F.col("m").rlike(HEADING))
    rows = rows.select(key, "at", "category", _plain(F.regexp_extract("m", ENTRY, 1)).alias("r"), _plain(F.regexp_extract("m", ENTRY, 2)).alias("rest")).withColumn("romaji", F.trim(F.regexp_replace("r", LEADING, "")))
    rows = rows.filter(F.col("romaji").rlike(ROMAJI) & (_words(F.col("romaji")) <= 5) & (F.col("rest") != ""))
    full, parts = F.col("rest").rlike(FULL), F.split("rest", "[:：]", 2)
    of = lambda i, other: F.when(full, F.regexp_extract("rest", FULL, i)).otherwise(other)
    tight = lambda c: F.regexp_replace(c, "[ 　]", "")
    rows = rows.withColumns({"k": of(1, F.get(parts, 0)), "n": of(2, F.lit("")), "e": F.trim(of(3, F.coalesce(F.get(parts, 1), F.lit(""))))})
    kanji, kana = tight(F.regexp_extract("k", KANJI, 1)), tight(F.regexp_replace("n", r"\[.*", ""))
    none = F.array().cast("array<string>")
    return rows.select(
        key, "at", "romaji", F.when(kanji != "", F.array(kanji)).otherwise(none).alias("kanji"), F.when(kana.rlike(KANA), F.array(kana)).otherwise(none).alias("kana"),
        F.nullif("e", F.lit("")).alias("english"), "category", F.lit(source).alias("source"),
    )


def layout_terms(lines: DataFrame, key: str, source: str) -> DataFrame:
    """Terms of ``lines(key, line_no, line)`` in columns: cells apart by two blanks or more, in pairs of a term and what it means."""
    cells = F.filter(F.transform(F.split(F.trim("line"), r"\s{2,}"), lambda c: F.trim(c)), lambda c: c != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.struct(F.get("c", i * 2).alias("term"), F.get("c", i * 2 + 1).alias("meaning")))
    rows = lines.withColumn("c", cells).filter("size(c) >= 2").select(key, "line_no", F.posexplode(pairs).alias("at", "p")).select(key, "line_no", "at", "p.*")
    rows = rows.withColumn("category", F.last(category_of(F.col("term")), ignorenulls=True).over(W.partitionBy(key).orderBy("line_no", "at")))
    good = F.col("term").rlike(ROMAJI) & (_words(F.col("term")) <= 4) & F.col("meaning").rlike("[A-Za-z]") & (F.length("meaning") > 3)
    none = F.array().cast("array<string>")
    return rows.filter(good).select(
        key, "line_no", "at", F.trim(F.regexp_replace("term", r"^\d+[.)]\s*", "")).alias("romaji"), none.alias("kanji"), none.alias("kana"), F.col("meaning").alias("english"), "category", F.lit(source).alias("source"),
    )


def spellings(terms: DataFrame, taught: DataFrame | None = None) -> DataFrame:
    """(at, kanji, romaji, english): every spelling of a term with a meaning, longest first, then as stored.

    taught(seq, status, romaji, english, kanji) are corrections that aren't retired;
    their spellings stand behind the stored ones of their length.
    """
    kept = F.coalesce(F.col("english"), F.lit("")) != ""
    own = terms.filter(kept).select(F.lit(0).alias("later"), F.col("seq").cast("long").alias("seq"), F.posexplode("kanji").alias("i", "kanji"), "romaji", "english")
    if taught is not None:
        active = taught.filter(F.coalesce(F.col("status"), F.lit("")) != "retired").filter(kept)
        own = own.unionByName(active.select(F.lit(1).alias("later"), F.col("seq").cast("long").alias("seq"), F.posexplode("kanji").alias("i", "kanji"), F.coalesce("romaji", F.lit("")).alias("romaji"), "english"))
    return own.filter("kanji <> ''").orderBy(-F.length("kanji"), "later", "seq", "i").select("kanji", "romaji", "english")


def histograms(terms: DataFrame) -> DataFrame:
    """(what, value, n): terms by category and by source, and how many have kanji and a meaning."""
    count = lambda what, value, df: df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")
    known = terms.agg(F.count_if(F.size("kanji") > 0).alias("kanji"), F.count_if(F.coalesce(F.col("english"), F.lit("")) != "").alias("english"))
    totals = known.select(F.inline(F.array(*(F.struct(F.lit("with").alias("what"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in ("kanji", "english")))))
    return count("category", F.col("category"), terms).unionByName(count("source", F.col("s"), terms.withColumn("s", F.explode("sources")))).unionByName(totals)
