"""Scalar functions of names, ids, dates and URLs as column expressions.

Only the general fold of accents needs Python; everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a name that are no name.
NAME_STOP = ("sensei", "shihan", "shidoin", "fukushidoin", "kaicho", "doshu", "jr", "sr", "ii", "iii", "iv", "dr", "mr", "mrs", "ms")
#: Header words and the category they stand for; the first that is contained decides.
CATEGORIES = (
    ("attack", "attack"), ("grab", "attack"), ("strike", "attack"), ("hold", "attack"),
    ("technique", "technique"), ("throw", "technique"), ("pin", "technique"), ("control", "technique"),
    ("direction", "direction"), ("stance", "form"), ("posture", "form"), ("position", "form"), ("step", "form"),
    ("weapon", "weapon"), ("count", "count"), ("number", "count"), ("practice", "practice"), ("exercise", "practice"),
    ("body", "body"), ("general", "general"), ("term", "general"),
)


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()

    return s.map(one)


def fold(c: Column) -> Column:
    """Compatibility form without combining marks, lower case, trimmed; ASCII texts skip Python."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.trim(F.lower(c))).otherwise(_folded(c))


#: Letters that fold_latin maps; each of the second string stands for the one above it.
_ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšťùúûüūůűýÿžźż"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorrsstuuuuuuuyyzzz"


def fold_latin(c: Column) -> Column:
    """``fold`` for Latin letters with one accent, without leaving the JVM."""
    return F.trim(F.translate(F.lower(c), _ACCENTED, _PLAIN))


def slug(folded: Column) -> Column:
    """Runs of other than a-z0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "-"), "^-|-$", "")


def entity_id(kind: str, name: Column) -> Column:
    """``kind:slug``; null for a name without letters or digits."""
    s = slug(fold(name))
    return F.when(s != "", F.concat(F.lit(f"{kind}:"), s))


def bare(id_or_name: Column) -> Column:
    """An id without its kind, a name as slug."""
    return F.when(id_or_name.contains(":"), F.substring_index(id_or_name, ":", -1)).otherwise(slug(fold(id_or_name)))


def rank_id(person: Column, date: Column, dan: Column) -> Column:
    return F.concat(F.lit("rank:"), F.concat_ws("+", bare(person), date, dan.cast("string")))


def tenure_id(person: Column, dojo: Column, start: Column) -> Column:
    return F.concat(F.lit("tenure:"), F.concat_ws("+", bare(person), bare(dojo), F.coalesce(start.cast("string"), F.lit("unknown"))))


def edge_id(student: Column, teacher: Column) -> Column:
    return F.concat(F.lit("edge:"), F.concat_ws("+", bare(student), bare(teacher)))


def squeezed(c: Column) -> Column:
    """Folded, a-z0-9 only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def name_tokens(folded: Column) -> Column:
    """Words of a folded name without honorifics."""
    parts = F.split(F.regexp_replace(folded, "[^a-z0-9 ]", " "), " +")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*NAME_STOP))


def clean_name(c: Column) -> Column:
    """Without parenthesised notes, stars and outer blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"\*", ""))


def split_names(c: Column) -> Column:
    """Parts between commas, `and` and `&`."""
    return F.filter(F.transform(F.split(c, r",|\s+and\s+|\s+&\s+"), lambda x: F.trim(x)), lambda x: x != "")


def year_of(c: Column) -> Column:
    """Digits only as an integer, else null; digits beyond ASCII count as no year."""
    text = c.cast("string")
    return F.when(text.rlike("^[0-9]{1,9}$"), text).cast("int")


def year_date(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-01-01"))


def dan_of(c: Column) -> Column:
    """The rank from 1 to 10 that a text like `6th dan` names, else null."""
    n = F.regexp_extract(c, r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s*dan\b", 1)
    dan = F.when(n != "", n).cast("int")
    return F.when(dan.between(1, 10), dan)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def content_hash(text: Column, mark: str) -> Column:
    """Twelve hex digits of a text without its footers (lines `_mark ..._`) and outer white space."""
    body = F.regexp_replace(text, rf"(?md)^_{mark}\b.*_\s*$", "")
    return F.substring(F.sha2(stripped(body), 256), 1, 12)


def stripped(text: Column) -> Column:
    """Without white space at the ends, Unicode's and the four separators 0x1C to 0x1F."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def footer_name(text: Column, mark: str) -> Column:
    """The name in the first footer, else null."""
    name = F.regexp_extract(text, rf"(?d)_{mark} · (.+?) · rev", 1)
    return F.when(name != "", stripped(name))


def footer_date(text: Column) -> Column:
    """The date behind `rev`, with or without a number, else null."""
    date = F.regexp_extract(text, r"rev (?:\d+ · )?(\d{4}-\d{2}-\d{2})", 1)
    return F.when(date != "", date)


def display_name(text: Column, path: Column, mark: str) -> Column:
    """The footer's name, else the file's, without its ending and what its first two underscores part off, underscores as spaces."""
    stem = F.regexp_replace(F.regexp_extract(path, r"(?s)([^/]*)/*$", 1), r"(?s)(?<=.)\.[^.]+$", "")
    parts = F.split(stem, "_", 3)
    return F.coalesce(footer_name(text, mark), F.replace(F.element_at(parts, -1), F.lit("_"), F.lit(" ")))


def raster_links(text: Column) -> Column:
    """Markdown links to .svg files as links to .png files."""
    return F.regexp_replace(text, r"(\]\([^)]+?)\.svg\)", "$1.png)")


def tenths(c: Column) -> Column:
    """A double from 0 to 900 to one decimal by its exact binary value; exact halves go to the even digit.

    Scaled by a power of two that leaves no fraction, so that ten times it is exact in 64 bits.
    """

    def at(bits: int) -> Column:
        ten = (c * float(1 << bits)).cast("long") * 10
        whole, rest, half = F.shiftright(ten, bits), ten.bitwiseAND((1 << bits) - 1), 1 << (bits - 1)
        return (whole + ((rest > half) | ((rest == half) & (whole % 2 == 1))).cast("int")) / 10.0

    return F.when(c < 1, at(58)).when(c < 16, at(52)).otherwise(at(48))


def script_of(c: Column) -> Column:
    """ja if as many kana and kanji as Latin letters and any, en if more Latin letters, else other."""
    cjk, latin = F.regexp_count(c, F.lit(r"[぀-ヿ一-鿿]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when((cjk > 0) & (cjk >= latin), "ja").when(latin > cjk, "en").otherwise("other")


def category_of(header: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, category in reversed(CATEGORIES):
        out = F.when(F.lower(header).contains(word), category).otherwise(out)
    return out


def range_label(low: Column, high: Column) -> Column:
    return F.concat(low.cast("string"), F.lit("-"), F.coalesce(high.cast("string"), F.lit("ongoing")))


def box_union(a: Column, b: Column) -> Column:
    """Of boxes (x, y, w, h) as structs."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    right, low = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"])
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"))


def page_title(href: Column) -> Column:
    """The last part of a path as a title: percent signs decoded, underscores as blanks; a plus stays a plus."""
    last = F.substring_index(F.substring_index(href, "#", 1), "/", -1)
    return F.translate(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), "_", " ")


def page_ranges(spec: Column, total: Column | None = None) -> Column:
    """`12,40-55` as an array of page numbers, in order; with ``total`` those from 1 to it."""
    parts = F.filter(F.split(spec, r"\s*,\s*"), lambda x: x.rlike(r"^\s*\d+(\s*-\s*\d+)?\s*$"))
    ends = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "-", 1)).cast("int").alias("a"), F.trim(F.substring_index(x, "-", -1)).cast("int").alias("b")))
    pages = F.flatten(F.transform(F.filter(ends, lambda e: e["a"] <= e["b"]), lambda e: F.sequence(e["a"], e["b"])))
    return pages if total is None else F.filter(pages, lambda p: (p >= 1) & (p <= total))


def kineme(articulator: Column, side: Column, verb: Column, magnitude: Column, effort: Column) -> Column:
    """`art.side : verb/mag :: effort`; the side only if L or R, absent parts left out."""
    who = F.when(side.isin("L", "R"), F.concat(articulator, F.lit("."), side)).otherwise(articulator)
    return F.concat_ws(" :: ", F.concat_ws(" : ", who, F.concat_ws("/", verb, magnitude)), effort)
