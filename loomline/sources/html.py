"""Texts, links and labelled fields of HTML pages.

Pages are often not well-formed, so they are read by a tolerant event parser in
Arrow batches; what follows from lines and fields is native.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.scalars import slug
from loomline.operators.lines import BREAKS

SILENT = frozenset(("script", "style", "noscript"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def _structs(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


class _Reader(HTMLParser):
    """Collects text pieces, links, and cells with the tags they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.silent: str | None = None
        self.texts: list[str] = []
        self.links: list[list] = []
        self.open_link: list | None = None
        self.fields: list[list] = []  # tag, class, text, href
        self.open_fields: list[list] = []

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        if tag in SILENT:
            self.silent = tag
            return
        a = dict(attrs)
        if tag == "a":
            self.open_link = [a.get("href"), []] if a.get("href") is not None else None
            if self.open_link:
                self.links.append(self.open_link)
                for f in self.open_fields:
                    f[3] = f[3] or a["href"]
        if tag == "br":
            for f in self.open_fields:
                f[2].append("\n")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "th", "td", "li", "p", "div", "strong"):
            if tag in ("dt", "dd", "th", "td", "p"):
                self.open_fields = [f for f in self.open_fields if f[0] not in ("dt", "dd", "th", "td", "p")]
            f = [tag, a.get("class") or "", [], None]
            self.fields.append(f)
            self.open_fields.append(f)

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent:
                self.silent = None
            return
        if tag == "a":
            self.open_link = None
        for k in range(len(self.open_fields) - 1, -1, -1):
            if self.open_fields[k][0] == tag:
                del self.open_fields[k:]
                break

    def handle_data(self, data):
        if self.silent:
            return
        self.texts.append(data)
        if self.open_link:
            self.open_link[1].append(data)
        for f in self.open_fields:
            f[2].append(data)


def read(html: str | None) -> _Reader:
    reader = _Reader()
    if html:
        reader.feed(html)
        reader.close()
    return reader


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Text pieces, trimmed, one to a line; scripts and styles left out."""
    return html.map(lambda h: None if h is None else "\n".join(t.strip() for t in read(h).texts if t.strip()))


@F.pandas_udf(_structs("href", "text"))
def html_links(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{"href": href, "text": " ".join("".join(t).split())} for href, t in read(h).links])


@F.pandas_udf(_structs("tag", "class", "text", "href"))
def html_fields(html: pd.Series) -> pd.Series:
    """Headings, cells, terms and blocks in document order, with their first link."""
    return html.map(lambda h: [{"tag": f[0], "class": f[1], "text": "".join(f[2]).strip(), "href": f[3]} for f in read(h).fields])


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b or "", h or "").split("#")[0]
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


#: What a link to a page about teachers holds.
HINT = r"(?i)instructor|sensei|teacher|about|staff|faculty|dojo[- ]?cho"


def hint_links(pages: DataFrame, key: str, url: str, html: str, hint: str = HINT, most: int = 2) -> DataFrame:
    """(key, n, link): links of a page to its own host that hint at teachers, distinct, the first ``most``."""
    links = pages.select(key, url, F.posexplode(html_links(html)).alias("at", "a")).filter(F.col("a.href").rlike(hint) | F.col("a.text").rlike(hint))
    full = links.withColumn("link", absolute(F.col(url), F.col("a.href")))
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    own = full.filter((host(F.col("link")) == host(F.col(url))) & (strip(F.col("link")) != strip(F.col(url))))
    first = own.groupBy(key, "link").agg(F.min("at").alias("at"))
    return first.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("at"))).filter(F.col("n") <= most).select(key, "n", "link")


#: Patterns of a name and of what stands beside a teacher's.
_NAME = r"[A-Z][a-zA-Z'’.\-]+(?:\s+[A-Z][a-zA-Z'’.\-]+){1,2}"
#: Words that are in no personal name.
NOT_NAME = (
    "aikido", "aikikai", "dojo", "sensei", "shihan", "shidoin", "fukushidoin",
    "federation", "association", "alliance", "ki", "society", "school", "schools",
    "martial", "arts", "class", "classes", "children", "youth", "adult", "home",
    "about", "contact", "schedule", "privacy", "copyright", "instructor", "instructors",
    "dan", "kyu", "cho", "project", "legacy", "center", "centre", "club", "hombu",
    "welcome", "rights", "reserved", "the", "and", "our", "main", "head", "chief",
)
#: What a name in a directory looks like.
DIRECTORY_NAME = r"^[A-Z][A-Za-z.'\-]*(?:\s+[A-Za-z.'\-]+){0,4}$"
_CHIEF = rf"(?i)(?:Chief|Head|Founding|Dojo[- ]?cho)\s+Instructor[:,\s]+({_NAME})\b"
_OTHERS = (rf"\b({_NAME})\s+Sensei\b", rf"\bSensei\s+({_NAME})\b", rf"\b({_NAME}),?\s+\d(?:st|nd|rd|th)\s+[Dd]an\b")


def looks_like_name(c: Column, stop: tuple[str, ...] = NOT_NAME) -> Column:
    """Two or three capitalised words or initials, two words at least, none of ``stop``."""
    parts = F.filter(F.transform(F.split(c, r"\s+"), lambda t: F.trim(F.regexp_replace(t, r"^\.+|\.+$", ""))), lambda t: t != "")
    word = lambda t: t.rlike("^[A-Z][a-z]+$")
    fine = F.forall(parts, lambda t: (word(t) & ~F.coalesce(slug(t).isin(*(stop or ("",))), F.lit(False))) | t.rlike("^[A-Z]$"))
    return F.size(parts).between(2, 3) & fine & (F.size(F.filter(parts, word)) >= 2)


def instructors(pages: DataFrame, key: str, html: str, stop: tuple[str, ...] = NOT_NAME) -> DataFrame:
    """(key, name, role) from lines of at most 160 characters; chief beats instructor."""
    lines = pages.select(key, F.explode(F.split(html_to_text(html), BREAKS)).alias("line")).withColumn("line", F.trim("line")).filter(F.length("line").between(1, 160))
    chief = F.transform(F.regexp_extract_all("line", F.lit(_CHIEF)), lambda n: F.struct(n.alias("name"), F.lit(1).alias("rank")))
    others = F.transform(F.concat(*(F.regexp_extract_all("line", F.lit(p)) for p in _OTHERS)), lambda n: F.struct(n.alias("name"), F.lit(0).alias("rank")))
    found = lines.select(key, F.inline(F.concat(chief, others))).filter(looks_like_name(F.col("name"), stop))
    return found.groupBy(key, "name").agg(F.max("rank").alias("rank")).select(key, "name", F.when(F.col("rank") == 1, "chief").otherwise("instructor").alias("role"))


def directory_name(c: Column) -> Column:
    """A name of a directory entry without its parentheses, if it looks like one, else null."""
    name = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    return F.when(name.rlike(DIRECTORY_NAME), name)


def labelled(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, record, label, text, href) of dt/dd and th/td pairs; a heading of level 3 opens a record."""
    rows = pages.select(key, F.posexplode(html_fields(html)).alias("at", "f")).select(key, "at", "f.*")
    over = W.partitionBy(key).orderBy("at")
    rows = rows.withColumns({
        "record": F.sum((F.col("tag") == "h3").cast("int")).over(over),
        "heading": F.last(F.when(F.col("tag") == "h3", F.col("text")), ignorenulls=True).over(over),
        "label": F.last(F.when(F.col("tag").isin("dt", "th"), F.lower("text")), ignorenulls=True).over(over),
    })
    return rows.filter("tag in ('dd', 'td') and label is not null").select(key, "record", "heading", "label", "at", "text", "href")
