"""Records of places and persons from directory pages and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.scalars import entity_id, split_names
from loomline.operators.lines import BREAKS, split_location
from loomline.sources.html import html_fields, labelled

#: How labels of the directories begin or what they hold.
CHIEF, ADDRESS, WEBSITE = r"^(chief|instructors$|head)", "address|location", "^web"
#: Article titles that name no person, and labels of teachers and students.
NOT_PERSON, TEACHER, STUDENT = r"(?i)^(list of|aikido )", r"(?i)teacher|sensei", r"(?i)student|notable"


def location(text: Column) -> Column:
    """City, region and country of address lines: `City, ST zip`, else a line that ends in a comma and the one below."""
    rows = F.filter(F.transform(F.split(text, BREAKS), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[+()0-9 .-]{7,}$"))
    us = F.get(F.filter(F.transform(rows, split_location), lambda x: x.isNotNull()), 0)
    at = F.get(F.filter(F.transform(rows, lambda x, i: F.when(x.endswith(","), i)), lambda i: i.isNotNull()), 0)
    city = F.trim(F.regexp_replace(F.get(rows, at), ",+$", ""))
    other = F.struct(city.alias("city"), F.lit(None).cast("string").alias("region"), F.get(rows, at + 1).alias("country"))
    return F.coalesce(us, F.when(at.isNotNull(), other))


def directory(pages: DataFrame, key: str, html: str, org: Column) -> DataFrame:
    """Places of directory pages: headings of level 3 with labelled fields below them.

    The first instructor is the chief, the others stay in order; the last place of one
    name on a page wins.
    """
    rows = labelled(pages, key, html).filter("heading is not null and heading <> ''")
    of = lambda pattern, value: F.min_by(value, F.when(F.col("label").rlike(pattern), F.col("at")))
    names = F.array_sort(F.collect_list(F.when(F.col("label").rlike(CHIEF) & (F.col("text") != ""), F.struct("at", "text"))))
    found = rows.groupBy(key, "record", "heading").agg(names.alias("n"), of(ADDRESS, F.col("text")).alias("address"), of(WEBSITE, F.coalesce("href", F.nullif(F.col("text"), F.lit("")))).alias("website"))
    people = F.flatten(F.transform("n", lambda x: split_names(x["text"])))
    return found.withColumn("people", people).select(
        key, entity_id("dojo", F.col("heading")).alias("id"), F.col("heading").alias("name"), F.array(org).alias("org"), location(F.col("address")).alias("location"),
        F.get("people", 0).alias("chief_instructor"), F.slice("people", 2, F.greatest(F.size("people"), F.lit(1))).alias("instructors"), "website", "record",
    ).filter("id is not null")


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, label, text, href) of th/td pairs in order."""
    return labelled(pages, key, html).select(key, "at", F.regexp_replace("label", ":$", "").alias("label"), "text", "href")


def classed(pages: DataFrame, key: str, html: str, tag: str, css: str) -> DataFrame:
    """(key, n, text, href) of the elements of one tag and class, in order."""
    rows = pages.select(key, F.posexplode(html_fields(html)).alias("at", "f")).select(key, "at", "f.*")
    own = rows.filter((F.col("tag") == tag) & F.array_contains(F.split("class", r"\s+"), css))
    return own.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("at"))).select(key, "n", "text", "href")


def is_person_title(title: Column, stop: tuple[str, ...] = ()) -> Column:
    """No list, no title of the domain itself, none of ``stop``."""
    return ~title.rlike(NOT_PERSON) & ~F.lower(title).isin(*(stop or ("",)))


def of_domain(rows: DataFrame, key: str, word: str = "aikido") -> DataFrame:
    """Keys of pages of which a labelled row for the style mentions the domain."""
    return rows.filter(F.col("label").rlike("(?i)style|martial") & F.lower("text").contains(word)).select(key).distinct()


def relations(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, href) of rows (label, href) that name teachers or students, once each, in order."""
    kind = F.when(F.col("label").rlike(TEACHER), "teacher").when(F.col("label").rlike(STUDENT), "student")
    return rows.withColumn("kind", kind).filter("kind is not null and href is not null").groupBy(key, "kind", "href").agg(F.min("at").alias("at"))


#: Directories by name: how their pages are read.
READERS = {"headings": directory, "table": table_rows, "classes": classed}
