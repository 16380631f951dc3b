"""Lines of text as rows: state machines and carried values as windows, predicates as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.scalars import clean_name, fold, slug

#: Names of ranks.
RANKS = (
    ("shodan", 1), ("nidan", 2), ("sandan", 3), ("yondan", 4), ("yodan", 4), ("godan", 5), ("rokudan", 6), ("nanadan", 7),
    ("shichidan", 7), ("hachidan", 8), ("kyudan", 9), ("kudan", 9), ("judan", 10),
)
#: What ends a line: line feeds, carriage returns, vertical tabs, form feeds, FS, GS, RS, NEL and the Unicode separators.
BREAKS = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
#: Patterns of the separator in an entry, of headings, and of an address's city line.
SEPARATOR = r"\s+[-–—]\s+"
DAN_HEADING = r"(?i)^(\d{1,2})(?:st|nd|rd|th)\s+dan\b"
SHIHAN_HEADING = r"(?i)^shihan\b"
CITY_STATE = r"^(.+?),\s*([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?$"


def lines_of(docs: DataFrame, key: str, text: str, keep_blank: bool = False) -> DataFrame:
    """(key, line_no, line) with trimmed lines; blank ones are left out."""
    out = docs.select(key, F.posexplode(F.split(text, BREAKS)).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return out if keep_blank else out.filter("line <> ''")


def is_heading(line: Column) -> Column:
    return heading_kind(line).isNotNull()


def heading_kind(line: Column) -> Column:
    """shihan, a rank's number as text, or null."""
    short = (F.length(line) <= 24) & ~line.rlike(SEPARATOR)
    number = F.regexp_extract(line, DAN_HEADING, 1)
    word = F.lower(F.regexp_extract(line, "(?i)^(" + "|".join(n for n, _ in RANKS) + r")\b", 1))
    rank = F.lit(None).cast("string")
    for name, n in RANKS:
        rank = F.when(word == name, str(n)).otherwise(rank)
    return F.when(short, F.when(line.rlike(SHIHAN_HEADING), "shihan").when(number != "", number.cast("int").cast("string")).otherwise(rank))


def entry_of(line: Column) -> Column:
    """(name, place) of a line `Name - Place`, null for any other."""
    parts = F.split(line, SEPARATOR, 2)
    name, place = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    small = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Ll}")))
    fits = (
        (F.size(parts) == 2) & (name != "") & (place != "") & (F.length(name) <= 40) & (F.length(place) <= 60) & name.rlike(r"^\p{Lu}")
        & (F.size(words) <= 6) & (small < 2) & (slug(fold(name)) != "") & (slug(fold(place)) != "")
    )
    return F.when(fits, F.struct(name.alias("name"), place.alias("place")))


def sectioned(lines: DataFrame, key: str, heading: Column, entry: Column) -> DataFrame:
    """Entries with the heading they stand under.

    A heading opens a section; the first line in it that is no entry closes it.
    Entries before any heading, or in a closed section, are left out.
    """
    marked = lines.withColumns({"__h": heading, "__e": entry})
    by = W.partitionBy(key).orderBy("line_no")
    marked = marked.withColumn("section", F.sum(F.col("__h").isNotNull().cast("int")).over(by))
    inside = W.partitionBy(key, "section").orderBy("line_no")
    marked = marked.withColumns({
        "heading": F.first("__h").over(inside),
        "__closed": F.sum((F.col("__h").isNull() & F.col("__e").isNull()).cast("int")).over(inside),
    })
    return marked.filter("section > 0 and __closed = 0 and __h is null and __e is not null").select(*lines.columns, "section", "heading", F.col("__e").alias("entry"))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """Each row with the last value at or before it that isn't null."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order)))


def label_records(rows: DataFrame, key: str, order: str, label: str, value: str, start: str, fields: list[str]) -> DataFrame:
    """Label/value lines to records; the label ``start`` opens one, a later value of a label wins."""
    numbered = rows.withColumn("record", F.sum((F.col(label) == start).cast("int")).over(W.partitionBy(key).orderBy(order))).filter("record > 0")
    return numbered.groupBy(key, "record").agg(*(F.max_by(value, F.when(F.col(label) == f, F.col(order))).alias(f.replace(" ", "_")) for f in fields))


def edge_lines(lines: DataFrame) -> DataFrame:
    """`Teacher (org) -> A, B` as rows (line_no, teacher, student), itself left out."""
    parts = F.split(F.regexp_replace("line", r"^\s*[-*]\s+", ""), "->|→", 2)
    teacher = clean_name(F.get(parts, 0))
    rows = lines.withColumn("__p", parts).filter(F.size("__p") == 2).select(*[c for c in lines.columns if c != "line"], teacher.alias("teacher"), F.explode(F.split(F.get("__p", 1), ",")).alias("student"))
    return rows.withColumn("student", clean_name(F.col("student"))).filter((F.col("teacher") != "") & (F.col("student") != "") & (slug(F.col("teacher")) != slug(F.col("student"))))


def registry_name(line: Column) -> Column:
    """The bold name of a bullet without an arrow."""
    bold = F.regexp_extract(line, r"^\s*[-*]\s+\*\*(.+?)\*\*", 1)
    return F.when((bold != "") & ~line.rlike("->|→"), clean_name(bold))


def split_location(line: Column) -> Column:
    """City and region of `City, ST 12345`."""
    city = F.regexp_extract(line, CITY_STATE, 1)
    return F.when(city != "", F.struct(F.trim(city).alias("city"), F.regexp_extract(line, CITY_STATE, 2).alias("region"), F.lit("USA").alias("country")))
