"""Persons and edges of encyclopedia articles: info boxes, the domain they belong to, and who they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.scalars import dan_of, edge_id, entity_id, fold, page_title, slug
from loomline.operators.merge import united
from loomline.sources.glossary import unescaped
from loomline.sources.locators import is_person_title
from loomline.storage import Scratch

#: Labels of rows that tell a style; links to categories and to articles.
STYLE, CATEGORY, ARTICLE = r"(?i)style|martial art|discipline", r"/wiki/Category:", r"^/wiki/[^:]+$"


def _text(c: Column) -> Column:
    """The text of a piece of HTML, its white space single."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, "<[^>]+>", " ")), r"(?U)\s+", " "))


def box_of(html: Column) -> Column:
    """The first table of a class that names an info box, else null."""
    table = F.regexp_extract(html, r"(?s)(<table[^>]*class=[\"'][^\"']*infobox.*?</table>)", 1)
    return F.when(table != "", table)


def box_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, label, cell) of an info box's rows that have a heading and a cell; the cell is HTML."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(box_of(F.col(html)), F.lit(r"(?s)(<tr[\s>].*?</tr>)"))).alias("at", "row"))
    head, cell = F.regexp_extract("row", r"(?s)<th[^>]*>(.*?)</th>", 1), F.regexp_extract("row", r"(?s)<td[^>]*>(.*?)</td>", 1)
    return rows.filter(F.col("row").rlike(r"(?s)<th[\s>].*<td[\s>]")).select(key, "at", F.lower(_text(head)).alias("label"), cell.alias("cell"))


def in_domain(pages: DataFrame, key: str, html: str, word: str) -> DataFrame:
    """Keys of pages whose style row or one of whose categories mentions the domain."""
    rows = box_rows(pages, key, html)
    styled = rows.filter(F.col("label").rlike(STYLE) & F.lower(_text(F.col("cell"))).contains(word)).select(key)
    links = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"<a[^>]*href=[\"']([^\"']*)"))).alias("href"))
    return styled.union(links.filter(F.col("href").rlike(CATEGORY) & F.lower("href").contains(word)).select(key)).distinct()


def box_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, native_name, dan): the first Japanese span of the box and the rank its last row for one names."""
    rank = box_rows(pages, key, html).filter(F.col("label").contains("rank") & ~F.col("label").rlike("teacher|student"))
    rank = rank.withColumn("dan", dan_of(_text(F.col("cell")))).groupBy(key).agg(F.max_by("dan", "at").alias("dan"))
    native = F.regexp_extract(box_of(F.col(html)), r"(?s)<span[^>]*lang=[\"']ja[\"'][^>]*>(.*?)</span>", 1)
    return pages.select(key, F.nullif(_text(native), F.lit("")).alias("native_name")).join(rank, key, "left")


def related(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, kind, at, name): who the box names as teacher or student, once each, in order."""
    kind = F.when(F.col("label").contains("teacher"), "teacher").when(F.col("label").contains("student"), "student")
    rows = box_rows(pages, key, html).withColumn("kind", kind).filter("kind is not null")
    links = rows.select(key, "kind", F.col("at").alias("row"), F.posexplode(F.regexp_extract_all("cell", F.lit(r"<a[^>]*href=[\"']([^\"']*)"))).alias("i", "href")).filter(F.col("href").rlike(ARTICLE))
    named = links.withColumn("name", page_title(F.col("href"))).filter(is_person_title(F.col("name")))
    return named.groupBy(key, "kind", "name").agg(F.min(F.struct("row", "i")).alias("at"))


def people(articles: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons and edges of ``articles(title, url, ord, native_name, dan)`` and ``relations(title, kind, at, name)``.

    Articles come in the order of ord, students ahead of teachers.  A person has the
    first name, all sources in order, and the first native name and rank; whoever an
    article names is kept, even without one of their own.  The first edge of two
    persons stays and gains the sources of the others; nobody teaches themselves.
    """
    head = articles.select("title", "url", "ord")
    named = relations.join(head, "title").withColumn("seq", F.struct(F.col("ord"), F.when(F.col("kind") == "student", 1).otherwise(2).alias("k"), F.col("at.row").alias("row"), F.col("at.i").alias("i")))
    zero = F.lit(0)
    own = articles.select(F.col("title").alias("name"), F.struct(F.col("ord"), zero.alias("k"), zero.alias("row"), zero.alias("i")).alias("seq"), F.array("url").alias("source"), "native_name", "dan")
    rows = own.unionByName(named.select("name", "seq", F.array("url").alias("source")), allowMissingColumns=True).withColumn("id", entity_id("person", F.col("name"))).filter("id is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    persons = rows.groupBy("id").agg(F.min_by("name", "seq").alias("name_romaji"), first("native_name").alias("name_native"), first("dan").alias("dan")).join(united(rows, "id", F.col("seq"), "source"), "id")
    a, b = entity_id("person", F.col("title")), entity_id("person", F.col("name"))
    student = F.col("kind") == "student"
    pairs = named.select(F.when(student, b).otherwise(a).alias("student"), F.when(student, a).otherwise(b).alias("teacher"), "seq", F.array("url").alias("source"), F.concat(F.when(student, "notable students of ").otherwise("teacher of "), "title").alias("notes"))
    pairs = pairs.filter("student <> teacher").withColumn("id", edge_id(F.col("student"), F.col("teacher")))
    edges = pairs.groupBy("id").agg(*(F.min_by(c, "seq").alias(c) for c in ("student", "teacher", "notes"))).join(united(pairs, "id", F.col("seq"), "source"), "id")
    return persons, edges.withColumns({"kind": F.lit("direct-student"), "confidence": F.lit("stated"), "status": F.lit("provisional")})


def walk(pages: DataFrame, seeds: DataFrame, word: str, most: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Breadth-first walk over fetched articles pages(title, html) from seeds(title, seq): (node, title, depth, place, state).

    Titles of one slug are one node, under the title that was queued first.  At most
    ``most`` nodes are visited, in the order of the queue: those that an article names
    as students, then as teachers.  Only fetched articles of the domain are expanded
    (state ``expanded``); others that were reached are ``boundary``, those without a
    page ``missing``.  Each depth is one join of the frontier with the pages, and its
    articles alone are read.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    node = slug(fold(F.col("title")))
    fetched = pages.filter("html is not null and html <> ''").select(node.alias("node"), "html").groupBy("node").agg(F.min("html").alias("html"))
    first = lambda df: df.filter("node <> ''").groupBy("node").agg(F.min(F.struct("ord", "title")).alias("f")).select("node", "f.title", "f.ord")
    start = first(seeds.select(node.alias("node"), "title", F.array(F.col("seq").cast("long")).alias("ord")))
    met, depth, n = None, 0, 0
    while n < most:
        fresh = start if met is None else start.join(met.select("node"), "node", "left_anti")
        cut = scratch.cut(fresh.orderBy("ord").limit(most - n), "frontier")
        read = scratch.cut(cut.join(fetched, "node").select("node", "html"), "read")
        state = F.when(F.col("__in").isNotNull(), "expanded").when(F.col("__read").isNotNull(), "boundary").otherwise("missing")
        own = in_domain(read, "node", "html", word).withColumn("__in", F.lit(True))
        told = scratch.cut(cut.join(own, "node", "left").join(read.select("node", F.lit(True).alias("__read")), "node", "left").select("node", "title", "ord", F.lit(depth).alias("depth"), state.alias("state")), "told")
        grown = told.count()
        if not grown:
            break
        met, n, depth = (told if met is None else scratch.cut(met.unionByName(told), "met")), n + grown, depth + 1
        open_ = told.filter("state = 'expanded'").select("node", "ord")
        named = related(read, "node", "html").join(open_, "node")
        at = [(F.col("kind") != "student").cast("long"), F.col("at.row").cast("long"), F.col("at.i").cast("long")]
        start = first(named.select(slug(fold(F.col("name"))).alias("node"), F.col("name").alias("title"), F.concat("ord", F.array(*at)).alias("ord")))
    # at most ``most`` rows
    return met.withColumn("place", F.row_number().over(W.orderBy("depth", "ord")) - 1).select("node", "title", "depth", "place", "state") if met is not None else pages.sparkSession.createDataFrame([], "node string, title string, depth int, place int, state string")


def walked(pages: DataFrame, seeds: DataFrame, word: str, most: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons and edges of a ``walk`` over pages(title, url, html), and the walk itself.

    Expanded articles give persons and edges; whom they name are persons, expanded or not.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    nodes = scratch.cut(walk(pages, seeds, word, most, scratch), "walk")
    held = pages.withColumn("node", slug(fold(F.col("title")))).filter("html is not null and html <> ''").groupBy("node").agg(F.min_by(F.struct("url", "html"), "html").alias("p"))
    read = scratch.cut(nodes.filter("state = 'expanded'").join(held, "node").select("title", "p.url", F.col("place").alias("ord"), "p.html"), "expanded")
    persons, edges = people(read.join(box_facts(read, "title", "html"), "title"), related(read, "title", "html"))
    return persons, edges, nodes
