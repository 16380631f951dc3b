"""Crawls over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.merge import keep_first
from loomline.storage import Scratch


def bounded_walk(seeds: DataFrame, links: DataFrame, fetched: DataFrame, most: int, scratch: Scratch | None = None) -> DataFrame:
    """Breadth-first walk from seeds(node, seq) over links(src, at, dst): (node, depth, ord).

    At most ``most`` nodes are visited in queue order; a node that fetched(node) lacks
    counts as visited but leads nowhere.  Each depth is one join of the frontier with
    the links, and what was met before is removed by an anti-join.
    """
    scratch = scratch or Scratch(seeds.sparkSession)
    start = keep_first(seeds, ["node"], F.col("seq")).select("node", F.array(F.col("seq").cast("long")).alias("ord"))
    frontier = scratch.cut(start.orderBy("ord").limit(most).withColumn("depth", F.lit(0)), "frontier")
    met, n = frontier, frontier.count()
    depth = 0
    while n < most:
        depth += 1
        live = frontier.join(fetched.select("node").distinct(), "node", "left_semi")
        out = live.join(links, live["node"] == links["src"]).select(F.col("dst").alias("node"), F.concat("ord", F.array(F.col("at").cast("long"))).alias("ord"))
        fresh = out.groupBy("node").agg(F.min("ord").alias("ord")).join(met.select("node"), "node", "left_anti")
        frontier = scratch.cut(fresh.orderBy("ord").limit(most - n).withColumn("depth", F.lit(depth)), "frontier")
        grown = frontier.count()
        if not grown:
            break
        met, n = scratch.cut(met.unionByName(frontier), "met"), n + grown
    return met


def listing_pages(first: DataFrame, page_count: str) -> DataFrame:
    """(base, page) for pages 1 to the count that page 1 names."""
    return first.select("base", F.explode(F.sequence(F.lit(1), F.greatest(F.col(page_count), F.lit(1)))).alias("page"))


def details(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing entries (url, seq, ...) once per url, with their fetched page; without one they fall away."""
    return keep_first(listing, ["url"], F.col("seq")).join(pages.select("url", "html"), "url")


def site_instructors(found: DataFrame) -> DataFrame:
    """Per site: the first page that yields a name, its chief and the other names in order.

    found(site, page_no, url, name, role).
    """
    seq = F.struct(F.col("page_no"), F.col("name"))
    chief = F.min_by("name", F.when(F.col("role") == "chief", seq))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "name"))), lambda x: x["name"]))
    return found.groupBy("site").agg(F.min_by("url", seq).alias("source"), chief.alias("chief"), names.alias("names")).select("site", "source", "chief", F.filter("names", lambda n: ~n.eqNullSafe(F.col("chief"))).alias("instructors"))
