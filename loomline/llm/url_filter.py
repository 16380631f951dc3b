"""URL filtering: a blocked Bloom filter ahead of an exact join.

Canonical URLs of a list are hashed into a filter of 256-bit blocks: one hash
picks the block, eight others set one bit in each of its eight words.  A page's
lookup keys (its canonical URL and the roots of its host and the domains above)
are tested in the filter; only URLs with a possible hit are joined with the list,
and the join removes the filter's false positives.  Rules for hosts and paths come
first: the longest that fits decides, and the list judges the others.

The filter has a fixed largest size, so its broadcast does not grow with the list;
a longer list only lets more false positives through to the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bloom import build, hashes, holds
from loomline.llm.texts import carried, handed_on
from loomline.storage import Scratch, bound_batches

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Sites that the query lists as a whole, below each ending.
SITES, ENDINGS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without user, port, final dot and www., path without a final slash or index page."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$|\.$", ""), r"^www\.", "")
    page = F.regexp_replace(F.regexp_replace(path, r"/(index\.html?)?$", ""), "/{2,}", "/")
    return F.concat(bare, F.lit("/"), F.regexp_replace(page, "^/", ""))


def lookup_keys(url: Column) -> Column:
    """Canonical URL, then the roots of the host and of each domain above it that has a dot."""
    host, path = host_of(url), path_of(url)
    full = canonical(host, path)
    labels = F.split(F.substring_index(full, "/", 1), r"\.")
    roots = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(full), roots)))


def _tester(table):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = table.value
        for batch in batches:
            pairs = batch.column("hashes")
            flat = pairs.flatten()
            h, w = flat.field("h").to_numpy(zero_copy_only=False), flat.field("w").to_numpy(zero_copy_only=False)
            hit = holds(blocks, h, w)
            owner = np.repeat(np.arange(len(batch)), pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            any_hit = np.zeros(len(batch), bool)
            any_hit[owner[hit]] = True
            yield pa.RecordBatch.from_arrays([batch.column("url").filter(pa.array(any_hit))], ["url"])

    return test


def site_list(spark: SparkSession) -> DataFrame:
    """``url`` of every listed site's root."""
    return spark.createDataFrame([(f"http://{s}.example.{e}/",) for s in SITES for e in ENDINGS], "url string")


def copied_pages(pages: DataFrame) -> DataFrame:
    """``url`` of each page whose article, to the letter, also stands on a page of a smaller id.

    ``pages`` has page_id, url and html.  Pages without an article or an id copy nothing.
    """
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    keyed = pages.filter("page_id is not null and url is not null").filter(article != "").select("page_id", "url", F.sha2(article, 256).alias("article"))
    keyed = Scratch(pages.sparkSession).cut(keyed, "articles")  # so that the pages are read once
    firsts = keyed.groupBy("article").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    return keyed.join(firsts, "article").filter("page_id > first").select("url")


def possible_urls(urls: DataFrame, table) -> DataFrame:
    """The distinct urls of ``urls(url)`` of which a lookup key may be in a broadcast filter."""
    url = F.col("url")
    hashed = urls.filter(url.isNotNull()).distinct().select(url, F.transform(lookup_keys(url), lambda k: F.struct(*hashes(k))).alias("hashes"))
    return hashed.mapInArrow(_tester(table), "url string")


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct urls of ``urls(url)`` of which a lookup key is in ``listed(url)``."""
    bound_batches(urls.sparkSession)
    keys = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).filter("key <> '/'").distinct()
    keys = Scratch(urls.sparkSession).cut(keys, "listed")
    table = urls.sparkSession.sparkContext.broadcast(build(keys, "key"))
    found = possible_urls(urls, table).select("url", F.explode(lookup_keys(F.col("url"))).alias("key"))
    return found.join(keys, "key", "left_semi").select("url").distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", id_col: str = "page_id", keep: tuple[str, ...] = (), rules: tuple = RULES) -> DataFrame:
    """``pages`` to one row per row: id_col, row, url, host, path, rule, verdict.

    row is a struct of the columns of ``keep``, if any, so their names can't clash.
    The longest rule (host and path together) that fits decides and is named; else
    rule is null and the verdict is block for a listed URL, allow for any other.  A
    null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed; very long ones are read whole.  Repeated rows are judged alike.  An empty list blocks nothing, an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    url = F.col("url")
    rows = pages.select(*carried(id_col, keep), F.col(url_col).alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: ((F.col("host") == r[0]) | F.col("host").endswith("." + r[0])) & F.col("path").startswith(r[1])
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        rule, verdict = F.when(fits(r), r[0] + r[1]).otherwise(rule), F.when(fits(r), r[2]).otherwise(verdict)
    bad = listed_urls(rows.select("url"), listed).withColumn("bad", F.lit(True))
    return rows.join(bad, "url", "left").select(
        *handed_on(id_col, keep), "url", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list: roots of known sites, and the canonical URLs of pages that copy another's article."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, site_list(spark).union(copied_pages(pages))).drop("url")
