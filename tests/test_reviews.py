"""Reviews, directory pages and the fetching source."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import overlay, page_parse, review
from loomline.sources import fetch, locators


def test_reviews(spark):
    techniques = spark.createDataFrame([("t1",), ("t2",)], "id string")
    saved = spark.createDataFrame([("t1", "ok", "", "s", None, "n"), ("t2", "bad", "N", None, None, "")], "technique string, verdict string, name string, slots string, keyframes string, note string")
    rows = review.review_rows(saved, techniques, "Ann B", "2024-01-01")
    assert sorted((r["technique"], r["target"]) for r in rows.collect()) == [("t1", "note"), ("t1", "parse.slots"), ("t1", "verdict"), ("t2", "name"), ("t2", "verdict")]
    assert rows.filter("target = 'verdict' and technique = 't1'").first()["id"] == "ref:verdict:t1:ann-b"
    stored = rows.withColumn("seq", F.lit(1).cast("long")).unionByName(spark.createDataFrame([("x", "technique", "t1", "verdict", "late", "Ann B", "2025", "ok", 9), ("y", "technique", "t3", "note", "no verdict", "Ann B", "2025", "ok", 9)], "id string, level string, technique string, target string, payload string, author string, date string, status string, seq long"))
    got = {r["technique"]: (r["verdict"], r["name"], r["parse_slots"], r["note"]) for r in review.reviews(stored, "Ann B").collect()}
    assert got == {"t1": ("ok", None, "s", "n"), "t2": ("bad", "N", None, None)}
    assert review.reviews(stored, "Other").count() == 0
    assert review.listing(stored, target="note", technique="t1", book=None).count() == 1
    with pytest.raises(Exception, match="unknown technique t9"):
        review.review_rows(saved.withColumn("technique", F.lit("t9")), techniques, "a", "d").collect()


def test_blocks_and_steps(spark):
    blocks = spark.createDataFrame([("b1", "v", 1, 1, "old", None), ("b2", "v", 1, 2, "keep", "k")], "id string, book string, page int, block int, text string, translation string")
    fixes = spark.createDataFrame([("v", 1, 1, "text.ocr", "a", "2024-01-01", 0, "ok"), ("v", 1, 1, "text.ocr", "b", "2024-02-01", 1, "ok"), ("v", 1, 1, "text.translation", "t", "2024-01-01", 2, "ok"), ("v", 1, 2, "text.ocr", "x", "2024-01-01", 3, "retired")], "book string, page int, block int, target string, payload string, date string, seq int, status string")
    assert {r["id"]: (r["text"], r["translation"], r["corrected"]) for r in review.corrected_blocks(blocks, fixes).collect()} == {"b1": ("b", "t", True), "b2": ("keep", "k", False)}
    frames = spark.createDataFrame([("k2", "t1", 2), ("k1", "t1", 1)], "id string, technique string, step_index int")
    assert {r["id"]: r["keyframes"] for r in review.steps(spark.createDataFrame([("t1",), ("t2",)], "id string"), frames).collect()} == {"t1": ["k1", "k2"], "t2": []}


def test_chosen_regions(spark):
    caps = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "page int, at int, caption string")
    links = F.array(F.struct(F.lit(1).alias("caption_index"), F.array(F.lit(1), F.lit(7)).alias("regions")))
    assert [(r["caption"], r["boxes"]) for r in review.chosen_regions(caps, F.array(F.lit("r0"), F.lit("r1")), links).collect()] == [("b", ["r1"])]


PAGE = """<ul><li><h3><a href="/dojos/x">Dojo X</a></h3><dl><dt>Chief Instructors</dt><dd>Ann Bee and Carl Dee</dd><dt>Address</dt><dd>1 Road<br>New Town, NY 10001<br>555-123-4567</dd>
<dt>Website</dt><dd><a href="https://x.org">site</a></dd></dl></li><li><h3>Island Dojo</h3><dl><dt>Address</dt><dd>Oranjestad,<br>Aruba</dd></dl></li></ul>"""
BOX = "<table><tr><th>Style</th><td>Aikido</td></tr><tr><th>Teacher(s)</th><td><a href='/wiki/T'>T</a></td></tr><tr><th>Notable students</th><td><a href='/wiki/S'>S</a></td></tr></table>"


def test_directory(spark):
    df = spark.createDataFrame([(1, PAGE)], "k int, html string")
    got = {r["id"]: r for r in locators.directory(df, "k", "html", F.lit("org:o")).collect()}
    x, y = got["dojo:dojo-x"], got["dojo:island-dojo"]
    assert (x["chief_instructor"], x["instructors"], x["website"], tuple(x["location"])) == ("Ann Bee", ["Carl Dee"], "https://x.org", ("New Town", "NY", "USA"))
    assert (y["chief_instructor"], y["website"], tuple(y["location"])) == (None, None, ("Oranjestad", None, "Aruba"))


def test_articles(spark):
    rows = locators.table_rows(spark.createDataFrame([(1, BOX), (2, "<p>none</p>")], "k int, html string"), "k", "html")
    assert [r["k"] for r in locators.of_domain(rows, "k").collect()] == [1]
    assert sorted((r["kind"], r["href"]) for r in locators.relations(rows, "k").collect()) == [("student", "/wiki/S"), ("teacher", "/wiki/T")]
    titles = spark.createDataFrame([("Ann Bee",), ("List of styles",), ("Aikido Journal",)], "t string")
    assert [r["t"] for r in titles.filter(locators.is_person_title(F.col("t"))).collect()] == ["Ann Bee"]
    boxes = spark.createDataFrame([(1, '<div class="bde-text a">one</div><div>no</div><div class="bde-text">two</div>')], "k int, html string")
    assert [r["text"] for r in locators.classed(boxes, "k", "html", "div", "bde-text").orderBy("n").collect()] == ["one", "two"]


def test_fetching(spark):
    asked, waits = [], []

    def get(url, agent):
        asked.append(url)
        return "User-agent: *\nDisallow: /private" if url.endswith("robots.txt") else None if url.endswith("gone") else f"page {url}"

    got = list(fetch.fetch_host(["http://h/a", "http://h/private/x", "http://h/gone"], "me", get, 2.0, waits.append))
    assert got == [("http://h/a", "page http://h/a"), ("http://h/private/x", None), ("http://h/gone", None)]
    assert waits == [2.0, 2.0] and asked[0] == "http://h/robots.txt"
    assert fetch.allowed(None, "me", "http://h/a")
    spark.dataSource.register(fetch.PageSource)
    assert spark.read.format("polite_pages").option("urls", json.dumps([])).load().count() == 0


def test_page_parse(spark):
    seed = spark.createDataFrame([("v", 1, 24, "taijutsu", "skip", None, None, 1), ("v", 83, 123, "aiki-jo", "suburi", "jo", "31", 2)], "book string, first int, last int, context string, kind string, weapon string, form string, seq int")
    pages = spark.createDataFrame([("v", 5), ("v", 60), ("v", 86), ("w", 5)], "book string, page int")
    got = {(r["book"], r["page"]): (r["context"], r["kind"], r["weapon"], r["form"]) for r in page_parse.sections_of(pages, seed).collect()}
    assert got == {("v", 5): ("taijutsu", "skip", None, None), ("v", 60): ("taijutsu", "technique", None, None), ("v", 86): ("aiki-jo", "suburi", "jo", "31"), ("w", 5): ("taijutsu", "technique", None, None)}
    fix = spark.createDataFrame([("v", 80, 90, None, "kumi", None, "new", "2024", 1)], "book string, first int, last int, context string, kind string, weapon string, form string, date string, seq int")
    got = {r["page"]: (r["context"], r["kind"], r["weapon"], r["form"]) for r in page_parse.sections_of(pages, seed, fix).filter("book = 'v'").collect()}
    assert got[86] == ("aiki-jo", "kumi", None, "new") and got[60] == ("taijutsu", "technique", None, None)
    assert page_parse.readable(page_parse.sections_of(pages, seed)).count() == 3

    lines = spark.createDataFrame([("v", 60, 0, "Shihonage Omote", 10, None), ("v", 60, 1, "refer to Ikkyo", 20, None), ("v", 60, 2, "Ikkyo Ura", 200, None), ("v", 60, 3, "Nikyo", 900, None), ("v", 86, 0, "(1) 直 突き", 5, "jo")], "book string, page int, cap int, text string, y0 int, weapon string")
    caps = page_parse.captions_of(lines, F.col("weapon").isNotNull())
    assert {(r["page"], r["cap"]): (r["slug"], r["technique"], r["native"]) for r in caps.collect()} == {(60, 0): ("shihonage-omote", "shiho-nage", None), (60, 2): ("ikkyo-ura", "ikkyo", None), (60, 3): ("nikyo", "nikyo", None), (86, 0): ("1", None, "直突き")}
    regions = spark.createDataFrame([("v", 60, [(0, y, 10, 10, "photo") for y in (10, 30, 210)])], f"book string, page int, boxes {overlay.BOXES}")
    techniques, frames, _ = page_parse.parsed(pages, lines.withColumnRenamed("cap", "at"), regions, seed)
    assert {r["id"]: (r["seq"], r["step_count"]) for r in techniques.collect()} == {"tech:v-p60-shihonage-omote": (1, 2), "tech:v-p60-ikkyo-ura": (2, 1)}
    assert sorted(r["id"] for r in frames.collect()) == ["kf:v-p60-ikkyo-ura-01", "kf:v-p60-shihonage-omote-01", "kf:v-p60-shihonage-omote-02"]
