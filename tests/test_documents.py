"""Overlays, lines, layout, lexicon, pages, reports and streams."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import layout, lexicon, lines, overlay, report
from loomline.sources import crawl, html, tables
from loomline.streaming import upserts


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def corrections(spark, *rows):
    """(level, book, page, first, last, payload, date, status)"""
    return spark.createDataFrame([(*r, i, "t", "a") for i, r in enumerate(rows)], "level string, book string, page int, first int, last int, payload string, date string, status string, seq long, target string, author string")


def resolved(spark, rows, units):
    u = spark.createDataFrame(units, "id int, book string, page int, base string")
    at = u.withColumn("at", F.col("page"))
    found = overlay.matching(at, corrections(spark, *rows), ["book", "page"], ("at", "first", "last"))
    return {r["id"]: r["value"] for r in overlay.override(found, u, "id", F.col("base")).collect()}, found


def test_override_precedence(spark):
    rows = [("book", "b", None, None, None, "book", "2024-05-01", "ok"), ("page", "b", 3, None, None, "old", "2024-01-01", "ok"), ("page", "b", 3, None, None, "new", "2024-02-01", "ok"), ("page", "b", 9, None, None, "gone", "2024-02-01", "retired")]
    got, _ = resolved(spark, rows, [(1, "b", 3, "x"), (2, "b", 4, "x"), (3, "c", 3, "x"), (4, "b", 9, "x"), (5, None, 3, "x")])
    assert got == {1: "new", 2: "book", 3: "x", 4: "book", 5: "x"}


def test_ranges_and_order(spark):
    rows = [("section", "b", None, 10, 20, "in", "2024-01-01", "ok"), ("process", None, None, None, None, "all", "2024-01-01", "ok"), ("odd", "b", None, None, None, "last", "2023-01-01", "ok")]
    got, found = resolved(spark, rows, [(1, "b", 10, "x"), (2, "b", 20, "x"), (3, "b", 21, "x"), (4, "z", None, "x")])
    assert got == {1: "last", 2: "last", 3: "last", 4: "all"}
    assert {r["id"]: r["payloads"] for r in overlay.composed(found, "id").collect()} == {1: ["all", "in", "last"], 2: ["all", "in", "last"], 3: ["all", "last"], 4: ["all"]}


def test_no_corrections(spark):
    assert resolved(spark, [], [(1, "b", 1, "x")])[0] == {1: "x"}


def boxes(*bs):
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("xywh", b))) for b in bs))


def ops(*os):
    kind = "array<struct<op:string,idx:array<int>,boxes:array<struct<x:int,y:int,w:int,h:int>>,by:string>>"
    return F.array(*(F.struct(F.lit(o).alias("op"), F.array(*map(F.lit, i)).alias("idx"), boxes(*b).alias("boxes"), F.lit(by[0] if by else None).alias("by")) for o, i, b, *by in os)).cast(kind)


def test_region_ops(spark):
    a, b, c = (0, 0, 10, 10, "cell"), (20, 0, 10, 10, "cell"), (50, 50, 5, 5, "cell")
    three = F.transform(boxes(a[:4], b[:4], c[:4]), lambda x: x.withField("kind", F.lit("cell")))
    run = lambda *o, start=three: [tuple(x) for x in one(spark, overlay.region_ops(start, ops(*o)))]
    assert run(("drop", [2], [])) == [a, b]
    assert run(("drop", [2], []), ("merge", [0, 1], [])) == [(0, 0, 30, 10, "row")]
    assert run(("merge", [1, 0], [])) == [c, (0, 0, 30, 10, "row")]
    assert run(("merge", [0], [])) == run(("merge", [0, 3], [])) == run() == [a, b, c]
    assert run(("manual", [], [(1, 1, 1, 1)])) == [(1, 1, 1, 1, "photo")]
    mixed = [(40, 3, 10, 10), (0, 30, 10, 12), (5, 0, 10, 10), (20, 33, 10, 10), (0, 8, 4, 10)]
    start = F.transform(boxes(*mixed), lambda x: x.withField("kind", F.lit("cell")))
    assert [x[:4] for x in run(("order", [], [], "column"), start=start)] == sorted(mixed)
    assert [x[:4] for x in run(("order", [], []), start=start)] == [mixed[2], mixed[0], mixed[4], mixed[1], mixed[3]]


def test_forced_caption(spark):
    caps = F.array(F.lit("a"))
    assert one(spark, overlay.forced_caption(caps, F.lit("f"), F.lit(None).cast("boolean"))) == ["f"]
    assert one(spark, overlay.forced_caption(caps, F.lit("f"), F.lit(False))) == ["a", "f"]
    assert one(spark, overlay.forced_caption(caps, F.lit(None).cast("string"), F.lit(True))) == ["a"]


def test_ranges_against_all_pairs(spark):
    r = random.Random(9)
    units = [(g, r.choice([None, *range(-30, 90)])) for g in "ab" for _ in range(60)]
    ranges = [(r.choice("ab"), a, a + r.randrange(-2, 40), i) for i, a in enumerate(r.randrange(-40, 90) for _ in range(40))] + [("a", None, 5, 98), ("b", 5, None, 99)]
    u, c = spark.createDataFrame(units, "g string, at int"), spark.createDataFrame(ranges, "g string, first int, last int, n int")
    for on in (["g"], []):
        got = overlay.holding(u, c if on else c.drop("g"), on, "at", "first", "last").select("g", "at", "n").collect()
        want = [(g, x, n) for g, x in units for h, a, b, n in ranges if (g == h or not on) and None not in (x, a, b) and a <= x <= b]
        assert sorted(map(tuple, got)) == sorted(want)
    corrections = spark.createDataFrame(
        [("a", 0, 10, 0), ("a", None, None, 1), (None, 5, 60, 2), (None, None, None, 3)], "g string, first int, last int, seq int"
    ).selectExpr("*", "'page' as level", "'2024' as date", "'' as status", "'t' as target", "'p' as payload", "'x' as author")
    got = overlay.matching(u.distinct(), corrections, ["g"], ("at", "first", "last")).select("g", "at", F.col("rank.seq").alias("n")).collect()
    rows = [("a", 0, 10, 0), ("a", None, None, 1), (None, 5, 60, 2), (None, None, None, 3)]
    want = [(g, x, n) for g, x in set(units) for h, a, b, n in rows if h in (None, g) and (a is None or x is not None and a <= x <= b)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_section_lookup(spark):
    ranges = spark.createDataFrame([("v", 1, 10, "skip", 1), ("v", 5, 20, "jo", 2)], "book string, first int, last int, kind string, seq int")
    pages = spark.createDataFrame([("v", 5), ("v", 5), ("v", 11), ("v", 30), ("w", 5)], "book string, page int")
    assert sorted((r["page"], r["kind"]) for r in overlay.range_lookup(pages, ranges, ["book"], "page").filter("book = 'v'").collect()) == [(5, "skip"), (5, "skip"), (11, "jo"), (30, None)]


PROMOTIONS = """Congratulations to all

5th Dan:
Ann Bee - Aikido of Town
Carl de Dee – West Dojo
Stay tuned for more news
Late Entry - Ignored Dojo
6th Dan:
Eve Eff — Dojo X
Godan
Gil Ha - Dojo Y
Shihan:
Ida Jay - Dojo Z
Thanks to all - who came from far and wide to be here"""


def test_promotion_text(spark):
    doc = spark.createDataFrame([(1, PROMOTIONS)], "k int, text string")
    rows = lines.lines_of(doc, "k", "text")
    found = lines.sectioned(rows, "k", lines.heading_kind(F.col("line")), lines.entry_of(F.col("line"))).orderBy("line_no").collect()
    assert [(r["heading"], r["entry"]["name"], r["entry"]["place"]) for r in found] == [("5", "Ann Bee", "Aikido of Town"), ("5", "Carl de Dee", "West Dojo"), ("6", "Eve Eff", "Dojo X"), ("5", "Gil Ha", "Dojo Y"), ("shihan", "Ida Jay", "Dojo Z")]


def test_sections_against_a_state_machine(spark):
    r = random.Random(7)
    seq = [(d, i, r.choice(["H1", "H2", "e", "e", "e", "x"])) for d in range(30) for i in range(25)]
    df = spark.createDataFrame(seq, "k int, line_no int, line string")
    got = {(x["k"], x["line_no"]): x["heading"] for x in lines.sectioned(df, "k", F.when(F.col("line").startswith("H"), F.col("line")), F.when(F.col("line") == "e", F.lit(1))).collect()}
    want, mode = {}, None
    for d, i, s in seq:
        mode = None if i == 0 else mode
        if s.startswith("H"):
            mode = s
        elif s == "x":
            mode = None
        elif mode:
            want[d, i] = mode
    assert got == want


def test_edge_lines_and_registry(spark):
    text = "- **Ann Bee** (USA)\n- Tee Cher (org) -> Ann Bee, Bob*, tee cher\nno arrow\nX → Y\n"
    rows = lines.lines_of(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text")
    assert sorted((r["teacher"], r["student"]) for r in lines.edge_lines(rows).collect()) == [("Tee Cher", "Ann Bee"), ("Tee Cher", "Bob"), ("X", "Y")]
    assert [r[0] for r in rows.select(lines.registry_name(F.col("line"))).collect()] == ["Ann Bee", None, None, None]


def test_label_records_and_breaks(spark):
    rows = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([("city", "early"), ("dojo name", "A"), ("city", "X"), ("city", "Y"), ("dojo name", "B")])], "k int, at int, label string, value string")
    got = lines.label_records(rows, "k", "at", "label", "value", "dojo name", ["dojo name", "city"]).orderBy("record").collect()
    assert [(r["dojo_name"], r["city"]) for r in got] == [("A", "Y"), ("B", None)]
    doc = spark.createDataFrame([(1, "a\r\nb c\x0bd\x85 \n e")], "k int, text string")
    assert [r["line"] for r in lines.lines_of(doc, "k", "text").orderBy("line_no").collect()] == ["a", "b", "c", "d", "e"]
    assert tuple(one(spark, lines.split_location(F.lit("New York, NY 10001")))) == ("New York", "NY", "USA")
    assert one(spark, lines.split_location(F.lit("Oranjestad,"))) is None


def word(text, left, top, block=1, par=1, line=1, conf=90.0, width=40, height=10):
    return ("b", 1, text, conf, left, top, width, height, line, block, par)


def test_lines_and_passages(spark):
    words = [word("two", 60, 0), word("one", 0, 2), word(" ", 5, 0), word("bad", 5, 0, conf=-1.0), word("three", 0, 15, line=2), word("far", 0, 100, line=3), word("四方投げ", 0, 112, line=4)]
    df = spark.createDataFrame(words, tables.SCHEMAS["ocr_word"])
    found = layout.lines_of_words(df)
    assert [r["text"] for r in found.orderBy("y0").collect()] == ["one two", "three", "far", "四方投げ"]
    got = layout.passages(found.withColumn("text", F.concat("text", F.lit(" words"))), ["book", "page"]).orderBy("block").collect()
    assert [(r["n_lines"], r["y0"], r["y1"]) for r in got] == [(2, 0, 25), (2, 100, 122)]
    got = layout.passages(found, ["book", "page"]).orderBy("block").collect()
    assert [(r["text"], r["lang"]) for r in got] == [("one two\nthree", "en"), ("四方投げ", "ja")]


def test_columns_and_medians(spark):
    rows = spark.createDataFrame([("b", 1, 0, 100, 0), ("b", 1, 0, 110, 20), ("b", 1, 500, 600, 5)], "book string, page int, x0 int, x1 int, y0 int")
    assert [r["column"] for r in layout.columns_of(rows, F.lit(1000)).orderBy("x0", "y0").collect()] == [1, 1, 2]
    nums = spark.createDataFrame([(1, v) for v in (4, 1, 3, 2)] + [(2, 7)], "k int, v int")
    assert {r["k"]: r["m"] for r in nums.groupBy("k").agg(layout.upper_median(F.col("v")).alias("m")).collect()} == {1: 3, 2: 7}


def test_reading_order_and_regions(spark):
    got = one(spark, layout.reading_order(boxes((100, 3, 10, 10), (0, 0, 10, 10), (0, 40, 10, 10))))
    assert got == [1, 0, 2]
    page = bytearray(b"\xff" * (100 * 140))
    for x0, y0, x1, y1 in ((10, 10, 60, 40), (80, 60, 130, 90)):
        for y in range(y0, y1):
            page[y * 140 + x0 : y * 140 + x1] = bytes(x1 - x0)
    df = spark.createDataFrame([(bytes(page), 140)], "p binary, w int")
    assert [tuple(b) for b in df.select(layout.photo_regions("p", "w").alias("r")).first()["r"]] == [(10, 10, 50, 30), (80, 60, 50, 30)]


def test_nearest_anchor_against_all_pairs(spark):
    r = random.Random(5)
    anchors = [(p, f"a{p}{i}", r.randrange(100)) for p in range(4) for i in range(p * 2)]
    items = [(p, i, r.randrange(100)) for p in range(4) for i in range(12)]
    got = layout.nearest_anchor(spark.createDataFrame(items, "page int, item int, y int"), spark.createDataFrame(anchors, "page int, cap string, cy int"), ["page"], "item", "y", "cap", "cy")
    for x in got.collect():
        y = next(b for p, i, b in items if (p, i) == (x["page"], x["item"]))
        own = [(abs(cy - y), cy, c) for p, c, cy in anchors if p == x["page"]]
        assert x["cap"] == (min(own)[2] if own else None)


def test_bilingual_captions(spark):
    none = (None, None)
    rows = [
        ("a", 1, 0, 5, "Shomenuchi Ikkyo", None, "ikkyo", "shomen-uchi", None, ["x"], ["q"]), ("a", 1, 1, 3, None, "正面打ち一教", "ikkyo", "shomen-uchi", "omote", ["y", "x"], ["r"]),
        ("a", 2, 0, 1, "Ikkyo Omote", None, "ikkyo", None, "omote", *none), ("a", 2, 1, 2, "Ikkyo Ura", None, "ikkyo", None, "ura", *none),
        ("b", 1, 0, 7, None, "一教", "ikkyo", None, None, *none), ("b", 1, 1, 9, "Nikyo", None, "nikyo", None, None, *none),
    ]
    kind = "book string, page long, at long, y long, romaji string, native string, technique string, attack string, direction string, form array<string>, qualifiers array<string>"
    got = sorted(map(tuple, layout.merge_bilingual(spark.createDataFrame(rows, kind)).collect()))
    assert got[0] == ("a", 1, 0, 3, "Shomenuchi Ikkyo", "正面打ち一教", "ikkyo", "shomen-uchi", "omote", ["x", "y"], ["q", "r"], 2)
    assert len(got) == 5


def test_captions(spark):
    got = one(spark, lexicon.parse_caption(F.lit("Kokyu Nage (Tachi dori) (Tsuki)")))
    assert (got["name"], got["qualifiers"], got["technique"], got["attack"], got["form"], got["slug"]) == ("Kokyu Nage", ["Tachi dori", "Tsuki"], "kokyu-nage", "tsuki", ["tachi-dori"], "kokyu-nage-tachi-dori-tsuki")
    got = one(spark, lexicon.classify(F.lit("Ushiro Ryote-dori Kotegaeshi")))
    assert (got["attack"], got["technique"]) == (["ushiro-ryote-dori"], ["kote-gaeshi"])
    got = one(spark, lexicon.classify(F.lit("正面打ち四方投げ（表）")))
    assert (got["attack"], got["technique"], got["direction"]) == (["shomen-uchi"], ["shiho-nage"], ["omote"])
    assert one(spark, lexicon.parse_caption(F.lit("第 三 教")))["slug"] == "sankyo"
    flags = lambda f, *ls: [one(spark, f(F.lit(x))) for x in ls]
    assert flags(lexicon.is_caption, "Shihonage Omote", "refer to Shihonage", "This is the Ikkyo", "noise", "四方投げは次の") == [True, False, False, False, False]
    assert flags(lexicon.is_weapon_caption, "(1) 直 突き", "[ 突き の 部 ]", "ここからはじめるものがたり突き") == [True, False, False]
    assert one(spark, lexicon.is_section_header(F.lit("[ 突き の 部 ]")))
    got = one(spark, lexicon.parse_weapon_caption(F.lit("(1) 直 突き")))
    assert (got["name"], got["number"], got["native"]) == ("", "1", "直突き")


def sequential(text, kanji, latin):
    import re
    import unicodedata

    found = []
    hay = re.sub(r"\s+", "", text)
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    for entries, hay in ((kanji, hay), (latin, re.sub("[^a-z0-9]", "", folded))):
        for s, slot, name in sorted(entries, key=lambda e: -len(e[0])):
            if s and s in hay and (slot, name) not in found:
                found.append((slot, name))
                hay = hay.replace(s, "·")
    return found


def test_classify_against_a_fold(spark):
    r = random.Random(11)
    kanji, latin = lexicon.seed()
    bits = [e[0] for e in kanji + latin] + ["x", " ", "no", "技"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 6))) for _ in range(150)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    for row in df.select("i", lexicon.classify(F.col("text")).alias("c")).collect():
        want = sequential(texts[row["i"]], kanji, latin)
        assert all(row["c"][s] == [n for slot, n in want if slot == s] for s in lexicon.SLOTS), texts[row["i"]]


def test_taught_words(spark):
    kanji, latin = lexicon.seed()
    new = [{"slot": "technique", "canonical": "new-waza", "variants": ["newwaza", "neo"], "kanji": ["新技"]}]
    c = lexicon.classify(F.lit("Neo ura"), lexicon.taught(kanji, new, True), lexicon.taught(latin, new, False))
    assert one(spark, c)["technique"] == ["new-waza"] and one(spark, lexicon.classify(F.lit("Neo ura")))["technique"] == []


def test_glossary(spark, monkeypatch):
    terms = spark.createDataFrame([("t1", "四方"), ("t2", "四方投げ"), ("t3", "四方"), ("t4", "")], "term string, kanji string")
    texts = spark.createDataFrame([(1, "これは四方投げ"), (2, "none")], "k int, text string")
    assert [(r["kanji"], r["n"]) for r in lexicon.retrieve_terms(texts, "k", "text", terms).orderBy("n").collect()] == [("四方投げ", 1), ("四方", 2)]
    assert lexicon.retrieve_terms(texts, "k", "text", terms.limit(0)).count() == 0
    monkeypatch.setattr(lexicon, "SPELLINGS", 1)
    assert [(r["kanji"], r["n"]) for r in lexicon.retrieve_terms(texts, "k", "text", terms).orderBy("n").collect()] == [("四方投げ", 1), ("四方", 2)]
    assert lexicon.curated_terms(spark).count() == sum(map(len, __import__("loomline.functions.vocabulary", fromlist=["x"]).SPELLINGS.values()))
    assert one(spark, lexicon.prompt(F.lit("x"), F.array(F.lit("a")))) == "Use these terms:\n- a\n\nTranslate:\nx"


PAGE = """<html><head><style>p{}</style><script>Sensei Bad Name</script></head><body><p>Chief Instructor: Robert A. Bee<br>Carl Dee Sensei
<p>Sensei Eve Eff and Gil Ha, 5th Dan<p>NEW YORK Sensei<a href="/about">About us</a><a href="https://other.org/about">x</a><a href="/about#top">again</a><a href="teachers.html">T</a><a href="/faculty">F</a>"""


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, "https://a.org/", PAGE), (2, "https://b.org/", None)], "k int, url string, html string")
    got = {r["name"]: r["role"] for r in html.instructors(df, "k", "html").collect()}
    assert got == {"Robert A. Bee": "chief", "Carl Dee": "instructor", "Eve Eff": "instructor", "Gil Ha": "instructor"}
    assert [r["link"] for r in html.hint_links(df, "k", "url", "html").orderBy("n").collect()] == ["https://a.org/about", "https://a.org/teachers.html"]
    text = df.select(html.html_to_text("html").alias("t")).collect()
    assert "Bad Name" not in text[0]["t"] and text[1]["t"] is None


def test_labelled_fields(spark):
    page = '<ul><li><h3><a href="/dojos/x">Dojo X</a></h3><dl><dt>Chief Instructor</dt><dd>Ann Bee</dd><dt>Address</dt><dd>1 Road<br>Town, NY 10001</dd><dt>Website</dt><dd><a href="https://x.org">site</a></dd></dl></li><li><h3>Y</h3><dl><dt>Address<dd>Z</dl></li></ul>'
    rows = html.labelled(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html").orderBy("at").collect()
    assert [(r["heading"], r["label"], r["text"], r["href"]) for r in rows] == [("Dojo X", "chief instructor", "Ann Bee", None), ("Dojo X", "address", "1 Road\nTown, NY 10001", None), ("Dojo X", "website", "site", "https://x.org"), ("Y", "address", "Z", None)]


def test_bounded_walk(spark):
    links = {i: [(i * 2) % 50, (i * 3 + 1) % 50] for i in range(50)}
    fetched = {i for i in range(50) if i % 5}
    for most in (1, 7, 30, 500):
        queue, visited = [1, 2], [1, 2][:most]
        queue = list(visited)
        at = 0
        while at < len(queue) and len(visited) < most:
            if queue[at] in fetched:
                for d in links[queue[at]]:
                    if d not in visited and len(visited) < most:
                        visited.append(d)
                        queue.append(d)
            at += 1
        seeds = spark.createDataFrame([(1, 0), (2, 1), (1, 2)], "node long, seq int")
        l = spark.createDataFrame([(s, k, d) for s, ds in links.items() for k, d in enumerate(ds)], "src long, at int, dst long")
        got = crawl.bounded_walk(seeds, l, spark.createDataFrame([(i,) for i in fetched], "node long"), most)
        assert {r["node"] for r in got.collect()} == set(visited)


def test_collections(spark, tmp_path):
    p = f"{tmp_path}/terms.json"
    assert tables.read_collection(spark, p, "term").count() == 0
    (tmp_path / "terms.json").write_text('[{"id": "a", "romaji": "x"}, {"id": "b"}, {"id": "a", "romaji": "y"}]')
    rows = tables.read_collection(spark, p, "term")
    assert {r["id"]: r["romaji"] for r in rows.collect()} == {"a": "y", "b": None}
    tables.write_collection(rows, f"{tmp_path}/out")
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a", "b"]
    (tmp_path / "notes.md").write_text("# A\n\n- b\n")
    assert [r["line"] for r in tables.read_lines(spark, f"{tmp_path}/notes.md").orderBy("line_no").collect()] == ["# A", "- b"]
    wanted = spark.createDataFrame([("u1",), ("u2",), ("u1",)], "url string")
    cache = tables.uncached(wanted, spark.createDataFrame([], "key string")).filter("url = 'u1'")
    assert [r["url"] for r in tables.uncached(wanted, cache).collect()] == ["u2"]
    books = tables.discover_books(spark.createDataFrame([("/x/Great Vol1.PDF",), ("/x/a.txt",)], "path string"), spark.createDataFrame([("vol1", 1, "b1"), ("great", 2, "b2")], "token string, seq int, id string"))
    assert [tuple(r) for r in books.collect()] == [("/x/Great Vol1.PDF", "b1")]


def test_reports(spark):
    df = spark.createDataFrame([(1, "2024-02-30", "ftp://x", "a"), (2, "2024-02-28", "no url", "z"), (3, None, None, None)], "id int, d string, u string, k string")
    rules = [report.date_format("d"), report.url_format("u"), report.one_of("k", "a", "b"), report.required("k")]
    got = {r["id"]: r["errors"] for r in report.validated(df, "id", rules).collect()}
    assert got == {1: ["d: is no date"], 2: ["k: is not one of the values", "u: is no URL"], 3: ["k: is required"]}
    with pytest.raises(Exception, match="is no|is required"):
        report.validated(df, "id", rules, strict=True).collect()
    items = spark.createDataFrame([(i,) for i in range(4)], "i int")
    done = spark.createDataFrame([(1,), (3,)], "i int")
    after = lambda n, d=done: [r["i"] for r in report.next_unreviewed(items, d, "i", ["i"], n).collect()]
    assert (after(0), after(2), after(1), after(0, items)) == ([2], [0], [2], [])
    manifest = spark.createDataFrame([("a", "h1", 3, "d0"), ("b", "h2", 1, "d0"), ("c", "h3", 2, "d0")], "key string, hash string, rev long, date string")
    current = spark.createDataFrame([("a", "h1"), ("b", "new"), ("x", "h")], "key string, hash string")
    got = {r["key"]: (r["rev"], r["date"]) for r in report.revisions(manifest, current, F.lit("today")).collect()}
    assert got == {"a": (3, "d0"), "b": (2, "today"), "c": (2, "d0"), "x": (1, "today")}
    assert "| 1 |" in report.markdown("t", df.select("id"))


def test_streams(spark, tmp_path):
    rules = {"names": "union", "last": "last"}
    schema = "id int, seq long, names array<string>, last string"
    folder = f"{tmp_path}/in"
    for n, rows in enumerate([[(1, 0, ["a"], "x"), (2, 1, ["b"], None)], [(1, 2, ["b", "a"], None), (3, 3, [], "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        upserts.merge_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    table = lambda: {r["id"]: (r["names"], r["last"]) for r in upserts.merged_table(spark, f"{tmp_path}/out", schema, "id", "seq", rules).collect()}
    assert table() == {1: (["a", "b"], "x"), 2: (["b"], None), 3: ([], "z")}
    # a new checkpoint reads everything again, beside what is there: merging twice changes nothing
    upserts.merge_stream(spark.readStream.schema(schema).parquet(folder), f"{tmp_path}/out", f"{tmp_path}/other").awaitTermination()
    assert table() == {1: (["a", "b"], "x"), 2: (["b"], None), 3: ([], "z")}
    events = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", 1, 1.0) for m in (0, 1, 30, 59)], "ts string, user int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n"] for r in upserts.sessions(events, "ts", "5 minutes", "1 hour", "user").collect()) == [1, 1, 2]


def test_box_holding_center_against_pairs(spark):
    r = random.Random(3)
    near = lambda: r.randrange(-40, 40)
    items = [(r.randrange(2), i, near() + r.choice((0.0, 0.5, 0.3)), float(near())) for i in range(300)] + [(0, 300, None, 1.0), (5, 301, 1.0, 1.0), (0, 302, float("nan"), 1.0)]
    boxes = [(r.randrange(2), n, near(), near(), r.randrange(0, 25), r.randrange(0, 25)) for n in range(60)] + [(0, 60, -900, -900, 1800, 1800), (1, 61, 5, 5, -1, 3)]
    got = layout.box_holding_center(
        spark.createDataFrame(items, "g int, i int, cx double, cy double"), spark.createDataFrame(boxes, "g int, n int, x int, y int, w int, h int"), ["g"]
    )
    assert got.columns == ["g", "i", "cx", "cy", "n"]
    for row in got.collect():
        inside = [n for g, n, x, y, w, h in boxes if g == row["g"] and row["cx"] is not None and x <= row["cx"] <= x + w and y <= row["cy"] <= y + h]
        assert row["n"] == min(inside, default=None)
    assert got.count() == len(items)
    none = spark.createDataFrame([], "g int, n int, x int, y int, w int, h int")
    assert layout.box_holding_center(spark.createDataFrame(items, "g int, i int, cx double, cy double"), none, ["g"]).filter("n is null").count() == len(items)


def test_hot_group_makes_no_pairs(spark):
    """4,000 centers at one spot and as many boxes around it are met by equal keys, without comparing pairs."""
    spot = spark.range(4000).selectExpr("0 as g", "id as i", "5L as cx", "5L as cy")
    got = layout.box_holding_center(spot, spot.selectExpr("g", "i as n", "0 as x", "0 as y", "9 as w", "9 as h"), ["g"])
    assert got.filter("n = 0").count() == 4000
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and not [x for x in joins if ">=" in x or "<=" in x]
