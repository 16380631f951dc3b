"""Promotion lists, page bundles, glossary sources, reports and corrections put together, on small cases."""

from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import bundle, merge, overlay, page_parse, promotions, report
from loomline.sources import articles, glossary, html, tables


def test_promotions(spark):
    text = "Intro - Nobody\n6th Dan\nAnn Bee - North Dojo\nBob Cee – South Dojo\nthe end of the list\nCarl Dee - East Dojo\n\nShodan\nAnn Bee - West Dojo\nAnn Bee - East Dojo\nSHIHAN\nAnn Bee - North Dojo\nEve Eff - Far Dojo"
    texts = spark.createDataFrame([(1, text, 2020, "u", "2024-01-01"), (2, None, 2021, "v", "2024-01-01")], "page int, text string, year int, url string, retrieved string")
    got = promotions.promotions(texts, "org:a", "org:b")
    assert {(r["id"], r["name_romaji"], r["notes"]) for r in got["persons"].collect()} == {
        ("person:ann-bee", "Ann Bee", "Shihan title conferred 2020."), ("person:bob-cee", "Bob Cee", None), ("person:eve-eff", "Eve Eff", "Shihan title conferred 2020."),
    }
    assert {(r["id"], r["dan"], r["dojo"]) for r in got["rank_events"].collect()} == {
        ("rank:ann-bee+2020-01-01+6", 6, "dojo:north-dojo"), ("rank:bob-cee+2020-01-01+6", 6, "dojo:south-dojo"), ("rank:ann-bee+2020-01-01+1", 1, "dojo:east-dojo"),
    }
    assert {r["id"] for r in got["dojos"].collect()} == {"dojo:north-dojo", "dojo:south-dojo", "dojo:west-dojo", "dojo:east-dojo"}
    assert [r["person"] for r in got["titles"].orderBy("line_no").collect()] == ["person:ann-bee", "person:eve-eff"]


def test_page_bundle(spark):
    make = spark.createDataFrame
    pages = make([("b", 1), ("b", 2)], "book string, page int")
    sections = make([("b", 1, 1, "weapons", "form", "jo", None, 0)], "book string, first int, last int, context string, kind string, weapon string, form string, seq int")
    techs = make([("t2", "b", 1, 2, "Two"), ("t1", "b", 1, 1, "One"), ("t9", "b", 9, 1, "Nine")], "id string, book string, page int, seq int, name string")
    frames = make([("k1", "t1", "b", 1, 1, [0, 0, 10, 10]), ("k2", "t1", "b", 1, 2, [90, 90, 4, 4]), ("k3", "t2", "b", 1, 1, None)], "id string, technique string, book string, page int, step_index int, bbox array<int>")
    images = make([("b", 1, 3, 0, 0, 20, 20), ("b", 1, 2, 4, 4, 2, 2), ("b", 1, 4, 50, 50, 9, 9), ("b", 2, 5, 0, 0, 1, 1)], "book string, page int, n int, x int, y int, w int, h int")
    blocks = make([("b", 1, 1, "text", None)], "book string, page int, block int, text string, translation string")
    got = {r["page"]: r for r in bundle.page_bundle(pages, sections, techs, frames, images, blocks).collect()}
    assert tuple(got[1]["section"]) == ("weapons", "form", "jo", None) and tuple(got[2]["section"])[:2] == ("taijutsu", "technique")
    assert [t["id"] for t in got[1]["techniques"]] == ["t1", "t2"]
    assert [tuple(k) for k in got[1]["techniques"][0]["keyframes"]] == [(1, "k1", 2), (2, "k2", None)]
    assert [(r["n"], r["assigned"]) for r in got[1]["regions"]] == [(2, True), (3, False), (4, False)]
    assert [b["text"] for b in got[1]["textblocks"]] == ["text"] and got[2]["techniques"] is None and [r["n"] for r in got[2]["regions"]] == [5]


def test_glossary_page(spark):
    page = (
        "<style>x</style><strong>before</strong> - 前 (まえ): before<br><h2>Attacks</h2><p><strong>Attacks Shomen &amp; co</strong> – 正面<br>"
        "<strong>Dori</strong> &#8212; 取り (とり [grab]): to take<br /><strong>Long one two three four five</strong> - a: b<br><strong>Kata</strong> - 肩 : shoulder</p><h3>Unknown</h3><strong>Te</strong> – (て): hand<br>"
    )
    got = glossary.html_terms(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html", "s").orderBy("at").collect()
    assert [(r["romaji"], r["kanji"], r["kana"], r["english"], r["category"]) for r in got] == [
        ("before", ["前"], ["まえ"], "before", None), ("Dori", ["取り"], ["とり"], "to take", "attack"), ("Kata", ["肩"], [], "shoulder", "attack"), ("Te", [], ["て"], "hand", "attack"),
    ]


def test_glossary_layout(spark):
    lines = [(1, 0, "Weapon terms   a list"), (1, 1, "Bokken    wooden sword     Jo   short staff of wood"), (1, 2, "1. Ken   blade"), (1, 3, "Throw    to throw   odd"), (1, 4, "one cell"), (1, 5, "")]
    got = glossary.layout_terms(spark.createDataFrame(lines, "k int, line_no int, line string"), "k", "s").orderBy("line_no", "at").collect()
    assert [(r["romaji"], r["english"], r["category"]) for r in got] == [
        ("Weapon terms", "a list", "weapon"), ("Bokken", "wooden sword", "weapon"), ("Jo", "short staff of wood", "weapon"), ("Throw", "to throw", "technique"),
    ]


def test_joined_payloads(spark):
    row = spark.createDataFrame([('{"a": [1, 2], "b": {"x": 1}, "c": 1}', ['{"a": [2, 3], "b": {"y": 2}, "c": [9]}', "", '{"d": null, "b": 5}']), (None, None)], "base string, payloads array<string>")
    assert [r[0] for r in row.select(overlay.joined_payloads("base", "payloads")).collect()] == ['{"a": [1, 2, 3], "b": 5, "c": [9], "d": null}', "{}"]


def test_additive_fold(spark):
    units = spark.createDataFrame([(1,), (2,)], "u int")
    matched = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "u int, payload string, rank int")
    got = overlay.additive(matched, units, "u", F.lit("base"), lambda value, payload: F.concat(value, F.lit("+"), payload))
    assert {r["u"]: r["value"] for r in got.collect()} == {1: "base+a+b", 2: "base"}


def test_content_hash(spark):
    import hashlib
    import re

    text = "  Title\n\nbody \n_DOC · My name · rev 3 · 2024-02-03 · draft_\n\n_DOCX stays_\n"
    row = spark.createDataFrame([(text,)], "t string").select(S.content_hash(F.col("t"), "DOC"), S.footer_name(F.col("t"), "DOC"), S.footer_date(F.col("t"))).first()
    assert tuple(row) == (hashlib.sha256(re.sub(r"(?m)^_DOC\b.*_\s*$", "", text).strip().encode()).hexdigest()[:12], "My name", "2024-02-03")


def test_coverage_sections(spark):
    make = spark.createDataFrame
    none = make([], "id string")
    c = {
        "persons": make([("p1",), ("p2",)], "id string"), "organizations": none, "dojos": make([("d", "p1", [], True), ("e", "", None, None)], "id string, chief_instructor string, instructors array<string>, anchor boolean"),
        "rank_events": make([("r", "2020-01-01"), ("s", "2022-05-05")], "id string, date string"), "tenures": none, "edges": none,
    }
    pairs = make([("d", "a", "founder", "b", "student", 1950, None, "a"), ("c", "a", "student", "b", "student", 1950, 1951, None)], "dojo string, a_person string, a_role string, b_person string, b_role string, lo int, hi int, direction string")
    members = make([("p1", "p1", "high", "p1"), ("p2", "p1", "high", "p1")], "id string, cluster string, tier string, canonical string")
    problems = make([("x", ["name: is required"])], "id string, errors array<string>")
    rows = report.coverage_sections(c, pairs, members, problems, make([(0, "src")], "at int, name string")).orderBy("part", "a", "b").collect()
    assert [r["line"] for r in rows] == [
        "| persons | 2 |", "| organizations | 0 |", "| dojos | 2 |", "| rank_events | 2 |", "| tenures | 0 |", "| edges | 0 |", "Years captured: 2020-2022 (2)", "Total: 2 (1 anchor), with instructors 1, without 1",
        "Pairs: 2, directional 1, peers 1", "c | a (student) | b (student) | 1950-1951 | no", "d | a (founder) | b (student) | 1950-ongoing | yes", "- src", "high: 1", "high: p1, p2 -> p1", "x: name: is required",
    ]


def test_rules_and_names(spark):
    rows = spark.createDataFrame([(1, []), (2, ["a"]), (3, None)], "id int, source array<string>")
    assert {r["id"] for r in report.validated(rows, "id", [report.at_least("source", 1)]).collect()} == {1}
    names = spark.createDataFrame([("Ann Bee (chief)",), ("ann bee",), ("A B C D E F",), ("Head Instructor",)], "n string")
    assert [r[0] for r in names.select(html.directory_name(F.col("n"))).collect()] == ["Ann Bee", None, None, "Head Instructor"]
    assert [r[0] for r in names.select(html.looks_like_name(F.col("n"))).collect()] == [False, False, False, False]


def test_articles(spark):
    box = (
        '<table class="infobox vcard"><tr><th>Style</th><td><a href="/wiki/Art">The  Art</a></td></tr><tr><td>odd</td></tr>'
        '<tr><th>Native name</th><td><span lang="ja">植芝 盛平</span></td></tr><tr><th>Rank</th><td>8th&nbsp;dan</td></tr>'
        '<tr><th>Teacher(s)</th><td><a href="/wiki/Ann_Bee">Ann</a>, <a href="/wiki/List_of_x">l</a>, <a href="/wiki/File:x">f</a></td></tr>'
        '<tr><th>Notable students</th><td><a href="/wiki/Carl_Dee">C</a> <a href="/wiki/Carl_Dee">C</a> <a href="/wiki/Bob_Cee">self</a></td></tr></table>'
    )
    pages = spark.createDataFrame([("Bob Cee", "u1", 0, box), ("Ann Bee", "u2", 1, '<table class="infobox"><tr><th>Students</th><td><a href="/wiki/Bob_Cee">B</a></td></tr></table><a href="/wiki/Category:The_Art">c</a>'), ("Far Off", "u3", 2, "<p>none</p>"), ("Nil", "u4", 3, None)], "title string, url string, ord int, html string")
    assert {r[0] for r in articles.in_domain(pages, "title", "html", "art").collect()} == {"Bob Cee", "Ann Bee"}
    facts = articles.box_facts(pages, "title", "html")
    assert {r["title"]: (r["native_name"], r["dan"]) for r in facts.collect()} == {"Bob Cee": ("植芝 盛平", 8), "Ann Bee": (None, None), "Far Off": (None, None), "Nil": (None, None)}
    persons, edges = articles.people(pages.join(facts, "title"), articles.related(pages, "title", "html"))
    got = {r["id"]: (r["name_romaji"], r["name_native"], r["dan"], r["source"]) for r in persons.collect()}
    assert got["person:bob-cee"] == ("Bob Cee", "植芝 盛平", 8, ["u1", "u2"]) and got["person:ann-bee"][3] == ["u1", "u2"] and got["person:carl-dee"] == ("Carl Dee", None, None, ["u1"])
    assert {(r["id"], r["notes"], tuple(r["source"])) for r in edges.collect()} == {
        ("edge:bob-cee+ann-bee", "teacher of Bob Cee", ("u1", "u2")), ("edge:carl-dee+bob-cee", "notable students of Bob Cee", ("u1",)),
    }


def test_reviewed_records(spark):
    kind = "map<string,array<string>>"
    techs = spark.createDataFrame([(f"t{i}", "n", "x", {"a": ["1"], "b": ["2"]}, "provisional") for i in range(4)], f"id string, name_romaji string, name_native string, slots {kind}, status string")
    said = spark.createDataFrame(
        [("t0", "corrected", "N", "", {"a": ["9"], "b": [], "c": ["3"]}, ["k2", "k1"], "w", "me", "d"), ("t1", "rejected", "N", None, None, None, "w", "me", "d"), ("t2", "skip", "N", None, None, ["k"], None, "me", "d")],
        f"id string, verdict string, romaji string, native string, slots {kind}, sequence array<string>, note string, author string, date string",
    )
    got = {r["id"]: r for r in report.reviewed_records(techs, said).collect()}
    assert (got["t0"]["name_romaji"], got["t0"]["name_native"], got["t0"]["slots"], got["t0"]["keyframes_reviewed"], got["t0"]["status"]) == ("N", "x", {"a": ["9"], "b": ["2"], "c": ["3"]}, ["k2", "k1"], "reviewed")
    assert tuple(got["t0"]["review"]) == ("corrected", "w", "me", "d") and tuple(got["t1"]["review"]) == ("rejected", None, "me", "d")
    assert (got["t1"]["name_romaji"], got["t1"]["status"]) == ("n", "rejected")
    assert all((got[t]["name_romaji"], got[t]["status"], got[t]["review"], got[t]["keyframes_reviewed"]) == ("n", "provisional", None, None) for t in ("t2", "t3"))


def test_updated_sites_and_places(spark):
    dojos = spark.createDataFrame([("a", "", ["x"], ["s"]), ("b", "c", None, None), ("z", None, None, None)], "id string, chief_instructor string, instructors array<string>, source array<string>")
    found = spark.createDataFrame([("a", ["y", "x"], "n", "t"), ("b", ["q"], "n", "t"), ("unknown", ["q"], "n", "t")], "id string, instructors array<string>, chief string, source string")
    got = {r["id"]: tuple(r)[1:] for r in report.updated_sites(dojos, found).collect()}
    assert got == {"a": ("n", ["x", "y"], ["s", "t"]), "b": ("c", ["q"], ["t"]), "z": (None, [], [])}
    rows = spark.createDataFrame([("u", 0, "a"), ("v", 1, "b"), ("u", 2, "c")], "url string, seq int, name string")
    assert {tuple(r) for r in merge.keep_last_in_place(rows, ["url"], "seq").select("url", "name", "place").collect()} == {("u", "c", 0), ("v", "b", 1)}


def test_seeds(spark, tmp_path):
    import json

    (tmp_path / "persons.json").write_text(json.dumps([{"id": "p", "name_romaji": "New", "source": ["b", "a"]}, {"id": "q", "name_romaji": "Q"}]))
    stored = {"persons": spark.createDataFrame([("p", "Old", ["a"])], "id string, name_romaji string, source array<string>")}
    rules = {n: {"name_romaji": "last", "source": "union"} if n == "persons" else {"source": "union"} for n, _ in tables.SEEDS}
    got = tables.load_seeds(spark, str(tmp_path), stored, rules)
    assert {(r["id"], r["name_romaji"], tuple(r["source"])) for r in got["persons"].collect()} == {("p", "New", ("a", "b")), ("q", "Q", ())}
    assert got["tenures"].count() == 0
    assert tables.since_today(spark.createDataFrame([(None,), ("2000",)], "retrieved string")).filter("retrieved is null").count() == 0


def test_parsed_pages(spark):
    make = spark.createDataFrame
    pages = make([("b", 1), ("b", 2), ("b", 3), ("b", 4)], "book string, page int")
    seed = make([("b", 2, 2, "aiki-jo", "suburi", "jo", None, 0), ("b", 3, 3, "x", "skip", None, None, 1)], "book string, first int, last int, context string, kind string, weapon string, form string, seq int")
    lines = make(
        [
            ("b", 1, 0, "Shomenuchi Ikkyo", 0), ("b", 1, 1, "正面打ち一教", 20), ("b", 1, 2, "Ryotedori Kokyu Nage", 500), ("b", 1, 3, "Then refer to the photos of the first technique above", 700),
            ("b", 2, 0, "突き (1)", 10), ("b", 3, 0, "Shomenuchi Ikkyo", 0), ("b", 4, 0, "Shomenuchi Ikkyo", 0), ("b", 4, 1, "Ryotedori Kokyu Nage", 900),
        ],
        "book string, page int, at long, text string, y0 int",
    )
    box = lambda *ys: [(0, y, 10, 10, "photo") for y in ys]
    regions = make([("b", 1, box(30, 60, 520)), ("b", 2, box(0)), ("b", 3, box(0)), ("b", 4, box(10, 20, 30))], f"book string, page int, boxes {overlay.BOXES}")
    operations = make([("b", 1, [("drop", [1], [], None)])], "book string, page int, ops array<struct<op:string,idx:array<int>,boxes:array<struct<x:int,y:int,w:int,h:int>>,by:string>>")
    links = make([("b", 4, [(1, [2, 0, 9]), (7, [1])])], "book string, page int, assign array<struct<caption_index:int,regions:array<int>>>")
    techniques, frames, captions = page_parse.parsed(pages, lines, regions, seed, operations=operations, links=links)
    got = {(r["page"], r["seq"]): r for r in techniques.collect()}
    assert {k: r["step_count"] for k, r in got.items()} == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (4, 1): 2}
    assert (got[1, 1]["name_romaji"], got[1, 1]["name_native"], got[1, 1]["slots"]["technique"]) == ("Shomenuchi Ikkyo", "正面打ち一教", "ikkyo")
    assert got[2, 1]["weapon"] == "jo" and got[2, 1]["slots"]["attack"] is None and got[4, 1]["name_romaji"] == "Ryotedori Kokyu Nage"
    order = [r["bbox"][1] for r in frames.filter("page = 4").orderBy("step_index").collect()]
    assert order == [30, 10]
    forced = make([("b", 1, "Own name", True), ("b", 4, "Late name", False)], "book string, page int, name string, suppress boolean")
    named = page_parse.parsed(pages, lines, regions, seed, forced=forced)[2].groupBy("page").agg(F.array_sort(F.collect_list("romaji")).alias("n")).collect()
    assert {r["page"]: r["n"] for r in named if r["page"] in (1, 4)} == {1: ["Own name"], 4: ["Late name", "Ryotedori Kokyu Nage", "Shomenuchi Ikkyo"]}


def test_parsed_names_and_numbers(spark):
    """Forms and qualifiers go through the merge and into the name; captions are numbered before those without boxes go; steps count by caption."""
    make = spark.createDataFrame
    pages = make([("b", i) for i in range(1, 7)], "book string, page int")
    seed = make([("b", 2, 3, "aiki-jo", "suburi", "jo", "31", 0), ("b", 5, 5, "taijutsu", "technique", None, None, 1)], "book string, first int, last int, context string, kind string, weapon string, form string, seq int")
    lines = make(
        [
            ("b", 1, 0, "四方投げ", 0), ("b", 1, 1, "Shiho-nage (Tachi dori)", 20),
            ("b", 2, 0, "突き", 10), ("b", 2, 1, "打ち", 500),
            ("b", 3, 0, "ただの ぶんしょう です", 10),
            ("b", 4, 0, "Ikkyo Omote", 0), ("b", 4, 1, "Ikkyo Omote", 500),
            ("b", 5, 0, "片手取り 呼吸投げ", 10), ("b", 5, 1, "Katate-dori Kokyu-nage", 15),
            ("b", 6, 0, "plain words", 5),
        ],
        "book string, page int, at long, text string, y0 int",
    )
    box = lambda *ys: [(0, y, 10, 10, "photo") for y in ys]
    regions = make([("b", 1, box(30)), ("b", 2, box(500)), ("b", 3, box(5)), ("b", 4, box(0, 20, 510)), ("b", 5, [(50, 10, 10, 10, "row"), (0, 12, 10, 10, None)]), ("b", 6, box(1))], f"book string, page int, boxes {overlay.BOXES}")
    books = make([("b", "Title", "person:a", "A", "1970s", "line")], "book string, full_title string, performer string, performer_name string, era string, lineage string")
    techniques, frames, captions = page_parse.parsed(pages, lines, regions, seed, books=books, images="out", retrieved="2024-01-01")
    got = {r["id"]: r for r in techniques.collect()}
    one = got["tech:b-p1-shiho-nage-tachi-dori"]
    assert (one["qualifiers"], one["slots"]["form"], one["name_native"], one["raw_caption"]) == (["Tachi dori"], ["tachi-dori"], "四方投げ", "四方投げ")
    assert one["source"].asDict() == {"book": "b", "title": "Title", "pdf_page": 1} and one["provenance"]["era"] == "1970s" and one["provenance"]["medium"] == "book"
    assert set(got) == {"tech:b-p1-shiho-nage-tachi-dori", "tech:b-p2-jo-suburi-2", "tech:b-p3-jo-suburi-1", "tech:b-p4-ikkyo-omote", "tech:b-p5-katate-dori-kokyu-nage"}
    assert got["tech:b-p2-jo-suburi-2"]["seq"] == 2 and got["tech:b-p3-jo-suburi-1"]["raw_caption"] == "aiki-jo jo suburi" and got["tech:b-p2-jo-suburi-2"]["form"] == "31"
    # two captions of one id: the later stays, with its own count; of its keyframes those that it has
    assert (got["tech:b-p4-ikkyo-omote"]["step_count"], got["tech:b-p4-ikkyo-omote"]["seq"], got["tech:b-p4-ikkyo-omote"]["keyframes"]) == (1, 2, ["kf:b-p4-ikkyo-omote-01"])
    shots = {r["id"]: r for r in frames.collect()}
    assert {k: (r["bbox"][1], r["step_count"]) for k, r in shots.items() if "p4" in k} == {"kf:b-p4-ikkyo-omote-01": (510, 1), "kf:b-p4-ikkyo-omote-02": (20, 2)}
    assert shots["kf:b-p1-shiho-nage-tachi-dori-01"]["image"] == "out/b/p1-shiho-nage-tachi-dori/step_01.png" and shots["kf:b-p1-shiho-nage-tachi-dori-01"]["retrieved"] == "2024-01-01"
    # one caption has all boxes as they are, not in reading order
    assert [(shots[f"kf:b-p5-katate-dori-kokyu-nage-0{i}"]["bbox"][0], shots[f"kf:b-p5-katate-dori-kokyu-nage-0{i}"]["granularity"]) for i in (1, 2)] == [(50, "row"), (0, "photo")]
    assert {(r["page"], r["cap"]): r["technique"] for r in captions.collect()} == {(1, 0): "shiho-nage", (2, 0): None, (2, 1): None, (3, 0): None, (4, 0): "ikkyo", (4, 1): "ikkyo", (5, 0): "kokyu-nage"}
    links = make([("b", 4, [(1, [0, 9]), (5, [1]), (0, [1])])], "book string, page int, assign array<struct<caption_index:int,regions:array<int>>>")
    linked = page_parse.parsed(pages, lines, regions, seed, links=links)[0].filter("page = 4").collect()
    assert [(r["id"], r["seq"], r["step_count"]) for r in linked] == [("tech:b-p4-ikkyo-omote", 2, 1)]
    forced = make([("b", 6, "Own (x)", True, ["q"], ["kumijo"], "ikkyo")], "book string, page int, name string, suppress boolean, qualifiers array<string>, form array<string>, technique string")
    own = page_parse.parsed(pages, lines, regions, seed, forced=forced)[0].filter("page = 6").collect()
    assert [(r["id"], r["slots"]["form"], r["slots"]["technique"]) for r in own] == [("tech:b-p6-own-x-q", ["kumijo"], "ikkyo")]
    drawn = make([("b", 6, [("manual", [], [(1, 2, 3, 4)], None)])], "book string, page int, ops array<struct<op:string,idx:array<int>,boxes:array<struct<x:int,y:int,w:int,h:int>>,by:string>>")
    assert page_parse.parsed(pages, lines, regions.filter("page <> 6"), seed, forced=forced, operations=drawn)[1].filter("page = 6").first()["bbox"] == [1, 2, 3, 4]
