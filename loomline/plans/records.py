"""Queries of names, corrections, regions, promotion lists, glossary sources, reviews and page bundles, on texts and boxes made of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import bundle, entities, lexicon, lines, overlay, promotions, report, review
from loomline.plans.base import query
from loomline.plans.linkage import _CLUSTERS, _names
from loomline.sources import directories, glossary, html, locators


@query(r"""
    select p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')*', '\([^)]*\)', '', 'g'), '\*', '', 'g')) as name,
           split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || '|' || p_brand as names, case when p_size <= 10 then p_size end as dan, (1950 + p_size) || '-01-01' as date,
           list_filter([p_size, p_size, p_size + 1, p_size + 2, p_size + 3], lambda x: x <= 30)::varchar as pages
    from part
""")
def name_parts(spark, t):
    size, word = F.col("p_size"), lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
    pages = S.page_ranges(F.format_string("%d,%d-%d", size, size, size + 3), F.lit(30))
    return t("part").select(
        "p_partkey", S.clean_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")*"))).alias("name"),
        F.array_join(S.split_names(F.concat(word(1), F.lit(", "), word(2), F.lit(" and "), "p_brand")), "|").alias("names"), S.dan_of(F.concat(size, F.lit("th dan holder"))).alias("dan"),
        S.year_date(size + 1950).alias("date"), F.concat(F.lit("["), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit("]")).alias("pages"),
    )


@query("""
    with c as (select doc_id, ['glossary.term', 'region.ops', 'name', 'section', 'text.ocr'][1 + doc_id % 5] as target, source, lang, doc_id % 40 as page from documents)
    select doc_id, 'ref:' || target || case doc_id % 5 when 2 then ':' || doc_id when 3 then ':' || source || ':p' || page || '-' || (page + 3) else ':' || source || ':p' || page end
           || case doc_id % 5 when 0 then ':tech-' || lang || '-no-' || (doc_id % 9) when 1 then ':merge-' || page || '-' || (page + 1) when 4 then ':b' || (doc_id % 3) else '' end || ':ann-b' as id
    from c
""")
def correction_ids(spark, t):
    k, page = F.col("doc_id"), F.col("doc_id") % 40
    target = F.element_at(F.array(*map(F.lit, ("glossary.term", "region.ops", "name", "section", "text.ocr"))), (k % 5 + 1).cast("int"))
    only = lambda n, c: F.when(k % 5 == n, c)
    book = F.when(k % 5 != 2, F.col("source"))
    key = overlay.payload_key(target, F.lit("Tech"), F.concat("lang", F.lit(" no. "), k % 9), F.lit("merge"), F.array(page, page + 1))
    made = overlay.correction_id(
        target, F.lit("Ann B."), book=book, pages=(only(3, page), only(3, page + 3)), page=F.when(~(k % 5).isin(2, 3), page), block=only(4, k % 3), technique=only(2, k), key=key,
    )
    return t("documents").select("doc_id", made.alias("id"))


@query("""
    with b as (select vec_id, label, cast(round(embedding[1] * 1000) as int) as x, cast(round(embedding[2] * 1000) as int) as y from embeddings)
    select vec_id, label % 3 as kind, case label % 3 when 0 then (x - 50) || ',' || y || ',' || 150 || ',' || 100 || ',row' when 1 then (x + 1) || ',' || (y + 1) || ',1,1,photo' else
        (x - 50) || ',' || y || ',40,100,cell;' || x || ',' || y || ',100,100,cell' end as boxes
    from b
""")
def region_ops(spark, t):
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000).cast("int")
    x, y, n = at(1), at(2), F.lit(None).cast("array<int>")
    box = lambda a, b, w, h: F.struct(a.alias("x"), b.alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    start = F.transform(F.array(box(x, y, 100, 100), box(x - 50, y, 40, 100), box(x, y + 500, 7, 7)), lambda b: b.withField("kind", F.lit("cell")))
    op = lambda name, idx=None, boxes=None, by=None: F.struct(F.lit(name).alias("op"), (F.array(*map(F.lit, idx)) if idx else n).alias("idx"), (F.array(*boxes) if boxes else F.array().cast("array<struct<x:int,y:int,w:int,h:int>>")).alias("boxes"), F.lit(by).alias("by"))
    drop = op("drop", [2])
    chosen = F.when(F.col("label") % 3 == 0, F.array(drop, op("merge", [0, 1]))).when(F.col("label") % 3 == 1, F.array(drop, op("manual", boxes=[box(x + 1, y + 1, 1, 1)]))).otherwise(F.array(drop, op("order")))
    done = overlay.region_ops(start, chosen)
    return t("embeddings").select("vec_id", (F.col("label") % 3).alias("kind"), F.array_join(F.transform(done, lambda b: F.concat_ws(",", b["x"], b["y"], b["w"], b["h"], b["kind"])), ";").alias("boxes"))


@query(r"""
    with d as (select doc_id, text || chr(10) || '_DOC · Name ' || doc_id || ' · rev ' || (doc_id % 9) || ' · 2024-0' || (1 + doc_id % 9) || '-01 · draft_' || chr(10) as t, text from documents)
    select doc_id, substr(sha256(regexp_replace(text, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f\x0b]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f\x0b]+$', '', 'g')), 1, 12) as hash,
           'Name ' || doc_id as name, '2024-0' || (1 + doc_id % 9) || '-01' as date
    from d
""")
def content_hash(spark, t):
    k = F.col("doc_id")
    text = F.concat(F.col("text"), F.lit("\n_DOC · Name "), k, F.lit(" · rev "), k % 9, F.lit(" · 2024-0"), k % 9 + 1, F.lit("-01 · draft_\n"))
    return t("documents").select("doc_id", S.content_hash(text, "DOC").alias("hash"), S.footer_name(text, "DOC").alias("name"), S.footer_date(text).alias("date"))


@query("""
    select c_custkey, case when c_custkey % 3 = 0 then 'A.' || c_mktsegment || ' Bee' when c_custkey % 3 = 1 then c_mktsegment end as name,
           ['vol', 'VOL2', '3', 'book-4'][1 + c_custkey % 4] as selector, lower(['vol', 'VOL2', '3', 'book-4'][1 + c_custkey % 4]) in ('book-' || (c_nationkey % 6), cast(c_nationkey % 6 as varchar), 'vol' || (c_nationkey % 6)) as chosen,
           case c_custkey % 3 when 0 then '/img/v1/' || c_custkey || '.png' when 1 then '/img/other/' || c_custkey end as image
    from customer
""")
def directory_entries(spark, t):
    k, v = F.col("c_custkey"), F.col("c_nationkey") % 6
    text = F.when(k % 3 == 0, F.concat(F.lit("A."), "c_mktsegment", F.lit(" Bee (chief)"))).when(k % 3 == 1, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    selector = F.element_at(F.array(*map(F.lit, ("vol", "VOL2", "3", "book-4"))), (k % 4 + 1).cast("int"))
    image = F.when(k % 3 == 0, F.concat(F.lit("/data/books/processed/v1/"), k, F.lit(".png"))).when(k % 3 == 1, F.concat(F.lit("other/"), k)).otherwise("")
    return t("customer").select("c_custkey", html.directory_name(text).alias("name"), selector.alias("selector"), bundle.selects_book(selector, F.concat(F.lit("book-"), v), v).alias("chosen"), bundle.image_url(image, "books/processed/").alias("image"))


#: A list for each nation: six headings of ranks, then one of titles; every customer stands once.
_PROMOTED = "e as (select c_custkey as k, c_nationkey as page, c_custkey % 7 as h, 'Ann' || (c_custkey // 2) || ' Bee' as name, 'Dojo ' || (c_custkey % 5) as place from customer)"


def _promotions(t):
    c, k = t("customer"), F.col("c_custkey")
    h = (k % 7).cast("int")
    line = F.format_string("Ann%d Bee - Dojo %d", F.floor(k / 2), k % 5)
    each = F.array_sort(F.collect_list(F.struct(h.alias("h"), k.alias("k"), line.alias("line"))))
    rows = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.array_join(F.concat(F.array(F.when(i < 6, F.concat((i + 1).cast("string"), F.lit("th Dan"))).otherwise("Shihan")), F.transform(F.filter("each", lambda e: e["h"] == i), lambda e: e["line"])), "\n"))
    texts = c.groupBy(F.col("c_nationkey").alias("page")).agg(each.alias("each")).select("page", F.array_join(rows, "\n\n").alias("text"), F.lit(2001).alias("year"), F.concat(F.lit("u"), "page").alias("url"), F.lit("2024-01-01").alias("retrieved"))
    return promotions.promotions(texts, "org:a", "org:b")


@query(f"""
    with {_PROMOTED} select page, 'rank:' || lower(replace(name, ' ', '-')) || '+2001-01-01+' || (h + 1) as id, 'person:' || lower(replace(name, ' ', '-')) as person, h + 1 as dan, '2001-01-01' as date,
        'dojo:' || lower(replace(arg_max(place, k), ' ', '-')) as dojo, 'org:a' as conferred_by, 'org:b' as via_org, 'u' || page as source
    from e where h < 6 group by page, name, h
""")
def promotion_events(spark, t):
    return _promotions(t)["rank_events"].select("page", "id", "person", F.col("dan").cast("long").alias("dan"), "date", "dojo", "conferred_by", "via_org", F.array_join("source", ",").alias("source"))


@query(f"""
    with {_PROMOTED} select page, 'person:' || lower(replace(name, ' ', '-')) as id, name as name_romaji, max(case when h = 6 then 'Shihan title conferred 2001.' end) as notes, 'provisional' as status from e group by page, name
""")
def promotion_persons(spark, t):
    return _promotions(t)["persons"].select("page", "id", "name_romaji", "notes", "status")


_CATEGORY = "case " + " ".join(f"when contains(lower({{0}}), '{w}') then '{c}'" for w, c in S.CATEGORIES) + " end"


@query("""
    select p_brand, p_name as romaji, '漢字' as kanji, case when p_size % 2 = 0 then 'かな' else '' end as kana, p_type as english, 'technique' as category
    from part where length(p_name) between 2 and 35 and not regexp_matches(p_name, '^(attacks?|techniques?|directions?|stances?|weapons?|counting|general|practice|body|terms?) ')
""")
def glossary_html(spark, t):
    row = F.concat(F.lit("<strong> "), "p_name", F.lit("</strong> &#8211; 漢字 ("), F.when(F.col("p_size") % 2 == 0, "かな").otherwise("x"), F.lit("): "), "p_type", F.lit("<br>"))
    own = t("part").filter(~F.col("p_name").rlike(glossary.LEADING))
    pages = own.groupBy("p_brand").agg(F.concat(F.lit("<html><script><strong>a</strong> - b<br></script><h3>All <b>Throws</b></h3><p>"), F.array_join(F.collect_list(row), "\n"), F.lit("</p>")).alias("html"))
    found = glossary.html_terms(pages, "p_brand", "html", "site")
    return found.select("p_brand", "romaji", F.array_join("kanji", ",").alias("kanji"), F.array_join("kana", ",").alias("kana"), "english", "category")


@query(f"""
    select p_partkey, p_name as romaji, p_type as english, coalesce({_CATEGORY.format('p_name')}) as category from part where length(p_name) between 2 and 35
    union all select p_partkey, 'Term', p_brand, coalesce({_CATEGORY.format("'Term'")}, {_CATEGORY.format('p_name')}) from part where length(p_brand) > 3
""")
def glossary_layout(spark, t):
    rows = t("part").select("p_partkey", F.lit(0).alias("line_no"), F.concat(F.lit("  "), "p_name", F.lit("    "), "p_type", F.lit("   Term  "), "p_brand", F.lit("  rest")).alias("line"))
    return glossary.layout_terms(rows, "p_partkey", "sheet").select("p_partkey", "romaji", "english", "category")


def _terms(t):
    p = t("part")
    return lexicon.merge_terms(p.select(
        S.slug(F.col("p_name")).alias("slug"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("romaji"), F.when(F.col("p_size") > 25, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("kanji"), F.array().cast("array<string>").alias("kana"),
        F.when(F.col("p_size") > 40, F.col("p_type")).alias("english"), F.col("p_brand").alias("category"), F.col("p_type").alias("source"),
    ))


_TERMS = """s as (select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, p_partkey as seq, p_type, p_brand, p_size > 25 as k, p_size > 40 as e from part),
    terms as (select slug, arg_min(p_brand, seq) as category, bool_or(k) as k, bool_or(e) as e from s group by 1)"""


@query(f"""
    with {_TERMS} select 'category' as what, category as value, count(*) as n from terms group by 2 union all select 'source', p_type, count(distinct slug) from s group by 2
    union all select 'with', 'kanji', count(*) filter (k) from terms union all select 'with', 'english', count(*) filter (e) from terms
""")
def glossary_histograms(spark, t):
    return glossary.histograms(_terms(t))


@query("""
    select p_brand as kanji, p_name as romaji, p_type as english from part where p_size > 10
    union all select 'k' || n_nationkey, n_name, 'land ' || n_regionkey from nation where n_regionkey <> 2
""")
def taught_spellings(spark, t):
    terms = t("part").select(F.col("p_partkey").alias("seq"), F.array("p_brand").alias("kanji"), F.col("p_name").alias("romaji"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("english"))
    taught = t("nation").select(F.col("n_nationkey").alias("seq"), F.when(F.col("n_regionkey") == 2, "retired").alias("status"), F.col("n_name").alias("romaji"), F.concat(F.lit("land "), "n_regionkey").alias("english"), F.array(F.concat(F.lit("k"), "n_nationkey"), F.lit("")).alias("kanji"))
    return glossary.spellings(terms, taught)


@query("""
    with r as (select user_id, event_id, event_type, round(value, 2) as v, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id) as record from events)
    select user_id, cast(record as bigint) as record, arg_max(v, event_id) filter (event_type = 'purchase') as purchase, arg_max(v, event_id) filter (event_type = 'click') as click from r where record > 0 group by 1, 2
""")
def label_records(spark, t):
    rows = t("events").select("user_id", "event_id", "event_type", F.round("value", 2).alias("v"))
    return lines.label_records(rows, "user_id", "event_id", "event_type", "v", "purchase", ["purchase", "click"])


@query("""
    select p_partkey, p_type as teacher, p_name as student from part union all select p_partkey, p_type, p_brand from part
""")
def edge_lines(spark, t):
    rows = t("part").select("p_partkey", F.concat(F.lit(" - "), "p_type", F.lit(" (org)* -> "), "p_name", F.lit(" (x), "), "p_brand", F.lit(", "), "p_type").alias("line"))
    return lines.edge_lines(rows).select("p_partkey", "teacher", "student")


@query("""
    select p_partkey, case p_size % 5 when 0 then 'shihan' when 1 then cast(p_size as varchar) when 2 then '5' end as kind from part
""")
def heading_kinds(spark, t):
    n = F.col("p_size")
    line = F.when(n % 5 == 0, "SHIHAN titles").when(n % 5 == 1, F.concat(n, F.lit("th Dan"))).when(n % 5 == 2, "Godan").when(n % 5 == 3, "Godan - Some place").otherwise(F.concat(F.lit("5th Dan, a line that is far "), "p_name"))
    return t("part").select("p_partkey", lines.heading_kind(line).alias("kind"))


@query("""
    select c_custkey, case when c_custkey % 3 < 2 then 'Spring ' || ['Hill', 'Field'][1 + c_custkey % 2] end as city, case when c_custkey % 3 = 0 then 'IL' end as region, case c_custkey % 3 when 0 then 'USA' when 1 then 'France' end as country from customer
""")
def locations(spark, t):
    k = F.col("c_custkey")
    city = F.concat(F.lit("Spring "), F.when(k % 2 == 0, "Hill").otherwise("Field"))
    text = F.when(k % 3 == 0, F.concat(F.lit("1 Main St\n"), city, F.lit(", IL 62701-1234\n+1 555 1234567"))).when(k % 3 == 1, F.concat(F.lit("2 Rue\n"), city, F.lit(",\nFrance"))).otherwise("nowhere")
    return t("customer").select("c_custkey", locators.location(text).alias("l")).select("c_custkey", "l.city", "l.region", "l.country")


@query("""
    with n as (select c_custkey, ['Ann', 'Bob', 'Carl'][1 + c_custkey % 3] || ' ' || ['Bell', 'Dunn', 'Fox', 'Hill'][1 + c_custkey % 4] as name, c_custkey % 2 = 0 as chief from customer)
    select c_custkey, name, case when chief then 'chief' else 'instructor' end as role from n union all select c_custkey, 'Ian Jay', 'instructor' from n
""")
def named_instructors(spark, t):
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    name = F.concat_ws(" ", pick(("Ann", "Bob", "Carl"), 3), pick(("Bell", "Dunn", "Fox", "Hill"), 4))
    line = F.when(k % 2 == 0, F.concat(F.lit("Chief Instructor: "), name)).otherwise(F.concat(F.lit("taught by Sensei "), name))
    page = F.concat(F.lit("<html><body><p>"), line, F.lit("</p><p>Ian Jay Sensei</p><p>Head Instructor Sensei</p></body></html>"))
    return html.instructors(t("customer").select("c_custkey", page.alias("html")), "c_custkey", "html")


@query("""
    with i as (select label, vec_id as i, cast(round(embedding[1] * 1000) as bigint) as cx, cast(round(embedding[2] * 1000) as bigint) as cy from embeddings),
    held as (select i.label, i.i, min(b.i) as n from i left join i b on b.label = i.label and i.cx between b.cx - 60 and b.cx + 60 and i.cy between b.cy - 60 and b.cy + 60 group by 1, 2)
    select 'v' as book, label as page, i as n, i in (select n from held) as assigned from i
""")
def assigned_regions(spark, t):
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000).cast("long")
    rows = t("embeddings").select(F.lit("v").alias("book"), F.col("label").alias("page"), F.col("vec_id").alias("n"), at(1).alias("cx"), at(2).alias("cy"))
    images = rows.select("book", "page", "n", (F.col("cx") - 60).alias("x"), (F.col("cy") - 60).alias("y"), F.lit(120).alias("w"), F.lit(120).alias("h"))
    frames = rows.select(F.col("n").alias("id"), "book", "page", F.array(F.col("cx") - 10, F.col("cy") - 20, F.lit(20), F.lit(40)).alias("bbox"))
    return bundle.assigned(images, bundle.placed_keyframes(frames, images)).select("book", "page", "n", "assigned")


@query(f"""
    with recursive {_CLUSTERS}, errs as (
        select o_orderkey, list_sort(list_filter([case when o_totalprice > 300000 then 'o_totalprice: is out of range' end, case when o_orderstatus = 'P' then 'o_orderstatus: does not match' end], lambda x: x is not null)) as e from orders)
    select 'validation' as kind, cast(o_orderkey as varchar) as id, array_to_string(e, '; ') as detail from errs where len(e) > 0
    union all select 'contested', cast(o_orderkey as varchar), 'orders' from orders where o_orderstatus = 'P'
    union all select 'merge-' || tier, cast(cluster as varchar), string_agg(cast(p.id as varchar), ', ' order by p.id) from out join placed p using (cluster) group by cluster, tier
""")
def review_queue(spark, t):
    o = t("orders")
    problems = report.validated(o.withColumn("id", F.col("o_orderkey")), "id", [report.between("o_totalprice", -1e12, 300000), report.matches("o_orderstatus", "^[OF]$")])
    flagged = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "contested").alias("status"))
    return report.review_queue(problems, [("orders", flagged)], entities.clusters(_names(t)))


@query("""
    select 'id' || n_nationkey as id, n_nationkey as seq, case when n_regionkey = 1 then 'confirmed' else 'provisional' end as status from nation where n_nationkey not in (select r_regionkey from region)
""")
def confirmed_corrections(spark, t):
    stored = t("nation").select(F.concat(F.lit("id"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("seq"), F.lit("provisional").alias("status"))
    named = t("nation").filter("n_regionkey = 1").select(F.concat(F.lit("id"), "n_nationkey").alias("id"))
    gone = t("region").select(F.concat(F.lit("id"), "r_regionkey").alias("id"))
    return overlay.removed(overlay.confirmed(stored, named), gone)


@query("""
    select doc_id as technique, case when quality = 1 then 'confirmed' else 'rejected' end as verdict, case when toxic = 1 then 'fixed' end as name, case when quality = 0 then 'note ' || doc_id end as note from labels
""")
def reviews(spark, t):
    said = F.array(
        F.struct(F.lit("verdict").alias("target"), F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("payload")), F.struct(F.lit("name").alias("target"), F.when(F.col("toxic") == 1, "fixed").alias("payload")),
        F.struct(F.lit("note").alias("target"), F.when(F.col("quality") == 0, F.concat(F.lit("note "), "doc_id")).alias("payload")),
    )
    rows = t("labels").select(F.col("doc_id").alias("technique"), F.inline(said)).filter("payload is not null").withColumns({"author": F.lit("a"), "status": F.lit("provisional"), "seq": F.col("technique")})
    return review.reviews(rows).select("technique", "verdict", "name", "note")


def _directory_pages(spark, t):
    """A directory page for each customer: four readers, each with a sound, a poor and a broken page."""
    k = F.col("c_custkey").cast("string")
    put = lambda text: F.replace(F.lit(text), F.lit("@"), k)
    pages = {
        ("headings", 0): "<ul><li><h3><a href='/dojos/x/'>House @</a></h3><dl><dt>Chief Instructors</dt><dd>Ann Bee</dd><dd>Carl Dee @</dd><dt>Address</dt><dd>1 St<br>Springfield, IL 62701</dd><dt>Website</dt><dd><a href='http://h@.org'>w</a></dd></dl></li></ul>",
        ("headings", 1): "<li><h3><a href='/dojos/y'>Hall @</a></h3><dl><dt>Address</dt><dd>2 Rue<br/>Lyon,<br/>France<dt>Website<dd>h@.fr",
        ("headings", 2): "<li><h3><a href='/about/'>No @</a></h3><h3>None</h3><dl><dt>Instructors</dt></dl>",
        ("table", 0): "<a href='/nation/usa/'>USA</a><a href='/nation/ohio/'>ohio</a><table><tr><th>Chief Instructor</th><td>Eve Fox</td></tr><tr><th>Affiliation</th><td><a href='/department/mid/'>Mid Federation (MF)</a></td></tr></table>",
        ("table", 1): "<tr><th>Affiliation</th><td><a href='/department/lake'>Lake Society</a></td></tr><tr><th>Website</th><td><a href=''>x</a></td></tr>", ("table", 2): "<tr><td>",
        ("blocks", 0): "<h1>Hill @</h1><div class='bde-text'>Gus Hale (6th dan)</div><div class='bde-text'><a href='https://maps.google.com/maps'>1 Rd<br>Austin, TX 78701</a></div><div class='a bde-text'><a href='https://b.org/@'>w</a></div>",
        ("blocks", 1): "<div class='bde-text'>tel 5</div><div class='bde-text'><a href='https://maps.app.goo.gl/1'>Calle<br>Madrid<br>Spain</a></div>", ("blocks", 2): "<p class='bde'>Gus Hale</p></div></div>",
        ("rows", 0): "<tr><td class='D'>Dojo Name</td><td class='D'>Lake @</td></tr><tr><td class='D'>Chief Instructor</td><td class='D'>Ida Jay, Kim Lee and Moe Noe</td></tr><tr><td class='D'>Address</td><td class='D'>5 St<br>Toronto, ON</td></tr>",
        ("rows", 1): "<tr><td class='D'>Dojo Name</td><td class='D'>Reno @</td></tr><tr><td class='D'>Address</td><td class='D'>Reno, NV</td></tr><tr><td class='D'>Dojo Name</td></tr>", ("rows", 2): "<tr><td class='D'>Address</td><td class='D'>Reno, NV</td></tr>",
    }
    keys = list(directories.READERS)
    html = F.coalesce(*(F.when((F.col("c_custkey") % 4 == keys.index(r)) & (F.floor(F.col("c_custkey") / 4) % 3 == n), put(text)) for (r, n), text in pages.items()))
    reader = F.element_at(F.array(*map(F.lit, keys)), (F.col("c_custkey") % 4 + 1).cast("int"))
    made = t("customer").select(reader.alias("directory"), reader.alias("reader"), html.alias("html"), F.concat(F.lit("u/"), k).alias("url"), F.concat(F.lit("Listed "), k).alias("name"), F.lit("2024-01-01").alias("retrieved"), F.col("c_custkey").alias("seq"))
    owners = spark.createDataFrame([*((d, None, f"org:{d}") for d in ("headings", "table", "rows")), ("blocks", "USA", "org:home"), ("blocks", None, "org:abroad")], "directory string, country string, org string")
    lineages = spark.createDataFrame([("table", "line", "org:table")], "directory string, lineage string, parent_org string")
    return directories.upserted({}, directories.records(directories.read_pages(made), owners, lineages))


_KINDS = "c as (select c_custkey as k, (c_custkey % 4) * 3 + (c_custkey // 4) % 3 as shape from customer)"


@query(f"""
    with {_KINDS}, d(shape, id, name, org, city, region, country, chief, instructors, website) as (values
        (0, 'house-', 'House ', 'org:headings', 'Springfield', 'IL', 'USA', 'person:ann-bee', 'person:carl-dee-@', 'http://h@.org'), (1, 'hall-', 'Hall ', 'org:headings', 'Lyon', null, 'France', null, '', null),
        (3, 'listed-', 'Listed ', 'org:table,org:mid-federation', null, 'Ohio', 'USA', 'person:eve-fox', '', null), (4, 'listed-', 'Listed ', 'org:table,org:lake-society', null, null, null, null, '', null),
        (5, 'listed-', 'Listed ', 'org:table', null, null, null, null, '', null),
        (6, 'hill-', 'Hill ', 'org:home', 'Austin', 'TX', 'USA', 'person:gus-hale', '', 'https://b.org/@'), (7, 'listed-', 'Listed ', 'org:abroad', null, null, 'Spain', null, '', null),
        (8, 'listed-', 'Listed ', 'org:home', null, null, null, null, '', null),
        (9, 'lake-', 'Lake ', 'org:rows', 'Toronto', 'ON', 'Canada', 'person:ida-jay', 'person:kim-lee,person:moe-noe', null), (10, 'reno-', 'Reno ', 'org:rows', 'Reno', 'NV', 'USA', null, '', null))
    select 'dojo:' || id || k as id, name || k as name, org, city, region, country, chief as chief_instructor, replace(instructors, '@', k::varchar) as instructors, replace(website, '@', k::varchar) as website from c join d using (shape)
""")
def directory_places(spark, t):
    found = _directory_pages(spark, t)["dojos"]
    return found.select("id", "name", F.array_join("org", ",").alias("org"), "location.city", "location.region", "location.country", "chief_instructor", F.array_join("instructors", ",").alias("instructors"), "website")


@query(f"""
    with {_KINDS}, n as (
        select 'person:carl-dee-' || k as id, 'Carl Dee ' || k as name, null as kind, k from c where shape = 0
        union all select p.id, p.name, p.kind, k from c join (values (0, 'person:ann-bee', 'Ann Bee', null), (3, 'person:eve-fox', 'Eve Fox', null), (3, 'org:mid-federation', 'Mid Federation (MF)', 'federation'), (4, 'org:lake-society', 'Lake Society', 'association'),
            (6, 'person:gus-hale', 'Gus Hale', null), (9, 'person:ida-jay', 'Ida Jay', null), (9, 'person:kim-lee', 'Kim Lee', null), (9, 'person:moe-noe', 'Moe Noe', null)) as p(shape, id, name, kind) using (shape))
    select id, name, kind, count(*) as pages from n group by all
""")
def directory_people(spark, t):
    found = _directory_pages(spark, t)
    persons = found["persons"].select("id", F.col("name_romaji").alias("name"), F.lit(None).cast("string").alias("kind"), "source")
    return persons.unionByName(found["orgs"].select("id", "name", F.col("type").alias("kind"), "source")).select("id", "name", "kind", F.size("source").cast("long").alias("pages"))
