"""Queries of lines, layout, lexicon, HTML and event windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import layout, lexicon, lines, overlay, page_parse
from loomline.sources import crawl, html
from loomline.plans.base import query
from loomline.storage import bound_batches
from loomline.streaming import upserts

_LINES = r"""l as (
    select doc_id, i - 1 as line_no, trim(x[i]) as line from (select doc_id, string_split(text, chr(10)) as x from documents) d, unnest(range(1, len(x) + 1)) as u(i)
), l2 as (select * from l where line <> '')"""


@query(f"with {_LINES} select doc_id, cast(line_no as integer) as line_no, sha256(line) as line from l2")
def text_lines(spark, t):
    return lines.lines_of(t("documents"), "doc_id", "text").withColumn("line", F.sha2("line", 256))


@query(f"""
    with {_LINES}, m as (select *, case when length(line) <= 14 then line end as h, case when length(line) > 14 and length(line) < 400 then length(line) end as e from l2),
    s as (select *, sum(case when h is not null then 1 else 0 end) over (partition by doc_id order by line_no) as section from m),
    c as (select *, first_value(h) over (partition by doc_id, section order by line_no) as heading, sum(case when h is null and e is null then 1 else 0 end) over (partition by doc_id, section order by line_no) as closed from s)
    select doc_id, cast(line_no as integer) as line_no, cast(section as bigint) as section, heading, cast(e as integer) as entry from c where section > 0 and closed = 0 and h is null and e is not null
""")
def sectioned_lines(spark, t):
    rows = lines.lines_of(t("documents"), "doc_id", "text")
    n = F.length("line")
    return lines.sectioned(rows, "doc_id", F.when(n <= 14, F.col("line")), F.when((n > 14) & (n < 400), n)).drop("line")


@query("""
    select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as asked from conversations
""")
def carried_forward(spark, t):
    return lines.carried(t("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked").drop("role")


@query("""
    with g as (select user_id, event_id, ts, value, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 36000000000, false) as s from events),
    i as (select *, sum(s::integer) over (partition by user_id order by ts, event_id) as island from g)
    select user_id, cast(island as bigint) as island, count(*) as n, max(value) as top from i group by 1, 2
""")
def gap_islands(spark, t):
    over = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(over).cast("timestamp")) > 36_000_000_000
    return layout.islands(t("events"), ["user_id"], ["ts", "event_id"], gap, "island").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("select p_brand, list_sort(list(p_size))[1 + len(list(p_size)) // 2] as middle from part group by 1")
def upper_median(spark, t):
    return layout.upper_medians(t("part").select("p_brand", "p_size"), ["p_brand"], "p_size", "middle")


@query("select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents")
def numbered_rows(spark, t):
    return layout.numbered(t("documents").select("source", "doc_id"), ["source"], "doc_id").withColumn("n", F.col("n").cast("long"))


@query("""
    with a as (select user_id, event_id as anchor, event_id as ay from events where event_type = 'purchase'), i as (select user_id, event_id as item, event_id as iy from events where event_type = 'click')
    select i.user_id, item, anchor from i left join a using (user_id) qualify row_number() over (partition by item order by abs(ay - iy), ay) = 1
""")
def nearest_anchor(spark, t):
    e = t("events").select("user_id", "event_id", "event_type")
    items = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("item"), F.col("event_id").alias("iy"))
    anchors = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor"), F.col("event_id").alias("ay"))
    return layout.nearest_anchor(items, anchors, ["user_id"], "item", "iy", "anchor", "ay")


@query("""
    with i as (select label, vec_id as i, cast(round(embedding[1] * 1000) as bigint) as cx, cast(round(embedding[2] * 1000) as bigint) as cy from embeddings)
    select i.label, i.i, min(b.i) as n from i left join i b on b.label = i.label and i.cx between b.cx - 60 and b.cx + 60 and i.cy between b.cy - 60 and b.cy + 60 group by 1, 2
""")
def box_holding_center_all(spark, t):
    at = lambda k: F.round(F.element_at("embedding", k).cast("double") * 1000).cast("long")
    items = t("embeddings").select("label", F.col("vec_id").alias("i"), at(1).alias("cx"), at(2).alias("cy"))
    boxes = items.select("label", F.col("i").alias("n"), (F.col("cx") - 60).alias("x"), (F.col("cy") - 60).alias("y"), F.lit(120).alias("w"), F.lit(120).alias("h"))
    return layout.box_holding_center(items, boxes, ["label"]).select("label", "i", "n")


@query("""
    select doc_id, case when c > 0 and c >= a then 'ja' when a > c then 'en' else 'other' end as script
    from (select doc_id, len(regexp_extract_all(text, '[A-Za-z]')) as a, len(regexp_extract_all(text, '[぀-ヿ一-鿿]')) as c from documents)
""")
def script_tags(spark, t):
    return t("documents").select("doc_id", S.script_of(F.col("text")).alias("script"))


@query()
def lexicon_classify(spark, t):
    bound_batches(spark)
    rows = lines.lines_of(t("documents"), "doc_id", "text").withColumn("found", lexicon.classify(F.col("line")))
    return rows.select("doc_id", "line_no", *(F.array_join(F.col("found")[s], ",").alias(s) for s in lexicon.SLOTS))


@query("""
    with terms as (select min(p_partkey) as term, split_part(p_name, ' ', 2) as kanji from part group by 2 union all select min(p_partkey), substr(split_part(p_name, ' ', 2), 1, 3) from part group by 2, split_part(p_name, ' ', 2)),
    one as (select min(term) as term, kanji from terms where kanji <> '' group by kanji)
    select p_partkey, term, kanji, row_number() over (partition by p_partkey order by length(kanji) desc, kanji) as n from part join one on contains(p_name, kanji)
""")
def glossary_retrieve(spark, t):
    p = t("part")
    word = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    terms = p.groupBy(word.alias("kanji")).agg(F.min("p_partkey").alias("term"))
    short = p.groupBy(F.substring(word, 1, 3).alias("kanji")).agg(F.min("p_partkey").alias("term"))
    return lexicon.retrieve_terms(p, "p_partkey", "p_name", terms.unionByName(short)).select("p_partkey", F.col("term").cast("long").alias("term"), "kanji", F.col("n").cast("long").alias("n"))


@query("""
    with s as (select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug, p_partkey as seq, p_name, p_brand, case when p_size > 40 then p_type end as english, p_type from part),
    b as (select slug, p_brand, min(seq) as k from s group by 1, 2)
    select s.slug, arg_min(p_name, seq) as romaji, any_value(x.kanji) as kanji, arg_min(english, seq) filter (english is not null) as english, arg_min(p_type, seq) as category
    from s join (select slug, string_agg(p_brand, ',' order by k) as kanji from b group by 1) x on x.slug = s.slug group by s.slug
""")
def merge_terms(spark, t):
    terms = t("part").select(
        S.slug(F.col("p_name")).alias("slug"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("romaji"), F.array("p_brand").alias("kanji"), F.array().cast("array<string>").alias("kana"),
        F.when(F.col("p_size") > 40, F.col("p_type")).alias("english"), F.col("p_type").alias("category"), F.lit("parts").alias("source"),
    )
    return lexicon.merge_terms(terms).select("slug", "romaji", F.array_join("kanji", ",").alias("kanji"), "english", "category")


@query(r"""
    select page_id, substr(sha256(url), 1, 16) as key, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, trim(regexp_replace(regexp_extract(url, '([^/#]*)(#.*)?$', 1), '_', ' ', 'g')) as title from pages
""")
def url_parts(spark, t):
    return t("pages").select("page_id", S.cache_key(F.col("url")).alias("key"), html.host(F.col("url")).alias("host"), F.trim(S.page_title(F.col("url"))).alias("title"))


@query()
def html_text(spark, t):
    return t("pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query()
def hint_links(spark, t):
    return html.hint_links(t("pages"), "page_id", "url", "html", hint=r"(?i)[a-z]")


@query()
def bounded_walk(spark, t):
    c = t("customer").select(F.col("c_custkey").alias("src"))
    n = t("customer").count()
    links = c.select("src", F.posexplode(F.array(*((F.col("src") * k + k * k) % n for k in (3, 7, 11)))).alias("at", "dst"))
    seeds = spark.createDataFrame([(1, 0), (5, 1)], "node long, seq int")
    return crawl.bounded_walk(seeds, links, c.filter("src % 4 <> 0").select(F.col("src").alias("node")), 60).select("node", "depth")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_counts(spark, t):
    return upserts.tumbling(t("events"), "ts", "1 hour", "10 minutes", "event_type").select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def _made_pages(t):
    """Pages of eight shapes by part: captions in two scripts, one caption, prose, no photo, two captions, null and noise, movements of a weapon with and without a caption."""
    k = F.col("p_partkey")
    pages = t("part").select(k.cast("int").alias("page"), F.lit("b").alias("book"), (k % 8).alias("k"), "p_name")
    shapes = {
        0: [("四方投げ", 0), ("Shiho-nage (Tachi dori)", 20)], 1: [("Shomenuchi Ikkyo Omote", 10)], 2: [("refer to Ikkyo", 10)], 3: [("Nikyo", 10)], 4: [("Ikkyo (x)", 0), ("Sankyo", 900)],
        5: [(None, 5), ("Kotegaeshi", 40), ("「小手返し」の ような もの です", 60)], 6: [("突き の 部", 1), ("(3) 突き", 20)], 7: [("この ときは した時の ような", 4)],
    }
    boxes = {0: [30], 1: [40, 20], 2: [10], 3: [], 4: [10, 890, 450], 5: [35], 6: [25], 7: [1, 300]}
    row = lambda i, x, y: F.struct(F.lit(i).cast("long").alias("at"), F.lit(x).cast("string").alias("text"), F.lit(y).alias("y0"))
    told = F.array(*(F.array(*(row(i, x, y) for i, (x, y) in enumerate(shapes[n]))) for n in range(8)))
    drawn = F.array(*(F.array(*(F.struct(F.lit(0).alias("x"), F.lit(y).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), F.lit("photo").alias("kind")) for y in boxes[n])).cast(overlay.BOXES) for n in range(8)))
    at = (F.col("k") + 1).cast("int")
    noise = F.struct(F.lit(9).cast("long").alias("at"), F.col("p_name").alias("text"), F.lit(2000).alias("y0"))
    texts = pages.select("book", "page", F.explode(F.array_append(F.element_at(told, at), noise)).alias("l")).select("book", "page", "l.*")
    regions = pages.select("book", "page", F.element_at(drawn, at).alias("boxes"))
    none = F.lit(None).cast("string")
    seed = pages.filter("k >= 6").select(
        "book", F.col("page").alias("first"), F.col("page").alias("last"), F.lit("aiki-jo").alias("context"), F.lit("suburi").alias("kind"), F.lit("jo").alias("weapon"), none.alias("form"), F.lit(0).alias("seq"),
    )
    return page_parse.parsed(pages.select("book", "page"), texts, regions, seed)


_SHAPES = """s(k, seq, slug, name, native, quals, technique, attack, direction, forms, kind, tops) as (values
    (0, 1, 'shiho-nage-tachi-dori', 'Shiho-nage', '四方投げ', 'Tachi dori', 'shiho-nage', null, null, 'tachi-dori', 'technique', [30]),
    (1, 1, 'shomenuchi-ikkyo-omote', 'Shomenuchi Ikkyo Omote', null, '', 'ikkyo', 'shomen-uchi', 'omote', '', 'technique', [40, 20]),
    (4, 1, 'ikkyo-x', 'Ikkyo', null, 'x', 'ikkyo', null, null, '', 'technique', [10]),
    (4, 2, 'sankyo', 'Sankyo', null, '', 'sankyo', null, null, '', 'technique', [450, 890]),
    (5, 1, 'kotegaeshi', 'Kotegaeshi', null, '', 'kote-gaeshi', null, null, '', 'technique', [35]),
    (6, 1, '3', '', '突き', '3', null, null, null, '', 'suburi', [25]),
    (7, 1, 'jo-suburi-1', '', null, '', null, null, null, '', 'suburi', [1, 300])), p as (
        select *, 'b-p' || p_partkey || '-' || slug as base from part join s on s.k = p_partkey % 8)"""


@query(f"""
    with {_SHAPES} select 'tech:' || base as id, p_partkey::integer as page, seq, name as name_romaji, native as name_native, quals as qualifiers, technique, attack, direction, forms, kind,
        case when k >= 6 then 'jo' end as weapon, len(tops)::integer as step_count from p
""")
def page_techniques(spark, t):
    found = _made_pages(t)[0]
    return found.select("id", "page", "seq", "name_romaji", "name_native", F.array_join("qualifiers", ",").alias("qualifiers"), "slots.technique", "slots.attack", "slots.direction", F.array_join("slots.form", ",").alias("forms"), "kind", "weapon", "step_count")


@query(f"""
    with {_SHAPES} select 'kf:' || base || '-0' || i as id, 'tech:' || base as technique, i::integer as step_index, len(tops)::integer as step_count, tops[i]::integer as top, attack from p, unnest(range(1, len(tops) + 1)) as u(i)
""")
def page_keyframes(spark, t):
    return _made_pages(t)[1].select("id", "technique", "step_index", "step_count", F.get("bbox", 1).alias("top"), "attack")


_WORDS = """w as (
    select cast(l_orderkey % 10 as varchar) as book, cast(l_orderkey as bigint) as page, l_linenumber % 2 as block, l_linenumber % 3 as line, l_partkey % 500 as x, l_linenumber % 6 * (20 + l_orderkey % 30) as y,
           10 + l_suppkey % 40 as wide, 10 + l_linenumber as high, case l_partkey % 6 when 0 then '四方' when 1 then '12' when 2 then ' ' else 'word' || l_linenumber end as text,
           case when l_quantity < 3 then -1 else 20 + (l_orderkey + l_linenumber % 6 * 7) % 80 end as conf
    from lineitem
), l as (
    select book, page, block, line, string_agg(text, ' ' order by x, y, text) as text, cast(min(x) as bigint) as x0, cast(min(y) as bigint) as y0, cast(max(x + wide) as bigint) as x1, cast(max(y + high) as bigint) as y1, cast(avg(conf) as double) as conf
    from w where trim(text) <> '' and conf >= 0 group by book, page, block, line
)"""


def _word_lines(t):
    """A word for each line of an order: six lines of a page in two blocks, in either script or without letters, some blank or not read."""
    n, order = F.col("l_linenumber"), F.col("l_orderkey")
    kind = F.col("l_partkey") % 6
    words = t("lineitem").select(
        (order % 10).cast("string").alias("book"), order.cast("bigint").alias("page"), (n % 2).alias("block"), F.lit(0).alias("par"), (n % 3).alias("line"),
        (F.col("l_partkey") % 500).cast("bigint").alias("left"), (n % 6 * (20 + order % 30)).cast("bigint").alias("top"), (10 + F.col("l_suppkey") % 40).cast("bigint").alias("width"), (10 + n).cast("bigint").alias("height"),
        F.when(kind == 0, "四方").when(kind == 1, "12").when(kind == 2, " ").otherwise(F.concat(F.lit("word"), n.cast("string"))).alias("text"),
        F.when(F.col("l_quantity") < 3, -1).otherwise(20 + (order + n % 6 * 7) % 80).cast("double").alias("conf"),
    )
    return layout.lines_of_words(words)


@query(f"with {_WORDS} select book, page, cast(block as integer) as block, cast(line as integer) as line, text, x0, y0, x1, y1, conf from l")
def word_lines(spark, t):
    return _word_lines(t).select("book", "page", F.col("block").cast("int").alias("block"), F.col("line").cast("int").alias("line"), "text", "x0", "y0", "x1", "y1", "conf")


@query(f"""
    with {_WORDS}, m as (select book, page, list_sort(list(y1 - y0))[count(*) // 2 + 1] as mid from l group by book, page),
    c as (select *, len(regexp_extract_all(text, '[一-鿿]')) as han, len(regexp_extract_all(text, '[A-Za-z]')) as latin from l join m using (book, page)),
    s as (select *, case when han > 0 and han >= latin then 'ja' when latin > han then 'en' end as known, case when y0 - lag(y1) over (partition by book, page order by y0, x0) > 1.8 * mid then 1 else 0 end as start from c),
    g as (select *, sum(start) over (partition by book, page order by y0, x0) as gap from s),
    k as (select *, last_value(known ignore nulls) over (partition by book, page, gap order by y0, x0 rows between unbounded preceding and 1 preceding) as before from g),
    p as (select *, sum(case when known <> before then 1 else 0 end) over (partition by book, page, gap order by y0, x0) as part from k),
    o as (
        select book, page, string_agg(text, chr(10) order by y0, x0) as text, min(x0) as x0, min(y0) as y0, max(x1) as x1, arg_max(y1, y0) as y1, avg(conf) as conf, coalesce(max(known), 'other') as lang, count(*) as n_lines
        from p group by book, page, gap, part
    )
    select book, page, cast(row_number() over (partition by book, page order by y0, x0) as integer) as block, text, x0, y0, x1, y1, round_even(conf, 1) as conf, lang, n_lines
    from o where length(regexp_replace(text, '\\s', '', 'g')) >= 4 and conf >= 30
""")
def text_passages(spark, t):
    """Every page's passages; means of at most six whole numbers, so what is cut lies on no half but a quarter."""
    return layout.passages(_word_lines(t), ["book", "page"]).select("book", "page", F.col("block").cast("int").alias("block"), "text", "x0", "y0", "x1", "y1", "conf", "lang", "n_lines")
