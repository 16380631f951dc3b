"""Queries of overlays, reports, review and revisions over documents, labels and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import overlay, report
from loomline.plans.base import query

_CORRECTIONS = """corrections as (
    select 'technique' as level, 6 as lv, doc_id as technique, null as book, null as section, 'q' || quality || 't' || toxic as payload, '2024-01-01' as date, doc_id as seq, doc_id % 13 = 0 as retired from labels
    union all select 'book', 2, null, 'src' || n_nationkey, null, 'book' || n_regionkey, '2024-02-0' || (1 + n_nationkey % 5), 1000000 + n_nationkey, n_nationkey % 7 = 0 from nation
    union all select 'section', 3, null, 'src' || n_nationkey, 'de', 'de' || n_nationkey, '2023-01-01', 2000000 + n_nationkey, false from nation
    union all select 'corpus', 1, null, null, ['en', 'fr', 'es', 'de', 'en'][1 + r_regionkey], r_name, '2025-01-01', 3000000 + r_regionkey, false from region
), matched as (
    select d.doc_id, payload, lv, date, seq from documents d join corrections c on
        (c.technique is null or c.technique = d.doc_id) and (c.book is null or c.book = d.source) and (c.section is null or c.section = d.lang) and not c.retired
)"""


def _corrections(t):
    none = lambda kind: F.lit(None).cast(kind)
    status = lambda c: F.when(c, "retired").otherwise("provisional").alias("status")

    def rows(df, level, doc, book, lang, payload, date, seq, retired):
        return df.select(F.lit(level).alias("level"), doc.alias("doc_id"), book.alias("source"), lang.alias("lang"), payload.alias("payload"), date.alias("date"), seq.cast("long").alias("seq"), status(retired), F.lit("verdict").alias("target"), F.lit("a").alias("author"))

    labels, nation, region = t("labels"), t("nation"), t("region")
    src = F.concat(F.lit("src"), "n_nationkey")
    langs = F.element_at(F.array(*map(F.lit, ("en", "fr", "es", "de", "en"))), F.col("r_regionkey") + 1)
    return (
        rows(labels, "technique", F.col("doc_id"), none("string"), none("string"), F.concat(F.lit("q"), "quality", F.lit("t"), "toxic"), F.lit("2024-01-01"), F.col("doc_id"), F.col("doc_id") % 13 == 0)
        .unionByName(rows(nation, "book", none("long"), src, none("string"), F.concat(F.lit("book"), "n_regionkey"), F.concat(F.lit("2024-02-0"), F.col("n_nationkey") % 5 + 1), F.col("n_nationkey") + 1000000, F.col("n_nationkey") % 7 == 0))
        .unionByName(rows(nation, "section", none("long"), src, F.lit("de"), F.concat(F.lit("de"), "n_nationkey"), F.lit("2023-01-01"), F.col("n_nationkey") + 2000000, F.lit(False)))
        .unionByName(rows(region, "corpus", none("long"), none("string"), langs, F.col("r_name"), F.lit("2025-01-01"), F.col("r_regionkey") + 3000000, F.lit(False)))
    )


def _matched(t):
    units = t("documents").select("doc_id", "source", "lang")
    return units, overlay.matching(units, _corrections(t), ["doc_id", "source", "lang"])


@query(f"with {_CORRECTIONS} select doc_id, payload, lv as level, date, seq from matched")
def overlay_matching(spark, t):
    return _matched(t)[1].select("doc_id", "payload", F.col("rank.level").alias("level"), F.col("rank.date").alias("date"), F.col("rank.seq").alias("seq"))


@query(f"""
    with {_CORRECTIONS}, won as (select doc_id, payload from matched qualify row_number() over (partition by doc_id order by lv desc, date desc, seq desc) = 1)
    select d.doc_id, coalesce(won.payload, d.lang) as value from documents d left join won using (doc_id)
""")
def overlay_override(spark, t):
    units, found = _matched(t)
    return overlay.override(found, units, "doc_id", F.col("lang")).select("doc_id", "value")


@query(f"""
    with {_CORRECTIONS}, firsts as (select doc_id, payload, min(lpad(cast(lv as varchar), 2, '0') || date || lpad(cast(seq as varchar), 12, '0')) as k from matched group by 1, 2)
    select d.doc_id, d.lang || coalesce(',' || f.p, '') as value from documents d left join (select doc_id, string_agg(payload, ',' order by k) as p from firsts group by 1) f using (doc_id)
""")
def overlay_additive(spark, t):
    units, found = _matched(t)
    arrays = found.withColumn("payload", F.array("payload"))
    return overlay.additive(arrays, units, "doc_id", F.array("lang")).select("doc_id", F.array_join("value", ",").alias("value"))


@query(f"with {_CORRECTIONS} select doc_id, string_agg(payload, '>' order by lv, date, seq) as ops from matched group by 1")
def overlay_compose(spark, t):
    return overlay.composed(_matched(t)[1], "doc_id").select("doc_id", F.array_join("payloads", ">").alias("ops"))


@query("""
    with r(first, last, name, seq) as (values (1, 10, 'front', 1), (8, 20, 'middle', 2), (15, 30, 'late', 3), (41, 45, 'back', 4)),
    f as (select p_partkey, p_size, name from part left join r on p_size between first and last qualify row_number() over (partition by p_partkey order by seq) = 1)
    select p_partkey, p_size, coalesce(name, 'rest') as section from f
""")
def range_lookup(spark, t):
    ranges = spark.createDataFrame([(1, 10, "front", 1), (8, 20, "middle", 2), (15, 30, "late", 3), (41, 45, "back", 4)], "first int, last int, name string, seq int")
    return overlay.range_lookup(t("part").select("p_partkey", "p_size"), ranges, [], "p_size").select("p_partkey", "p_size", F.coalesce("name", F.lit("rest")).alias("section"))


@query("""
    with stored as (select 'id' || n_nationkey as id, n_nationkey as seq, 'old' as payload from nation),
    moved as (select 'id' || r_regionkey * 3 as id, r_regionkey + (select max(seq) from stored) + 1 as seq, 'new' as payload from region)
    select id, seq, payload from (select * from stored union all select * from moved) qualify row_number() over (partition by id order by seq desc) = 1
""")
def upsert_corrections(spark, t):
    stored = t("nation").select(F.concat(F.lit("id"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("seq"), F.lit("old").alias("payload"))
    incoming = t("region").select(F.concat(F.lit("id"), F.col("r_regionkey") * 3).alias("id"), F.col("r_regionkey").alias("seq"), F.lit("new").alias("payload"))
    return overlay.upsert_corrections(stored, incoming)


@query("""
    select 'customers' as collection, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'parts', count(*) from part union all select 'documents', count(*) from documents
""")
def coverage_report(spark, t):
    return report.counts({"customers": t("customer"), "orders": t("orders"), "parts": t("part"), "documents": t("documents")})


@query("""
    with e as (
        select o_orderkey, list_sort(list_filter([
            case when o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'o_orderpriority: is not one of the values' end,
            case when o_totalprice not between 20000 and 400000 then 'o_totalprice: is out of range' end,
            case when not regexp_matches(o_orderstatus, '^[OF]$') then 'o_orderstatus: does not match' end], lambda x: x is not null)) as errors from orders
    ) select o_orderkey, array_to_string(errors, '; ') as errors from e where len(errors) > 0
""")
def validation_errors(spark, t):
    rules = [report.required("o_orderkey"), report.one_of("o_orderpriority", "1-URGENT", "2-HIGH", "3-MEDIUM"), report.between("o_totalprice", 20000, 400000), report.matches("o_orderstatus", "^[OF]$")]
    return report.validated(t("orders"), "o_orderkey", rules).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


@query("""
    select 0 as n, 'orders' as collection, cast(o_orderkey as varchar) as id from orders where o_orderstatus = 'P'
    union all select 1, 'lines', l_orderkey || '-' || l_linenumber || '-' || l_partkey from lineitem where l_returnflag = 'R'
""")
def contested_rows(spark, t):
    flag = lambda c, v: F.when(F.col(c) == v, "contested").otherwise("stated")
    return report.contested([
        ("orders", t("orders").select(F.col("o_orderkey").cast("string").alias("id"), flag("o_orderstatus", "P").alias("confidence"))),
        ("lines", t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), flag("l_returnflag", "R").alias("status"))),
    ])


def _verdicts(t):
    return t("labels").select("doc_id", F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("verdict"))


@query("""
    select coalesce(case when quality = 1 then 'confirmed' when quality = 0 then 'rejected' end, 'unreviewed') as verdict, count(*) as n from documents left join labels using (doc_id) group by 1
""")
def progress_by_verdict(spark, t):
    return report.progress(t("documents"), _verdicts(t), "doc_id")


@query("""
    select doc_id, source from documents where doc_id not in (select doc_id from labels) order by (source, doc_id) <= ('src3', 43), source, doc_id limit 1
""")
def next_unreviewed(spark, t):
    return report.next_unreviewed(t("documents").select("doc_id", "source"), t("labels"), "doc_id", ["source", "doc_id"], 43)


@query("""
    select d.doc_id, d.lang as original, coalesce(case when l.toxic = 1 then 'fixed' end, d.lang) as lang, coalesce(case when quality = 1 then 'confirmed' when quality = 0 then 'rejected' end, 'unreviewed') as verdict
    from documents d left join labels l using (doc_id)
""")
def reviewed_projection(spark, t):
    resolved = t("labels").select("doc_id", F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("verdict"), F.when(F.col("toxic") == 1, "fixed").otherwise("").alias("name"))
    return report.reviewed(t("documents").select("doc_id", "lang"), resolved, "doc_id", "lang").select("doc_id", "original", "lang", "verdict")


@query("select o_custkey, coalesce(bool_or(c_acctbal > 0), false) as present from (select distinct o_custkey from orders) left join customer on c_custkey = o_custkey and c_acctbal > 0 group by 1")
def key_split(spark, t):
    return report.key_split(t("orders"), "o_custkey", t("customer").filter("c_acctbal > 0"), "c_custkey")


@query("""
    select o_orderkey, case when o_orderstatus = 'P' then coalesce(c_mktsegment, '') else o_orderstatus end as status from orders left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey
""")
def backfill(spark, t):
    rows = t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"))
    source = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("status"))
    return report.filled_from(rows, source, ["o_custkey"], ["status"]).select("o_orderkey", F.coalesce("status", F.lit("")).alias("status"))


@query("""
    select source, count(*) as n, count(distinct nullif(doc_id % 50, 0)) as n_pages, min(nullif(doc_id % 50, 0)) as first_page, max(nullif(doc_id % 50, 0)) as last_page from documents group by 1
""")
def book_rollup(spark, t):
    return report.rollup(t("documents").select("source", (F.col("doc_id") % 50).alias("page")), "source", "page")


@query("""
    with m as (select doc_id as key, substr(sha256(case when doc_id % 3 = 0 then text else text || 'x' end), 1, 12) as hash, doc_id % 5 + 1 as rev, '2024-01-01' as date from documents where doc_id % 2 = 0),
    c as (select doc_id as key, substr(sha256(text), 1, 12) as hash from documents where doc_id % 10 <> 0)
    select key, coalesce(c.hash, m.hash) as hash, case when c.hash is not null and c.hash is distinct from m.hash then coalesce(rev, 0) + 1 else rev end as rev,
           case when c.hash is not null and c.hash is distinct from m.hash then '2025-05-05' else date end as date
    from m full join c using (key)
""")
def revision_bump_all(spark, t):
    """Odd ids have a current text only, multiples of 10 a manifest row only, all others both."""
    d = t("documents")
    h = lambda c: F.substring(F.sha2(c, 256), 1, 12)
    text = F.col("text")
    manifest = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), h(F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.concat(text, F.lit("x")))).alias("hash"), (F.col("doc_id") % 5 + 1).alias("rev"), F.lit("2024-01-01").alias("date"))
    return report.revisions(manifest, d.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("key"), h(text).alias("hash")), F.lit("2025-05-05"))
