"""Queries of ids, relational views, merges, overlaps and entity resolution over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import entities, intervals, merge, relational, report
from loomline.plans.base import query
from loomline.storage import bound_batches


@query("""
    select p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '-') as slug,
           'part:' || trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', '-', 'g'), '-') as id
    from part
""")
def entity_slug(spark, t):
    return t("part").select("p_partkey", S.slug(S.fold(F.col("p_name"))).alias("slug"), S.entity_id("part", F.col("p_name")).alias("id"))


@query("""
    select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents
""")
def document_slug_whole(spark, t):
    bound_batches(spark)
    return t("documents").select("doc_id", S.slug(S.fold(F.col("text"))).alias("slug"))


@query("""
    select o_orderkey, 'rank:' || o_custkey || '+' || strftime(o_orderdate, '%Y-%m-%d') || '+' || substr(o_orderpriority, 1, 1) as rank_id,
           'tenure:' || o_custkey || '+' || (o_custkey % 25) || '+' || case when o_orderstatus = 'F' then 'unknown' else strftime(o_orderdate, '%Y') end as tenure_id,
           'edge:' || o_custkey || '+' || (o_orderkey % 100) as edge_id
    from orders
""")
def composite_ids(spark, t):
    person, dojo = F.concat(F.lit("person:"), F.col("o_custkey")), F.concat(F.lit("dojo:"), F.col("o_custkey") % 25)
    start = F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "yyyy"))
    return t("orders").select(
        "o_orderkey", S.rank_id(person, F.date_format("o_orderdate", "yyyy-MM-dd"), F.substring("o_orderpriority", 1, 1)).alias("rank_id"),
        S.tenure_id(person, dojo, start).alias("tenure_id"), S.edge_id(person, F.concat(F.lit("person:"), F.col("o_orderkey") % 100)).alias("edge_id"),
    )


@query("""
    with named as (select o_orderpriority as p, o_orderdate as d, o_custkey as c from orders)
    select p as o_orderpriority, min(strftime(d, '%Y')) as first_year, max(strftime(d, '%Y')) as last_year, count(distinct strftime(d, '%Y')) as n_years,
           count(*) filter (c % 3 = 0) as have, count(*) filter (c % 3 <> 0) as missing
    from named group by p
""")
def year_span_and_coverage(spark, t):
    return t("orders").groupBy("o_orderpriority").agg(*report.year_span(F.col("o_orderdate")), *report.have_missing(F.col("o_custkey") % 3 == 0))


@query("""
    select c_custkey, list_filter(string_split_regex(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '' and x not in ('sensei', 'jr', 'sr'))[1] as first,
           len(list_filter(string_split_regex(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '')) as n
    from customer
""")
def name_tokens(spark, t):
    tokens = S.name_tokens(S.fold(F.col("c_name")))
    return t("customer").select("c_custkey", F.get(tokens, 0).alias("first"), F.size(tokens).cast("long").alias("n"))


@query("""
    select event_id, cast(json_extract(props, '$.k') as integer) as k, (event_type in ('error', 'click'))::integer as flag from events
""")
def flatten_struct(spark, t):
    rows = t("events").select("event_id", F.from_json("props", "k int").alias("p"), F.col("event_type").isin("error", "click").alias("flag"))
    flat = relational.flattened(rows, {"p": ("p", ("k",))}, ("flag",))
    return flat.select("event_id", F.col("p_k").alias("k"), "flag")


@query("""
    select vec_id, cast(i - 1 as integer) as pos, cast(round(embedding[i] * 1000) as bigint) as v
    from embeddings, unnest(range(1, len(embedding) + 1)) as u(i)
""")
def child_table(spark, t):
    rows = relational.child(t("embeddings"), "vec_id", "embedding", ("vec_id", "x"), "pos")
    return rows.select("vec_id", "pos", F.round(F.col("x") * F.lit(1000).cast("float")).cast("long").alias("v"))


@query("""
    with all_ids as (
        select 'part' as entity_type, cast(p_partkey as varchar) as entity_id, [p_name, p_brand] as source from part
        union all select 'supplier', cast(s_suppkey as varchar), [s_name] from supplier
        union all select 'customer', cast(c_custkey as varchar), [c_name, c_mktsegment] from customer
    ) select entity_type, entity_id, unnest(source) as url from all_ids
""")
def provenance_rows(spark, t):
    return relational.sources({
        "part": t("part").select(F.col("p_partkey").cast("string").alias("id"), F.array("p_name", "p_brand").alias("source")),
        "supplier": t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array("s_name").alias("source")),
        "customer": t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.array("c_name", "c_mktsegment").alias("source")),
    })


def _persons(t):
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name_romaji"))
    return c.unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name_romaji")))


_PERSONS = "persons as (select 'c' || c_custkey as id, c_name as name from customer union all select 's' || s_suppkey, s_name from supplier)"


@query(f"""
    with {_PERSONS}, edges as (
        select l_orderkey || '-' || l_linenumber || '-' || l_partkey as id, 'c' || o_custkey as student, 's' || l_suppkey as teacher, l_returnflag as kind, l_linestatus as confidence
        from lineitem join orders on o_orderkey = l_orderkey
    ) select e.id, s.name as student, x.name as teacher, kind, confidence from edges e join persons s on s.id = e.student join persons x on x.id = e.teacher
""")
def lineage_view(spark, t):
    edges = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("student"), F.concat(F.lit("s"), "l_suppkey").alias("teacher"),
        F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("confidence"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("notes"),
    )
    return relational.lineage_view(edges, _persons(t)).drop("period", "notes")


@query("""
    select o_orderkey as id, c_name as person, o_orderstatus as dan, strftime(o_orderdate, '%Y') as year, n_name as dojo
    from orders join customer on c_custkey = o_custkey left join nation on n_nationkey = o_orderkey % 40
""")
def promotions_view(spark, t):
    events = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("dan"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderkey") % 40).cast("int").alias("dojo"))
    return relational.promotions_view(events, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name_romaji")), t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("""
    select s_suppkey as id, s_name as name, n_name as loc_country, c_name as chief_instructor
    from supplier left join nation on n_nationkey = s_nationkey left join customer on c_custkey = s_suppkey * 20
""")
def dojo_view(spark, t):
    n = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("loc_country"))
    none = F.lit(None).cast("string")
    dojos = t("supplier").join(n, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), none.alias("loc_city"), none.alias("loc_region"), "loc_country", (F.col("s_suppkey") * 20).alias("chief_instructor"), none.alias("anchor"), none.alias("website"))
    return relational.dojo_view(dojos, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name_romaji"))).select("id", "name", "loc_country", "chief_instructor")


@query("""
    select l_orderkey || '-' || l_linenumber || '-' || l_partkey as id, s_name as person, p_name as dojo, l_returnflag as role, strftime(l_shipdate, '%Y') as start
    from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey
""")
def tenure_view(spark, t):
    rows = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("dojo"), F.col("l_returnflag").alias("role"), F.date_format("l_shipdate", "yyyy").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("confidence"))
    p, d = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name_romaji")), t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return relational.tenure_view(rows, p, d).select("id", "person", "dojo", "role", "start")


_EVENTS = """e as (select event_id, user_id, event_type, value, case when value > 20 then event_type end as last_big,
    case event_type when 'error' then 'contested' when 'purchase' then 'stated' when 'view' then 'inferred' end as conf from events)"""


@query(f"""
    with {_EVENTS}, u as (select user_id, event_type, min(event_id) as f from e group by 1, 2),
    ranked as (select user_id, conf, event_id, case conf when 'contested' then 2 when 'stated' then 1 else 0 end as r from e where conf is not null),
    s as (select user_id, conf, row_number() over (partition by user_id order by r desc, event_id) as n from ranked)
    select e.user_id, arg_max(last_big, event_id) filter (last_big is not null) as last_big, arg_min(last_big, event_id) filter (last_big is not null) as first_big,
           max(value) as value, any_value(x.types) as types, any_value(s.conf) as conf
    from e join (select user_id, string_agg(event_type, ',' order by f) as types from u group by 1) x on x.user_id = e.user_id left join s on s.user_id = e.user_id and s.n = 1
    group by e.user_id
""")
def merge_by_key(spark, t):
    conf = F.when(F.col("event_type") == "error", "contested").when(F.col("event_type") == "purchase", "stated").when(F.col("event_type") == "view", "inferred")
    big = F.when(F.col("value") > 20, F.col("event_type"))
    rows = t("events").select("user_id", "event_id", "value", big.alias("last_big"), big.alias("first_big"), F.array("event_type").alias("types"), conf.alias("conf"))
    out = merge.merge_by_key(rows, "user_id", "event_id", {"last_big": "last", "first_big": "first", "value": "max", "types": "union", "conf": "strongest"})
    return out.withColumn("types", F.array_join("types", ","))


@query("""
    with versions as (select -1 as seq, c_custkey as id, c_mktsegment as status, c_acctbal as bal from customer
        union all select o_orderkey, o_custkey, case when o_orderstatus <> 'P' then o_orderpriority end, o_totalprice from orders)
    select id, arg_max(status, seq) filter (status is not null) as status, max(bal) as bal from versions group by id
""")
def upsert_merge(spark, t):
    stored = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("bal"))
    incoming = t("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("status"), F.col("o_totalprice").alias("bal"))
    return merge.upsert(stored, incoming, "id", "seq", {"status": "last", "bal": "max"})


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def keep_last(spark, t):
    return merge.keep_last(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def keep_first(spark, t):
    return merge.keep_first(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


@query("""
    with fresh as (select c_custkey as k, 'new' as v from customer where c_custkey % 3 = 0)
    select o_custkey as k, o_orderpriority as v from orders where o_custkey not in (select k from fresh) union all select k, v from fresh
""")
def replace_partition(spark, t):
    fresh = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))
    return merge.replace_partition(t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v")), fresh, ["k"], "k", "v")


#: Stays: customers at a place of their nation, from their first to their last year of orders.
_TENURES = """tenures as (
    select c_custkey as id, c_custkey % 5000 as person, n_name || '/' || (c_custkey % 40) as dojo,
           case c_mktsegment when 'MACHINERY' then 'instructor' when 'HOUSEHOLD' then 'uchi-deshi' when 'BUILDING' then 'student' else 'member' end as role, lo,
           case when c_custkey % 7 = 0 then 9999 else hi end as hi, [c_mktsegment, 'r' || n_regionkey] as source, '2024-0' || (1 + c_custkey % 9) || '-01' as retrieved
    from customer join nation on n_nationkey = c_nationkey
    join (select o_custkey, min(year(o_orderdate)) as lo, max(year(o_orderdate)) as hi from orders group by 1) on o_custkey = c_custkey
)"""
_PAIRS = _TENURES + """, pairs as (
    select a.dojo, a.id as a_id, b.id as b_id, a.person as a_person, b.person as b_person, a.role as a_role, b.role as b_role, greatest(a.lo, b.lo) as lo, nullif(least(a.hi, b.hi), 9999) as hi,
           a.source as a_source, b.source as b_source, greatest(a.retrieved, b.retrieved) as retrieved,
           case when a.role = 'instructor' and b.role in ('uchi-deshi', 'student') then 'a' when b.role = 'instructor' and a.role in ('uchi-deshi', 'student') then 'b' end as direction
    from tenures a join tenures b on a.dojo = b.dojo and a.id < b.id and a.person <> b.person and greatest(a.lo, b.lo) <= least(a.hi, b.hi)
)"""


def _tenures(t):
    years = t("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("start"), F.max(F.year("o_orderdate")).alias("e"))
    role = F.when(F.col("c_mktsegment") == "MACHINERY", "instructor").when(F.col("c_mktsegment") == "HOUSEHOLD", "uchi-deshi").when(F.col("c_mktsegment") == "BUILDING", "student").otherwise("member")
    rows = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(years, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5000).alias("person"), F.concat_ws("/", "n_name", F.col("c_custkey") % 40).alias("dojo"), role.alias("role"), "start", F.when(F.col("c_custkey") % 7 != 0, F.col("e")).alias("end"),
        F.array("c_mktsegment", F.concat(F.lit("r"), "n_regionkey")).alias("source"), F.concat(F.lit("2024-0"), F.col("c_custkey") % 9 + 1, F.lit("-01")).alias("retrieved"),
    )


@query(f"with {_PAIRS} select dojo, a_id, b_id, lo, hi, direction from pairs")
def copresence_pairs(spark, t):
    return intervals.copresence(_tenures(t)).select("dojo", "a_id", "b_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "direction")


@query(f"""
    with {_PAIRS}, opens as (select dojo, min(id) as opens from tenures group by 1), d as (
        select *, case when direction = 'a' then b_person else a_person end as student, case when direction = 'a' then a_person else b_person end as teacher,
               case when direction = 'a' then b_role else a_role end as role, lo || '-' || coalesce(cast(hi as varchar), 'ongoing') as period,
               case when direction = 'a' then list_concat(a_source, b_source) else list_concat(b_source, a_source) end as sources
        from pairs join opens using (dojo) where direction is not null
    ), n as (select *, row_number() over (partition by student, teacher order by opens, dojo, a_id, b_id) as k from d),
    items as (select student, teacher, sources[i] as item, min(k * 4 + i) as w from n, unnest(range(1, 5)) as u(i) group by 1, 2, 3),
    united as (select student, teacher, string_agg(item, ',' order by w) as source from items group by 1, 2)
    select 'edge:' || student || '+' || teacher as id, student, teacher, max(period) filter (k = 1) as period,
           string_agg('inferred from co-presence at ' || dojo || ' (' || period || ')', '; ' order by k) as notes,
           case when bool_or(role = 'uchi-deshi') then 'uchi-deshi' else 'direct-student' end as kind, any_value(source) as source, max(retrieved) as retrieved, 'inferred' as confidence, 'provisional' as status
    from n join united using (student, teacher) group by student, teacher
""")
def copresence_edges(spark, t):
    return intervals.inferred_edges(_tenures(t)).withColumn("source", F.array_join("source", ","))


@query(f"with {_PAIRS} select dojo, count(*) filter (direction is not null) as directional, count(*) filter (direction is null) as peer from pairs group by 1")
def peer_and_directional(spark, t):
    return intervals.copresence(_tenures(t)).groupBy("dojo").agg(F.count_if(F.col("direction").isNotNull()).alias("directional"), F.count_if(F.col("direction").isNull()).alias("peer"))


@query("""
    with c as (select o_custkey as student, o_orderkey % 50 as teacher, case o_orderstatus when 'O' then 'inferred' when 'F' then 'stated' else 'contested' end as confidence from orders)
    select student, teacher, arg_max(confidence, case confidence when 'inferred' then 0 when 'stated' then 1 else 2 end) as confidence from c group by 1, 2
""")
def strongest_flag(spark, t):
    conf = F.when(F.col("o_orderstatus") == "O", "inferred").when(F.col("o_orderstatus") == "F", "stated").otherwise("contested")
    return intervals.keep_stated(t("orders").select(F.col("o_custkey").alias("student"), (F.col("o_orderkey") % 50).alias("teacher"), conf.alias("confidence")))


#: Names made of a first name, sometimes a middle initial, and a surname that some share.
_NAMES = """names as (
    select id, f, m, s, native, list_filter([f, m, s], lambda x: x is not null) as tokens from (
        select c_custkey as id, ['ann', 'a', 'bob', 'bobby', 'carl', 'c'][1 + c_custkey % 6] as f, case when c_custkey % 4 = 1 then ['l', 'p'][1 + (c_custkey // 4) % 2] end as m,
               'name' || (c_custkey // 5) as s, case when c_custkey % 10 = 3 then '' when c_custkey % 30 in (1, 6) then 'N' || (c_custkey // 10) end as native from customer)
)"""
_FIT = "(a.f = b.f or (length(a.f) = 1 and starts_with(b.f, a.f)) or (length(b.f) = 1 and starts_with(a.f, b.f)))"
_SAME = "coalesce(a.native <> '' and a.native = b.native, false)"
_LINKS = _NAMES + f""", links as (
    select a.id as a, b.id as b, case when length(a.f) > 1 and a.f = b.f and (a.m is null or b.m is null or a.m = b.m) then 'high' else 'medium' end as tier
    from names a join names b on a.s = b.s and a.id < b.id and {_FIT}
    union all select a.id, b.id, 'high' from (select native, min(id) as id from names where native <> '' group by 1) a join names b on a.native = b.native and a.id <> b.id
)"""


def _names(t):
    c = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    middle = F.when(c % 4 == 1, pick(["l", "p"], F.floor(c / 4) % 2))
    native = F.when(c % 10 == 3, "").when((c % 30).isin(1, 6), F.concat(F.lit("N"), F.floor(c / 10)))
    name = F.concat_ws(" ", F.initcap(pick(["ann", "a", "bob", "bobby", "carl", "c"], c % 6)), F.initcap(middle), F.concat(F.lit("Name"), F.floor(c / 5)))
    return entities.tokens_of(t("customer").select(c.alias("id"), name.alias("name"), native.alias("native")), "id", "name", "native")


@query(f"with {_LINKS} select a, b, tier from links")
def reconcile_pairs(spark, t):
    return entities.candidate_pairs(_names(t)).select("a", "b", "tier")


_CLUSTERS = _LINKS + f""", ends as (select a, b from links union select b, a from links), reach as (
    select a as id, a as root from ends union select ends.b, reach.root from reach join ends on ends.a = reach.id
), comp as (select id, min(root) as cluster from reach group by 1),
placed as (select comp.cluster, names.* from comp join names using (id)),
bad as (select distinct a.cluster from placed a join placed b on a.cluster = b.cluster and a.id < b.id where not {_SAME} and not (a.s = b.s and length(a.f) > 1 and a.f = b.f and (a.m is null or b.m is null or a.m = b.m))),
out as (select p.cluster, string_agg(cast(p.id as varchar), ',' order by p.id) as members, case when bool_or(bad.cluster is not null) then 'medium' else 'high' end as tier,
        arg_max(p.id, len(tokens) * 1000000000 + p.id) as best from placed p left join bad on bad.cluster = p.cluster group by 1)"""


@query(f"with recursive {_CLUSTERS} select p.id, cluster, tier, case when tier = 'high' then best end as canonical from out join placed p using (cluster)")
def reconcile_clusters(spark, t):
    return entities.clusters(_names(t))


@query(f"""
    with recursive {_CLUSTERS}, map as (select p.id, best as canonical from placed p join out on out.cluster = p.cluster where tier = 'high' and p.id <> best)
    select o_orderkey, coalesce(map.canonical, o_custkey) as o_custkey from orders left join map on map.id = o_custkey
""")
def repoint_references(spark, t):
    mapping = entities.clusters(_names(t)).filter("id <> canonical").select("id", "canonical")
    return merge.repoint(t("orders").select("o_orderkey", "o_custkey"), mapping, ["o_custkey"])


@query(f"""
    with recursive {_CLUSTERS}, map as (select p.id, best as canonical from placed p join out on out.cluster = p.cluster where tier = 'high' and p.id <> best),
    lists as (select o_orderkey, i, coalesce(map.canonical, x.v) as v from (select o_orderkey, i, [o_custkey, o_custkey // 2, o_custkey][i] as v from orders, unnest(range(1, 4)) as u(i)) x left join map on map.id = x.v),
    firsts as (select o_orderkey, v, min(i) as i from lists group by 1, 2)
    select o_orderkey, coalesce(max(map.canonical), max(o_custkey)) as chief, string_agg(cast(v as varchar), ',' order by i) as instructors
    from orders join firsts using (o_orderkey) left join map on map.id = o_custkey group by o_orderkey
""")
def repoint_arrays(spark, t):
    mapping = entities.clusters(_names(t)).filter("id <> canonical").select("id", "canonical")
    o = F.col("o_custkey")
    rows = t("orders").select("o_orderkey", o.alias("chief"), F.array(o, F.floor(o / 2).cast(t("orders").schema["o_custkey"].dataType), o).alias("instructors"))
    return merge.repoint(rows, mapping, ["chief"], ["instructors"]).withColumn("instructors", F.array_join("instructors", ","))


@query(f"""
    with recursive {_CLUSTERS}, map as (select p.id, best as canonical from placed p join out on out.cluster = p.cluster where tier = 'high' and p.id <> best),
    e as (select o_orderkey as seq, o_custkey as s0, 5 * (o_custkey // 5) + o_orderkey % 4 as t0, o_orderstatus as kind, o_orderpriority as src from orders),
    stored as (select min(seq) as seq, s0, t0, arg_max(kind, seq) as kind, string_agg(src, '|' order by k) as src from (select s0, t0, kind, src, seq, seq as k from e) group by s0, t0),
    moved as (select x.*, coalesce(a.canonical, s0) as student, coalesce(b.canonical, t0) as teacher, a.canonical is not null or b.canonical is not null as changed from stored x left join map a on a.id = s0 left join map b on b.id = t0)
    select 'edge:' || student || '+' || teacher as id, count(*) as n, arg_max(kind, changed::int * 1000000000000 + seq) as kind
    from moved where not (changed and student = teacher) group by student, teacher
""")
def rekeyed_edges(spark, t):
    mapping = entities.clusters(_names(t)).filter("id <> canonical").select("id", "canonical")
    s = F.col("o_custkey")
    e = t("orders").select(F.col("o_orderkey").alias("seq"), s.cast("long").alias("student"), (F.floor(s / 5) * 5 + F.col("o_orderkey") % 4).cast("long").alias("teacher"), F.col("o_orderstatus").alias("kind"))
    stored = e.groupBy("student", "teacher").agg(F.min("seq").alias("seq"), F.max_by("kind", "seq").alias("kind")).withColumn("n", F.array(F.col("seq").cast("long")))
    ids = S.edge_id(F.col("student").cast("string"), F.col("teacher").cast("string"))
    out = merge.rekey(stored.withColumn("id", ids), mapping, ["student", "teacher"], ids, {"kind": "last", "n": "union"}, "seq", F.col("student") == F.col("teacher"))
    return out.withColumn("n", F.size("n").cast("long"))


@query("""
    with p as (
        select o_orderkey as id, o_orderpriority as name, o_orderstatus as s, strftime(o_orderdate, '%Y-%m-%d') as retrieved, o_orderkey % 11 = 0 as deceased,
               case when o_orderkey % 3 = 0 then 'b' || o_orderkey when o_orderkey % 3 = 1 then '' end as born, case when o_orderkey % 4 = 2 then 'd' || o_orderkey end as died,
               case when o_orderkey % 5 = 1 then 'n' || o_orderkey else '' end as notes, case when o_orderkey % 7 = 3 then 'k' || o_orderkey end as name_native, case when o_orderkey % 2 = 0 then o_orderkey % 9 end as current_rank,
               min(o_orderkey) over w as own, first_value(o_orderpriority) over (w order by o_orderkey) as own_name
        from orders window w as (partition by o_custkey)
    ), src as (select own, s, min(case when id = own then 0 else 1 end * 1000000000 + id) as k from p group by 1, 2)
    select p.own as id, any_value(own_name) as name, coalesce(string_agg(distinct name, ',' order by name) filter (name <> own_name), '') as aliases,
           any_value(x.source) as source, max(retrieved) as retrieved, bool_or(deceased) as deceased, arg_min(born, id) filter (born <> '') as born, arg_min(died, id) filter (died <> '') as died,
           arg_min(notes, id) filter (notes <> '') as notes, arg_min(name_native, id) filter (name_native <> '') as name_native, arg_min(current_rank, id) filter (current_rank is not null) as current_rank
    from p join (select own, string_agg(s, ',' order by k) as source from src group by 1) x on x.own = p.own group by p.own
""")
def absorb_clusters(spark, t):
    o, k = t("orders"), F.col("o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("canonical"))
    clusters = o.join(first, "o_custkey").select(k.alias("id"), "canonical")
    made = lambda letter, m, r: F.when(k % m == r, F.concat(F.lit(letter), k))
    persons = o.select(
        k.alias("id"), F.col("o_orderpriority").alias("name"), F.array().cast("array<string>").alias("aliases"), F.array("o_orderstatus").alias("source"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("retrieved"), (k % 11 == 0).alias("deceased"), F.when(k % 3 == 1, "").otherwise(made("b", 3, 0)).alias("born"), made("d", 4, 2).alias("died"),
        F.coalesce(made("n", 5, 1), F.lit("")).alias("notes"), made("k", 7, 3).alias("name_native"), F.when(k % 2 == 0, k % 9).alias("current_rank"),
    )
    out = merge.absorb(clusters, persons)
    return out.withColumns({"aliases": F.array_join("aliases", ","), "source": F.array_join("source", ",")})
