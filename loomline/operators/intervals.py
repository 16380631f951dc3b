"""Stays at a place that overlap in time, and the relations that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.scalars import edge_id, range_label, year_of
from loomline.operators.merge import strength
from loomline.operators.overlay import holding
from loomline.storage import Scratch

#: Roles that teach and roles that learn; the end of a stay without one.
TEACHES = ("founder", "chief-instructor", "instructor")
LEARNS = ("uchi-deshi", "deshi", "student")
OPEN = 9999
#: Pairs of stays whose notes one task writes, and the most tasks.
PAIRS, TASKS = 1_000_000, 10_000


def direction(role_a: Column, role_b: Column) -> Column:
    """a if the first teaches the second, b for the reverse, null for peers."""
    return F.when(role_a.isin(*TEACHES) & role_b.isin(*LEARNS), "a").when(role_b.isin(*TEACHES) & role_a.isin(*LEARNS), "b")


def copresence(tenures: DataFrame) -> DataFrame:
    """Pairs of stays of different persons at one dojo that share a year.

    tenures(id, person, dojo, role, start, end, source, retrieved); years as strings or
    numbers.  Bounds are inclusive, a null end is open; a stay without a known start,
    or with an end that is no year, can't be placed.  Two stays share a year if the one
    that starts later starts within the other, so starts are met with stays by dojo and
    aligned spans of years: no pair is made that doesn't overlap.
    """
    low, high = year_of(F.col("start")), F.when(F.col("end").isNull(), OPEN).otherwise(year_of(F.col("end")))
    placed = tenures.select("id", "person", "dojo", "role", low.alias("lo"), high.alias("hi"), *(c for c in ("source", "retrieved") if c in tenures.columns)).filter("lo <= hi")
    fields = [c for c in placed.columns if c != "dojo"]
    side = lambda mark: [F.col(c).alias(f"{mark}_{c}") for c in fields]
    starts = placed.select("dojo", *side("s"), F.col("lo").alias("__start"))
    stays = placed.select("dojo", *side("t"), F.col("lo").alias("__first"), F.col("hi").alias("__last"))
    met = holding(starts, stays, ["dojo"], "__start", "__first", "__last")
    met = met.filter((F.col("s_id") != F.col("t_id")) & (F.col("s_person") != F.col("t_person")) & ((F.col("s_lo") > F.col("t_lo")) | (F.col("s_id") < F.col("t_id"))))
    first = F.col("s_id") < F.col("t_id")
    pairs = met.select("dojo", *(F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{z}_{c}") for z, x, y in (("a", "s", "t"), ("b", "t", "s")) for c in fields))
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    return pairs.withColumns({"lo": lo, "hi": F.when(hi < OPEN, hi), "direction": direction(F.col("a_role"), F.col("b_role"))})


def teaching_edges(pairs: DataFrame, tenures: DataFrame | None = None) -> DataFrame:
    """One inferred edge per student and teacher from the directional pairs.

    Pairs come by their dojo's first stay (its smallest id in ``tenures``; without
    them by the dojo), then by the stays' ids.  The period is the first pair's, notes
    are joined and sources united in this order, a pair's teacher first.
    """
    first = F.col("direction") == "a"
    pick = lambda c: (F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")), F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")))
    if tenures is not None:
        pairs = pairs.join(tenures.groupBy("dojo").agg(F.min("id").alias("__opens")), "dojo")
    (student, teacher), (role, _) = pick("person"), pick("role")
    seq = F.struct(*(["__opens"] if tenures is not None else []), "dojo", "a_id", "b_id")
    period = range_label(F.col("lo"), F.col("hi"))
    notes = F.concat(F.lit("inferred from co-presence at "), F.col("dojo"), F.lit(" ("), period, F.lit(")"))
    more = [c for c in ("source", "retrieved") if f"a_{c}" in pairs.columns]
    extra = {}
    if "source" in more:
        learner, master = pick("source")
        extra["source"] = F.array_distinct(F.concat(master, learner))
    if "retrieved" in more:
        extra["retrieved"] = F.greatest(*pick("retrieved"))
    each = pairs.filter("direction is not null").select(student.alias("student"), teacher.alias("teacher"), role.alias("role"), seq.alias("seq"), period.alias("period"), notes.alias("note"), *(v.alias(k) for k, v in extra.items()))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c])
    out = each.groupBy("student", "teacher").agg(
        F.when(F.bool_or(F.col("role") == "uchi-deshi"), "uchi-deshi").otherwise("direct-student").alias("kind"), F.min_by("period", "seq").alias("period"), F.array_join(ordered("note"), "; ").alias("notes"),
        *([F.array_distinct(F.flatten(ordered("source"))).alias("source")] if "source" in more else []), *([F.max("retrieved").alias("retrieved")] if "retrieved" in more else []),
    )
    ids = edge_id(F.col("student").cast("string"), F.col("teacher").cast("string"))
    return out.select(ids.alias("id"), "*", F.lit("inferred").alias("confidence"), F.lit("provisional").alias("status"))


def inferred_edges(tenures: DataFrame) -> DataFrame:
    """``teaching_edges(copresence(tenures), tenures)`` without a row for each pair of stays.

    The notes name every pair, so the result grows with their number, but what is
    shuffled doesn't: a person's stays at a dojo, on the side that teaches or the one
    that learns, are one row.  Rows of both sides are met by the years that they
    span, and each edge gets its two persons' stays.  Its pairs are made where it is
    written, those of one stay at a time.  A stay's first pair is with the other side's
    smallest id, so sources, period and date need no list of pairs.
    """
    scratch = Scratch(tenures.sparkSession)
    more = [c for c in ("source", "retrieved") if c in tenures.columns]
    low, high = year_of(F.col("start")), F.when(F.col("end").isNull(), OPEN).otherwise(year_of(F.col("end")))
    rows = tenures.select("id", "person", "dojo", "role", low.alias("lo"), high.alias("hi"), F.when(F.col("role").isin(*TEACHES), "t").when(F.col("role").isin(*LEARNS), "l").alias("side"), *more)
    fits = (F.col("lo") <= F.col("hi")) & F.col("side").isNotNull() & F.col("id").isNotNull()
    stay = F.when(fits, F.struct("id", "side", "lo", "hi", "role", *more))
    groups = scratch.cut(rows.groupBy("dojo", "person", "side").agg(F.min("id").alias("first"), F.min(stay["lo"]).alias("lo"), F.max(stay["hi"]).alias("hi"), F.sort_array(F.collect_list(stay)).alias("stays")), "stays")
    opens = groups.groupBy("dojo").agg(F.min("first").alias("opens"))
    spans = groups.filter("lo is not null and person is not null").select("dojo", "side", "person", "lo", "hi", F.size("stays").cast("long").alias("n"))
    starts = spans.select("dojo", "side", *(F.col(c).alias(f"s_{c}") for c in ("person", "lo", "hi", "n")))
    others = spans.select("dojo", F.when(F.col("side") == "t", "l").otherwise("t").alias("side"), *(F.col(c).alias(f"o_{c}") for c in ("person", "lo", "hi", "n")))
    met = holding(starts, others, ["dojo", "side"], "s_lo", "o_lo", "o_hi").filter((F.col("s_person") != F.col("o_person")) & ((F.col("s_lo") > F.col("o_lo")) | (F.col("side") == "t")))
    teaches = F.col("side") == "t"
    of = lambda c: (F.when(teaches, F.col(f"s_{c}")).otherwise(F.col(f"o_{c}")).alias(f"t_{c}"), F.when(teaches, F.col(f"o_{c}")).otherwise(F.col(f"s_{c}")).alias(f"l_{c}"))
    met = met.select("dojo", *of("person"), *of("lo"), *of("hi"), (F.col("s_n") * F.col("o_n")).alias("n")).join(opens, "dojo")
    # ids are made here, so rows with notes don't wait for Python
    met = scratch.cut(met.withColumn("id", edge_id(F.col("l_person").cast("string"), F.col("t_person").cast("string"))), "met")
    tasks = min(TASKS, 1 + (met.agg(F.sum("n")).first()[0] or 0) // PAIRS)

    def given(side: str, other: str) -> DataFrame:
        """Each edge's stays of one side that begin and end within reach of the other's."""
        own = groups.filter(F.col("side") == side).select("dojo", F.col("person").alias(f"{side}_person"), "stays").hint("merge")
        near = F.filter("stays", lambda s: (s["lo"] <= F.col(f"{other}_hi")) & (s["hi"] >= F.col(f"{other}_lo")))
        return met.join(own, ["dojo", f"{side}_person"]).select("id", F.col("l_person").alias("student"), F.col("t_person").alias("teacher"), F.struct("opens", "dojo", F.lit(side).alias("side"), near.alias("stays")).alias("p"))

    parts = given("l", "t").unionByName(given("t", "l")).repartition(tasks, "student", "teacher").groupBy("id", "student", "teacher").agg(F.sort_array(F.collect_list("p")).alias("p"))
    learn, teach = F.filter("p", lambda x: x["side"] == "l"), F.filter("p", lambda x: x["side"] == "t")
    dojos = parts.select("id", "student", "teacher", F.zip_with(learn, teach, lambda x, y: F.struct(x["dojo"].alias("dojo"), x["stays"].alias("l"), y["stays"].alias("t"))).alias("dojos"))
    shared = lambda a, b: range_label(F.greatest(a["lo"], b["lo"]), F.nullif(F.least(a["hi"], b["hi"]), F.lit(OPEN)))

    def stays_at(d: Column) -> Column:
        """Stays with a partner, in the order of their ids: the first pair, and notes of the pairs with later stays."""
        head = F.concat(F.lit("inferred from co-presence at "), d["dojo"], F.lit(" ("))

        def told(a: Column) -> Column:
            across = F.filter(F.when(a["side"] == "t", d["l"]).otherwise(d["t"]), lambda b: (b["lo"] <= a["hi"]) & (b["hi"] >= a["lo"]) & (b["id"] != a["id"]))
            line = lambda p: F.array_join(F.transform(F.filter(p, lambda b: b["id"] > a["id"]), lambda b: F.concat(head, shared(a, b), F.lit(")"))), "; ")
            # partners are sought once
            return F.transform(F.array(across), lambda p: F.struct(a.alias("s"), F.get(p, F.lit(0)).alias("b"), line(p).alias("notes")))[0]

        return F.filter(F.transform(F.array_sort(F.concat(d["l"], d["t"])), told), lambda x: x["b"].isNotNull())

    found = dojos.select("id", "student", "teacher", F.filter(F.transform("dojos", stays_at), lambda x: F.size(x) > 0).alias("dojos")).filter(F.size("dojos") > 0)
    extra = {}
    if "source" in more:
        pair = lambda x: (F.least(x["s"]["id"], x["b"]["id"]).alias("a"), F.greatest(x["s"]["id"], x["b"]["id"]).alias("b"), (x["s"]["side"] != "t").alias("learns"))
        listed = lambda d: F.flatten(F.transform(F.array_sort(F.transform(d, lambda x: F.struct(*pair(x), F.coalesce(x["s"]["source"], F.array().cast("array<string>")).alias("source")))), lambda x: x["source"]))
        extra["source"] = F.array_distinct(F.flatten(F.transform("dojos", listed)))
    if "retrieved" in more:
        extra["retrieved"] = F.array_max(F.transform("dojos", lambda d: F.array_max(F.transform(d, lambda x: x["s"]["retrieved"]))))
    live_in = F.exists("dojos", lambda d: F.exists(d, lambda x: x["s"]["role"] == "uchi-deshi"))
    start = F.col("dojos")[0][0]
    return found.select(
        "id", "student", "teacher", F.when(live_in, "uchi-deshi").otherwise("direct-student").alias("kind"), shared(start["s"], start["b"]).alias("period"),
        F.array_join(F.transform("dojos", lambda d: F.array_join(F.filter(F.transform(d, lambda x: x["notes"]), lambda n: n != ""), "; ")), "; ").alias("notes"), *(v.alias(k) for k, v in extra.items()),
        F.lit("inferred").alias("confidence"), F.lit("provisional").alias("status"),
    )


def keep_stated(edges: DataFrame) -> DataFrame:
    """The strongest confidence of each edge."""
    return edges.groupBy("student", "teacher").agg(F.max_by("confidence", strength(F.col("confidence"))).alias("confidence"))
