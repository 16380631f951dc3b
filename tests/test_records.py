"""Ids, merges, overlaps, entity resolution and relational views."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import entities, intervals, merge, relational
from loomline.operators.components import connected_components


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_slugs_and_ids(spark):
    for text, want in (("Mōrihei", "morihei"), ("Yoshimitsu Yamada", "yoshimitsu-yamada"), ("Kokyū Nage", "kokyu-nage"), ("  Ann-- ", "ann"), ("!!", "")):
        assert one(spark, S.slug(S.fold(F.lit(text)))) == want
        assert one(spark, S.slug(S.fold_latin(F.lit(text)))) == want
    assert one(spark, S.entity_id("person", F.lit("José Ruíz"))) == "person:jose-ruiz"
    assert one(spark, S.entity_id("person", F.lit("--"))) is None
    assert one(spark, S.tenure_id(F.lit("person:x"), F.lit("dojo:y"), F.lit("1960"))) == "tenure:x+y+1960"
    assert one(spark, S.tenure_id(F.lit("person:x"), F.lit("dojo:y"), F.lit(None))) == "tenure:x+y+unknown"
    assert one(spark, S.edge_id(F.lit("person:s"), F.lit("A B"))) == "edge:s+a-b"
    assert one(spark, S.rank_id(F.lit("person:p"), F.lit("2024-01-01"), F.lit(5))) == "rank:p+2024-01-01+5"


def test_small_scalars(spark):
    assert one(spark, S.split_names(F.lit("A B, C and D & E"))) == ["A B", "C", "D", "E"]
    assert one(spark, S.year_of(F.lit("1960"))) == 1960 and one(spark, S.year_of(F.lit("c. 1960"))) is None
    assert one(spark, S.dan_of(F.lit("8th Dan shihan"))) == 8 and one(spark, S.dan_of(F.lit("11th dan"))) is None
    assert one(spark, S.page_ranges(F.lit("12, 40-43,x,9-7"))) == [12, 40, 41, 42, 43]
    assert one(spark, S.script_of(F.lit("正面打ち ab"))) == "ja" and one(spark, S.script_of(F.lit("12"))) == "other" and one(spark, S.script_of(F.lit("abc 正"))) == "en"
    assert one(spark, S.range_label(F.lit(1955), F.lit(None))) == "1955-ongoing"
    assert one(spark, S.page_title(F.lit("/wiki/A_B%C3%A9+c#d"))) == "A Bé+c"
    assert one(spark, S.category_of(F.lit("Grabs and Holds"))) == "attack" and one(spark, S.category_of(F.lit("other"))) is None
    assert one(spark, S.kineme(F.lit("arm"), F.lit("L"), F.lit("raise"), F.lit("big"), F.lit("slow"))) == "arm.L : raise/big :: slow"
    assert one(spark, S.clean_name(F.lit("*Ann* (USA) "))) == "Ann"
    assert one(spark, S.box_union(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("xywh", b))) for b in ((0, 0, 10, 10), (20, 0, 10, 10)))))[:] == (0, 0, 30, 10)


RANK = {"inferred": 0, "stated": 1, "contested": 2}


def sequential(versions):
    out = None
    for v in versions:
        if out is None:
            out = dict(v, source=list(dict.fromkeys(v["source"] or [])))
            continue
        out["source"] = list(dict.fromkeys([*out["source"], *(v["source"] or [])]))
        out["retrieved"] = max(out["retrieved"] or "", v["retrieved"] or "") or None
        if v["confidence"] is not None and (out["confidence"] is None or RANK.get(v["confidence"], -1) > RANK.get(out["confidence"], -1)):
            out["confidence"] = v["confidence"]
        for c in ("notes", "anchor"):
            out[c] = v[c] if v[c] is not None else out[c]
    return out


RULES = {"source": "union", "retrieved": "max", "confidence": "strongest", "notes": "last", "anchor": "last"}


def test_merge_is_the_ordered_fold(spark):
    r = random.Random(1)
    rows = [
        {"id": r.randrange(40), "seq": i, "source": r.choice([None, [], ["a"], ["b", "a"], ["c", "b"]]), "retrieved": r.choice([None, "2024-01-01", "2023-05-05"]),
         "confidence": r.choice([None, "inferred", "stated", "contested", "odd"]), "notes": r.choice([None, "", "x", "y"]), "anchor": r.choice([None, True, False])}
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id long, seq long, source array<string>, retrieved string, confidence string, notes string, anchor boolean").repartition(7)
    got = {x["id"]: x.asDict() for x in merge.merge_by_key(df, "id", "seq", RULES).collect()}
    for key in {x["id"] for x in rows}:
        want = sequential([x for x in rows if x["id"] == key])
        assert {c: got[key][c] for c in RULES} == {c: want[c] for c in RULES}, key


def test_merge_again_changes_nothing(spark):
    df = spark.createDataFrame([(1, 0, ["u1"], "2024", "stated", "n", None), (1, 1, ["u2"], "2025", "inferred", None, True)], "id long, seq long, source array<string>, retrieved string, confidence string, notes string, anchor boolean")
    first = merge.merge_by_key(df, "id", "seq", RULES)
    again = merge.upsert(first, df, "id", "seq", RULES)
    assert first.collect() == again.collect()
    assert first.first()["confidence"] == "stated" and first.first()["source"] == ["u1", "u2"]


def test_nested_fields(spark):
    df = spark.createDataFrame([(1, 0, (5, None)), (1, 1, (None, "shihan")), (1, 2, None)], "id long, seq long, rank struct<dan:int,title:string>")
    assert tuple(merge.merge_by_key(df, "id", "seq", {"rank.dan": "last", "rank.title": "last"}).first()["rank"]) == (5, "shihan")


def tenures(spark, *rows):
    return spark.createDataFrame([(f"t{i}", *r) for i, r in enumerate(rows)], "id string, person string, dojo string, role string, start string, end string")


def test_copresence(spark):
    def pairs(*rows):
        return [(r["lo"], r["hi"], r["direction"]) for r in intervals.copresence(tenures(spark, *rows)).collect()]

    assert pairs(("f", "d", "founder", "1931", "1969"), ("s", "d", "uchi-deshi", "1955", "1964")) == [(1955, 1964, "a")]
    assert pairs(("a", "d", "student", "1931", None), ("b", "d", "student", "1955", None)) == [(1955, None, None)]
    assert pairs(("a", "d", "student", "1931", "1940"), ("b", "d", "student", "1941", None)) == []
    assert pairs(("a", "d", "student", "1931", "1940"), ("b", "d", "student", "1940", None)) == [(1940, 1940, None)]
    assert pairs(("a", "d", "student", None, None), ("b", "d", "student", "1940", None)) == []
    assert pairs(("a", "d", "student", "1931", "unclear"), ("b", "d", "student", "1930", None)) == []
    assert pairs(("a", "d", "student", "1931", None), ("a", "d", "founder", "1930", None), ("b", "e", "student", "1930", None)) == []


def test_copresence_against_all_pairs(spark):
    r = random.Random(4)
    rows = [(f"p{r.randrange(25)}", f"d{r.randrange(3)}", r.choice(["founder", "student", "uchi-deshi", "guest"]), str(1950 + r.randrange(30)), r.choice([None, "x", *(str(1950 + r.randrange(45)) for _ in range(6))])) for _ in range(90)]
    table = tenures(spark, *rows)
    stays = [(x["id"], x["person"], x["dojo"], int(x["start"]), 9999 if x["end"] is None else int(x["end"])) for x in table.collect() if x["end"] != "x"]
    want = sorted((a[0], b[0], max(a[3], b[3]), min(a[4], b[4])) for a in stays for b in stays if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and max(a[3], b[3]) <= min(a[4], b[4]))
    assert want == sorted((x["a_id"], x["b_id"], x["lo"], x["hi"] or 9999) for x in intervals.copresence(table).collect())


def test_teaching_edges(spark):
    rows = tenures(spark, ("t", "d1", "founder", "1950", "1960"), ("s", "d1", "student", "1955", None), ("t", "d2", "instructor", "1970", None), ("s", "d2", "uchi-deshi", "1971", "1972"))
    edge = intervals.teaching_edges(intervals.copresence(rows)).collect()
    assert len(edge) == 1
    assert (edge[0]["student"], edge[0]["teacher"], edge[0]["kind"], edge[0]["period"]) == ("s", "t", "uchi-deshi", "1955-1960")
    assert edge[0]["notes"] == "inferred from co-presence at d1 (1955-1960); inferred from co-presence at d2 (1971-1972)"


def test_inferred_edges_against_pairs(spark):
    """Equal to the edges made of a row for each pair, dates and sources that lack included."""
    r = random.Random(6)
    roles = ["founder", "instructor", "student", "uchi-deshi", "guest", None]
    rows = [
        (r.choice([None, *range(150)]) if i % 20 == 0 else 1000 + i, r.choice([None, *(f"p{k}" for k in range(12))]), r.choice([None, "d1", "d2", "d3"]), r.choice(roles), str(1950 + r.randrange(30)),
         r.choice([None, "x", *(str(1950 + r.randrange(45)) for _ in range(6))]), r.choice([[], ["u1"], ["u2", "u1"], ["u3", None], [f"v{i}"]]), r.choice([None, "2023-01-02", "2024-05-06"]))
        for i in range(400)
    ]
    table = spark.createDataFrame(rows, "id long, person string, dojo string, role string, start string, end string, source array<string>, retrieved string").dropDuplicates(["id"]).localCheckpoint()
    want = {x["id"]: x.asDict() for x in intervals.teaching_edges(intervals.copresence(table), table).collect()}
    got = intervals.inferred_edges(table)
    assert got.columns == intervals.teaching_edges(intervals.copresence(table), table).columns
    assert {x["id"]: x.asDict() for x in got.collect()} == want and len(want) > 50
    bare = table.drop("source", "retrieved")
    assert sorted(map(str, intervals.inferred_edges(bare).collect())) == sorted(map(str, intervals.teaching_edges(intervals.copresence(bare), bare).collect()))


def test_inferred_edges_move_stays_and_not_pairs(spark, tmp_path):
    """300 stays of a teacher and 300 of a student make 90,000 pairs; no operator hands on a row for each."""
    n = 300
    table = spark.range(2 * n).selectExpr("id", "if(id % 2 = 0, 't', 's') as person", "'d' as dojo", "if(id % 2 = 0, 'instructor', 'student') as role", "'1990' as start", "cast(null as string) as end")
    edges = intervals.inferred_edges(table)
    edge = edges.collect()
    assert len(edge) == 1 and edge[0]["notes"] == "; ".join(["inferred from co-presence at d (1990-ongoing)"] * (n * n))

    def nodes(plan):
        yield plan
        inner = [plan.executedPlan()] if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [plan.plan()] if hasattr(plan, "plan") and plan.getClass().getSimpleName().endswith("QueryStageExec") else []
        children = plan.children()
        for p in inner + [children.apply(i) for i in range(children.size())]:
            yield from nodes(p)

    rows = [m.get().value() for p in nodes(edges._jdf.queryExecution().executedPlan()) if (m := p.metrics().get("numOutputRows")).isDefined()]
    assert rows and max(rows) <= 4 * n


def test_edges_of_a_committed_map(spark):
    """The inferred edges of a map that is given as data: GOLDEN_MAP names a folder with tenures.json and edges.json."""
    import json
    import os
    import pathlib

    folder = pathlib.Path(os.environ.get("GOLDEN_MAP", "none"))
    if not folder.exists():
        pytest.skip("no such data here")
    stays, want = json.loads((folder / "tenures.json").read_text()), json.loads((folder / "edges.json").read_text())
    fields = ("id", "person", "dojo", "role", "start", "end", "source", "retrieved")
    rows = spark.createDataFrame([tuple(t.get(f) for f in fields) for t in stays], "id string, person string, dojo string, role string, start string, end string, source array<string>, retrieved string")
    got = {r["id"]: r for r in intervals.teaching_edges(intervals.copresence(rows), rows).collect()}
    inferred = [e for e in want if e["confidence"] == "inferred"]
    assert len(inferred) > 5
    for e in inferred:
        assert all(got[e["id"]][f] == e[f] for f in ("student", "teacher", "kind", "period", "notes", "source", "retrieved", "confidence", "status"))


def people(spark, *rows):
    return entities.tokens_of(spark.createDataFrame([(f"p{i}", n, x) for i, (n, x) in enumerate(rows)], "id string, name string, native string"), "id", "name", "native")


def found(spark, *rows):
    return {tuple(r["members"]): (r["tier"], r["canonical"]) for r in entities.listed(entities.clusters(people(spark, *rows))).collect()}


def test_cluster_tiers(spark):
    got = found(spark, ("William R. Ross", None), ("William Ross", None), ("Yoshimitsu Yamada", None), ("Y. Yamada Sensei", None), ("Ann Smith", None), ("Bob Smith", None))
    assert got == {("p0", "p1"): ("high", "p0"), ("p2", "p3"): ("medium", None)}
    got = found(spark, ("Andrew Demko", None), ("Andrew L. Demko", None), ("Andrew P. Demko", None))
    assert got == {("p0", "p1", "p2"): ("medium", None)}
    assert found(spark, ("Morihei Ueshiba", "植芝"), ("Ueshiba Kaiso Founder", "植芝")) == {("p0", "p1"): ("high", "p1")}
    assert found(spark, ("Ann Bee", None), ("Ann Bee", None), ("Ann Bee", None)) == {("p0", "p1", "p2"): ("high", "p2")}
    # a native name that one member lacks, and one that is empty
    assert found(spark, ("Ada Bell", "N1"), ("Ada Bell", None), ("Cora Dunn", "N1")) == {("p0", "p1", "p2"): ("medium", None)}
    assert found(spark, ("Eve Fox", ""), ("Gus Hill", ""), ("Ian Jay", "")) == {}
    assert found(spark, ("A. Smith", None), ("A. Smith", None)) == {("p0", "p1"): ("medium", None)}
    assert found(spark, ("A. Smith", "N2"), ("A. Smith", "N2")) == {("p0", "p1"): ("high", "p1")}
    assert found(spark, ("Ann L Bee", None), ("Ann Louise Bee", None), ("Ann Bee", None)) == {("p0", "p1", "p2"): ("high", "p1")}
    assert found(spark, ("Ann L Bee", None), ("Ann Max Bee", None)) == {("p0", "p1"): ("medium", None)}
    assert found(spark, ("Ann L M Bee", None), ("Ann L Bee", None)) == {("p0", "p1"): ("medium", None)}
    assert found(spark, ("Ann L Bee", "N3"), ("Ann P Bee", "N3"), ("Ann Bee", "N4")) == {("p0", "p1", "p2"): ("high", "p1")}
    assert found(spark, ("Mono", "N5"), ("Solo", "N5")) == {("p0", "p1"): ("high", "p1")}


def test_cluster_tiers_against_all_pairs(spark):
    """Random names with initials, middles and native names."""
    r = random.Random(12)
    rows = []
    for _ in range(260):
        middle = " ".join(r.choice(["L", "P", "Lou", "Pat"]) for _ in range(r.choice([0, 0, 1, 1, 2])))
        rows.append((" ".join(x for x in (r.choice(["Ann", "A", "Andy", "Bob"]), middle, f"S{r.randrange(40)}") if x), r.choice([None, None, None, "", f"N{r.randrange(30)}"])))
    tokens = [n.lower().split() for n, _ in rows]
    fits = lambda x, y: x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y))

    def tier(a, b):
        if a[-1] != b[-1] or not fits(a[0], b[0]):
            return None
        ma, mb = a[1:-1], b[1:-1]
        middles = not ma or not mb or len(ma) == len(mb) and all(map(fits, ma, mb))
        return "high" if a[0] == b[0] and len(a[0]) > 1 and middles else "medium"

    native = lambda i, j: bool(rows[i][1]) and rows[i][1] == rows[j][1]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if tier(tokens[i], tokens[j]) or native(i, j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    want = {}
    for members in groups.values():
        if len(members) > 1:
            high = all(native(i, j) or tier(tokens[i], tokens[j]) == "high" for i in members for j in members if i < j)
            best = max(members, key=lambda i: (len(tokens[i]), f"p{i}"))
            want[tuple(sorted(f"p{i}" for i in members))] = ("high", f"p{best}") if high else ("medium", None)
    assert found(spark, *rows) == want and {t for t, _ in want.values()} == {"high", "medium"}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (None, 3)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}


def test_absorb_and_repoint(spark):
    persons = spark.createDataFrame(
        [
            ("a", "William R. Ross", ["Bill"], ["u1"], "2024", False, None, None, "", "own", None, "x"), ("b", "William Ross", [], ["u2", "u1"], "2025", True, "1950", "N", "1999", "other", None, "y"),
            ("c", "Other", [], ["u3"], "2020", False, "", None, None, None, None, "z"), ("e", "W. Ross", None, ["u4"], "2019", None, "1951", "M", None, None, (4, "t"), "w"),
        ],
        "id string, name string, aliases array<string>, source array<string>, retrieved string, deceased boolean, born string, name_native string, died string, notes string, current_rank struct<dan:int,title:string>, status string",
    )
    mapping = spark.createDataFrame([("b", "a"), ("e", "a"), ("c", "gone")], "id string, canonical string")
    got = {r["id"]: r for r in merge.absorb(mapping, persons).collect()}
    assert set(got) == {"a", "c"}
    assert tuple(got["a"])[1:] == ("William R. Ross", ["Bill", "W. Ross", "William Ross"], ["u1", "u2", "u4"], "2025", True, "1950", "N", "1999", "own", (4, "t"), "x")
    mapping = mapping.filter("id = 'b'")
    edges = spark.createDataFrame([(0, "edge:b+x", "b", "x", ["s1"], "inferred"), (1, "edge:a+x", "a", "x", ["s0"], "stated"), (2, "edge:a+b", "a", "b", ["s2"], "stated"), (3, "edge:y+y", "y", "y", ["s3"], "stated")], "seq long, id string, student string, teacher string, source array<string>, confidence string")
    rules = {"student": "last", "teacher": "last", "source": "union", "confidence": "strongest"}
    moved = merge.rekey(edges, mapping, ["student", "teacher"], S.edge_id(F.col("student"), F.col("teacher")), rules, "seq", F.col("student") == F.col("teacher"))
    assert sorted(map(tuple, moved.collect())) == [("edge:a+x", "a", "x", ["s0", "s1"], "stated"), ("edge:y+y", "y", "y", ["s3"], "stated")]
    dojos = spark.createDataFrame([("d", "b", ["a", "b", "x"])], "id string, chief string, instructors array<string>")
    assert tuple(merge.repoint(dojos, mapping, ["chief"], ["instructors"]).first()) == ("d", "a", ["a", "x"])


def test_keep_and_replace(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 2, "c")], "id int, seq int, v string")
    assert {r["v"] for r in merge.keep_last(df, ["id"], F.col("seq")).collect()} == {"b", "c"}
    assert {r["v"] for r in merge.keep_first(df, ["id"], F.col("seq")).collect()} == {"a", "c"}
    fresh = spark.createDataFrame([(2, 0, "n")], df.schema)
    assert [r["v"] for r in merge.replace_partition(df, fresh, ["id"], "id", "seq").collect()] == ["a", "b", "n"]


def test_relational_projection(spark):
    from loomline.sources.tables import SCHEMAS

    make = lambda kind, *rows: spark.createDataFrame([{f: None for f in ()} | r for r in rows], SCHEMAS[kind])
    base = {"source": ["u1", "u2"], "retrieved": "2024-01-01", "status": "provisional"}
    c = {
        "persons": make("person", {"id": "p1", "name_romaji": "T", "aliases": ["X"], "current_rank": (8, "shihan"), "deceased": True, **base}, {"id": "p2", "name_romaji": "S", "aliases": [], **base}),
        "organizations": make("organization"), "dojos": make("dojo", {"id": "d1", "name": "D", "org": ["o1"], "location": ("C", "R", "USA"), "chief_instructor": "p1", "instructors": ["p2"], "anchor": True, "source": [], "status": "x"}),
        "rank_events": make("rank_event", {"id": "r1", "person": "p2", "dan": 5, "date": "2024-01-01", "dojo": "nowhere"}), "tenures": make("tenure", {"id": "t1", "person": "p1", "dojo": "d1", "role": "founder"}),
        "edges": make("edge", {"id": "e1", "student": "p2", "teacher": "p1", "kind": "student", "confidence": "stated"}, {"id": "e2", "student": "p2", "teacher": "missing"}),
    }
    tables = relational.project(c)
    relational.register_views(spark, tables)
    assert [tuple(r)[:4] for r in spark.table("v_lineage").collect()] == [("e1", "S", "T", "student")]
    assert tuple(spark.table("v_promotions").first()) == ("r1", "S", 5, "2024", None)
    assert spark.table("v_dojo").first()["chief_instructor"] == "T" and spark.table("v_tenure").count() == 1
    p1 = tables["persons"].filter("id = 'p1'").first()
    assert (p1["current_rank_dan"], p1["deceased"]) == (8, 1)
    assert tables["sources"].count() == 4 and tables["person_aliases"].count() == 1


@pytest.mark.parametrize("a, b, want", [("A. Demko", "Andrew Demko", "medium"), ("Andrew Demko", "Andrew Demko", "high"), ("Bob Demko", "Andrew Demko", None), ("Andrew X Demko", "Andrew X Y Demko", "medium"), ("Demko", "Demko", None)])
def test_pair_tier(spark, a, b, want):
    tokens = lambda n: S.name_tokens(S.fold(F.lit(n)))
    assert one(spark, entities.pair_tier(tokens(a), tokens(b))) == want
