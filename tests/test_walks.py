"""Domain-guarded walks against a plain queue, progress of streams, and names linked without pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import entities, layout, overlay
from loomline.operators.components import connected_components
from loomline.sources import articles
from loomline.streaming.progress import observed, watch


def page(domain, teachers, students):
    link = lambda n: f'<a href="/wiki/{n}">x</a>'
    style = "The  Art" if domain else "Other"
    return f'<table class="infobox"><tr><th>Style</th><td>{style}</td></tr><tr><th>Teacher</th><td>{"".join(map(link, teachers))}</td></tr><tr><th>Students</th><td>{"".join(map(link, students))}</td></tr></table>'


def queue_walk(graph, seeds, most):
    slug = lambda t: t.lower().replace("_", "-").replace(" ", "-").strip("-")
    queue, seen = list(seeds), {}
    while queue and len(seen) < most:
        title = queue.pop(0)
        key = slug(title)
        if not key or key in seen:
            continue
        known = graph.get(key)
        seen[key] = "missing" if known is None else "expanded" if known[0] else "boundary"
        if seen[key] == "expanded":
            queue += [n.replace("_", " ") for n in known[2]] + [n.replace("_", " ") for n in known[1]]
    return list(seen.items())


@pytest.mark.parametrize("most", [4, 100])
def test_walk_against_a_queue(spark, most):
    r = random.Random(most)
    names = [f"Ann_Bee{i}" for i in range(18)]
    graph = {n.lower().replace("_", "-"): (r.random() < 0.7, r.sample(names, 2), r.sample(names, r.randrange(3))) for n in names[:14]}
    rows = [(k.replace("-", " ").title(), f"u/{k}", page(*graph[k])) for k in graph] + [("Nil", "u", None)]
    pages = spark.createDataFrame(rows, "title string, url string, html string")
    seeds = spark.createDataFrame([("Ann Bee0", 0), ("Nil", 1), ("ann  bee0", 2), ("Ann Bee5", 3), ("---", 4)], "title string, seq int")
    graph = {k: v for k, v in graph.items()}
    want = queue_walk(graph, ["Ann Bee0", "Nil", "Ann Bee5"], most)
    persons, edges, nodes = articles.walked(pages, seeds, "art", most)
    got = [(x["node"], x["state"]) for x in nodes.orderBy("place").collect()]
    assert got == want
    expanded = [k for k, s in want if s == "expanded"]
    named = {f"person:{n.lower().replace('_', '-')}" for k in expanded for n in graph[k][1] + graph[k][2]} | {f"person:{k}" for k in expanded}
    assert {x["id"] for x in persons.collect()} == named
    assert edges.count() <= sum(len(graph[k][1]) + len(graph[k][2]) for k in expanded)


def test_progress(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    listener = watch(spark, "read", lambda name, done: told.append((name, done["rows"], done["total"])))
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = observed(stream, "read", total=F.sum("id")).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 20
        while not listener.ended and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [n for _, n, _ in told] == [10, 20, 30] and told[-1] == ("read", 30, sum(range(30))) and listener.error is None


def test_names_without_pairs(spark):
    """The same components as pairs give, in rows linear in the names."""
    r = random.Random(2)
    words = ["k", "ken", "kenji", "m", "mai", "b"]
    rows = [(f"p{i:03d}", [r.choice(words) for _ in range(r.randrange(3))] + [r.choice(["sato", "ito"])], r.choice([None, "", "佐藤", "伊藤"]) if r.random() < 0.1 else None) for i in range(60)]
    names = spark.createDataFrame(rows, "id string, tokens array<string>, native string")
    parts = lambda links: {(x["id"], x["component"]) for x in connected_components(links).collect()}
    assert parts(entities.name_links(names)) == parts(entities.candidate_pairs(names).select("a", "b"))
    many = spark.range(100_000).select(F.format_string("p%06d", "id").alias("id"), F.array(F.concat(F.lit("k"), F.col("id").cast("string")), F.lit("sato")).alias("tokens"), F.lit(None).cast("string").alias("native"))
    one = many.unionByName(spark.createDataFrame([("q", ["k", "sato"], None)], many.schema))
    assert entities.name_links(one).count() == 100_000 and entities.name_links(many).count() == 0


def test_hot_groups_in_parts(spark):
    """One group of all rows is numbered and halved in parts; ties and nulls too."""
    rows = spark.range(5000).select(F.lit(None).cast("string").alias("g"), (F.col("id") * 7919 % 5000).alias("v")).unionByName(spark.createDataFrame([("a", 3), ("a", 3), ("a", None), ("b", 1), ("b", 9), ("b", 4), ("b", 2)], "g string, v long"))
    got = layout.numbered(rows, ["g"], "v").collect()
    for g in (None, "a", "b"):
        own = sorted((x["n"], -1 if x["v"] is None else x["v"]) for x in got if x["g"] == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)
    assert {x["g"]: x["m"] for x in layout.upper_medians(rows, ["g"], "v", "m").collect()} == {None: 2500, "a": 3, "b": 4}
    assert layout.numbered(rows.limit(0), ["g"], "v").count() == 0 and layout.upper_medians(rows.limit(0), ["g"], "v", "m").count() == 0


def test_variants(spark):
    import json

    rows = [
        ('{"a":[1,2],"b":{"x":1,"y":[1]},"d":1}', ['{"a":[2,3,3],"b":{"x":2,"z":null},"d":null}', '{"c":[9],"b":5}']), (None, None), ("", ['{"q":"é"}', None]), ('{"a":1}', ['{"a":[1]}', '{"a":[[1],{"k":2}]}', '{"a":[[1],{"k":3}]}']),
        ('{"b":{"x":[1]}}', ['{"b":{"x":[2]}}', '{"b":[1]}', '{"b":{"k":1}}']),
    ]
    df = spark.createDataFrame(rows, "base string, payloads array<string>")
    out = df.select(overlay.joined_variants(F.col("base"), F.col("payloads")).alias("v"), overlay.joined_payloads("base", "payloads").alias("p"))
    assert all(json.loads(x["v"]) == json.loads(x["p"]) for x in out.collect())
    assert "Python" not in df.select(overlay.joined_variants(F.col("base"), F.col("payloads")).alias("v"))._jdf.queryExecution().toString()


def test_an_empty_payload_has_no_part(spark):
    none = F.lit(None).cast("string")
    key = overlay.payload_key(F.lit("lexicon.entry"), none, none)
    assert spark.range(1).select(overlay.correction_id(F.lit("lexicon.entry"), F.lit("a"), key=key)).first()[0] == "ref:lexicon.entry:a"
