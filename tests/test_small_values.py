"""Rounding, names, links, defaults and listings."""

from pathlib import Path

from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import layout, review
from loomline.sources import tables


def test_tenths(spark):
    values = [k / 20 for k in range(18_000)] + [sum(range(a, a + n)) / n for a in range(0, 90) for n in range(1, 9)] + [0.0, 1e-300, 0.049999999999999996, 0.05, 0.15, 0.25, 30.25, 30.35, 99.95, 899.95]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for r in df.select("v", S.tenths(F.col("v")).alias("t")).collect():
        assert r["t"] == (None if r["v"] is None else round(r["v"], 1)), r["v"]


def test_passages_are_measured_without_white_space(spark):
    rows = [("b", 1, "a b c", 0, 0, 10, 10, 80.25), ("b", 2, "abcd", 0, 0, 10, 10, 80.35), ("b", 3, "abcd", 0, 0, 10, 10, 29.99), ("b", 4, " ab", 0, 0, 10, 10, 40.0), ("b", 4, "cd ", 0, 11, 10, 20, 40.5)]
    lines = spark.createDataFrame(rows, "book string, page int, text string, x0 int, y0 int, x1 int, y1 int, conf double")
    got = {r["page"]: (r["text"], r["conf"]) for r in layout.passages(lines, ["book", "page"]).collect()}
    assert got == {2: ("abcd", round(80.35, 1)), 4: ("ab\ncd", round(40.25, 1))}


def test_display_names_and_links(spark):
    rows = [("x\n_Mark \u00b7 A name \u00b7 rev 2_\n", "docs/01_a_b.md"), ("plain", "docs/01_02_long_title_here.md"), ("plain", "one.md"), ("plain", "a_b.c.md"), ("plain", "a_b"), ("plain", ".hidden")]
    df = spark.createDataFrame(rows, "text string, path string")
    got = [r[0] for r in df.select(S.display_name(F.col("text"), F.col("path"), "Mark")).collect()]
    assert got == ["A name"] + [Path(p).stem.split("_", 2)[-1].replace("_", " ") for _, p in rows[1:]]
    texts = ["![a](x/y.svg) [b](z.svg) [c](d.png)", "](.svg)", "(x.svg)", "](a.svg.svg)", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.raster_links(F.col("t"))).collect()]
    assert got == ["![a](x/y.png) [b](z.png) [c](d.png)", "](.svg)", "(x.svg)", "](a.svg.png)", None]


def test_kinemes(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"id": "a", "crosswalk": {"x": "y"}, "source": "s", "axes": []}\n{"id": "b"}\n')
    got = {r["id"]: r for r in tables.kinemes(spark.read.schema(tables.schema("kineme")).json(str(tmp_path / "k.json"))).collect()}
    assert (got["a"]["crosswalk"], got["a"]["source"], got["a"]["status"]) == ({"x": "y"}, "s", "provisional")
    assert (got["b"]["directions"], got["b"]["aikido_terms"], got["b"]["crosswalk"], got["b"]["source"], got["b"]["magnitude_scale"]) == ([], [], {}, tables.KINEME_SOURCE, None)


def test_sections_listed(spark):
    seed = spark.createDataFrame([("b", 5, 9, "jo", "k", None, None, None, 2), ("b", 1, 4, "ken", "k", "ken", None, "n", 1), ("c", 1, 2, "x", "k", None, None, None, 1)], tables.schema("section"))
    said = spark.createDataFrame([("r1", "b", "section", "active", 1), ("r2", "b", "section", "retired", 2), ("r3", "b", "note", "active", 3), ("r4", "c", "section", "active", 4), ("r5", "b", "section", None, 0)], "id string, book string, target string, status string, seq bigint")
    got = review.sections_listed(seed, said, "b").collect()
    assert [(r["origin"], r["section"]["context"] if r["section"] else r["refinement"]["id"]) for r in got] == [("seed", "ken"), ("seed", "jo"), ("refinement", "r5"), ("refinement", "r1")]
