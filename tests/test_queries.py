"""Every registered query against its SQL on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from loomline.operators import lexicon
from loomline.plans.registry import ORACLES, QUERIES
from loomline.storage import Scratch
from tests.test_documents import sequential


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(table, columns):
    out = []
    for r in table:
        out.append(tuple(round(v, 4) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert got.count() >= 0
        return
    want = db.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows((tuple(r) for r in got.select(*columns).collect()), columns) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_document_slug_whole(spark, tmp_path):
    """Documents that differ only behind the first 80 characters."""
    head = "same " * 20
    spark.createDataFrame([(1, head + "Über"), (2, head + "two"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["slug"] for r in QUERIES["document_slug_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: "same-" * 20 + "uber", 2: "same-" * 20 + "two", 3: None}


def test_box_holding_center_all(spark, tmp_path):
    """The only other box that holds item 7 is item 3's, which is no multiple of 10."""
    spark.createDataFrame([(7, 0, [0.5, 0.5]), (3, 0, [0.44, 0.56]), (10, 0, [0.9, 0.9]), (1, 1, [0.5, 0.5])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["label"], r["i"]): r["n"] for r in QUERIES["box_holding_center_all"](spark, str(tmp_path)).collect()}
    assert got == {(0, 7): 3, (0, 3): 3, (0, 10): 10, (1, 1): 1}


def test_revision_bump_all(spark, sf_dir):
    """Every document is on one side at least."""
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    got = QUERIES["revision_bump_all"](spark, sf_dir).collect()
    assert {r["key"] for r in got} == ids and len(got) == len(ids)


def test_lexicon_classify(spark, sf_dir, tmp_path):
    """Every line of the texts against the plain fold; kanji and spellings stand behind long prose too."""
    text = "prose " * 3000 + "\n\n  Shomen-uchi Ikkyo ura\n正面打ち四方投げ（表）\nnone\n" + "x " * 200 + "Kotegaeshi"
    spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kanji, latin = lexicon.seed()
    for folder in (str(tmp_path), sf_dir):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        want = {}
        for key, t in texts.items():
            for n, line in enumerate((t or "").split("\n")):
                if line.strip(" "):
                    met = sequential(line, kanji, latin)
                    want[key, n] = tuple(",".join(name for slot, name in met if slot == s) for s in lexicon.SLOTS)
        got = QUERIES["lexicon_classify"](spark, folder).collect()
        assert {(r["doc_id"], r["line_no"]): tuple(r[s] for s in lexicon.SLOTS) for r in got} == want and len(got) == len(want)
        if folder == str(tmp_path):
            assert want[1, 2][0] == "ikkyo" and want[1, 3][0] == "shiho-nage" and want[1, 5][0] == "kote-gaeshi"


def test_child_table(spark, db, tmp_path):
    """Products that only in single precision lie on a half, and halves on either side of zero."""
    x = [0.0025, -0.0025, 0.0015, 0.0005, -0.0005, 0.1235, 0.00749999983236194, 0.5]
    spark.createDataFrame([(1, [(k + 0.5) / 1000 for k in range(-2000, 2000)]), (2, x), (3, None), (4, [None, 0.25])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["vec_id"], r["pos"]): r["v"] for r in QUERIES["child_table"](spark, str(tmp_path)).collect()}
    want = db.sql(ORACLES["child_table"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet' as embeddings")).fetchall()
    assert got == {(k, i): v for k, i, v in want} and len(got) == 4010


@pytest.mark.parametrize("name", ["page_techniques", "page_keyframes"])
def test_pages_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    """Tables by page are joined by sorting, however small their files are; no page costs a call of its own."""
    plans = []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(self, df, label))
    plans.append(QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 6 and sum("SortMergeJoin" in p for p in plans) >= 3
    assert not [p for p in plans if "BroadcastHashJoin" in p or "FlatMapGroups" in p]
