"""The pipeline's stages in turn, each against a plain version on its own input."""

import re

import pytest

from tests.llm.test_minhash import brute as groups
from tests.llm.test_secrets import brute as found_secrets
from tests.llm.test_winnowing import brute as leaks

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "minhash_dedup", "decontamination", "secrets", "packing"]
    tables = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, tables[-1], sf).write.parquet(f"{tmp_path}/{k}")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}"))
    read = [{r["doc_id"]: r for r in t.collect()} for t in tables[:-1]]
    assert all(t.columns == columns for t in tables[:-1])

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = read[0].keys() - read[1].keys()
    assert all(len(read[0][i]["text"].split()) < 50 or labels.get(i, 0) == 0 or re.search(r"(.+)\n.*\1", read[0][i]["text"], re.S) for i in gone)
    assert not [i for i in read[1] if labels.get(i) == 0]

    comp = groups([(i, r["text"]) for i, r in read[1].items()])
    assert read[2].keys() == {i for i, (_, c) in comp.items() if c == i}

    clean = {x[0] for x in leaks([(i, r["text"]) for i, r in read[2].items()], items) if not x[5]}
    assert read[3].keys() == clean

    assert read[4].keys() == read[3].keys()
    for i, r in read[4].items():
        counts, _ = found_secrets(read[3][i]["text"])
        assert (r["text"] == read[3][i]["text"]) == (sum(counts) == 0)
        assert sum(found_secrets(r["text"])[0]) == 0 and r["n_chars"] == len(r["text"])

    pieces = tables[5].collect()
    assert {r["doc_id"] for r in pieces} == read[4].keys()
    assert all(0 < r["length"] and r["offset"] + r["length"] <= 4096 for r in pieces)
    whole = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)
    assert len(whole) == pipeline.run(spark, sf).count()


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b " * 60, None, "s", 240), (2, "a b " * 60, None, "s", 240)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, table, str(tmp_path)).count() >= 0


def test_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own results are handed on as they are."""
    names = ("kept", "n_words", "items", "spans", "score", "host", "row", "text_", "__row", "__id", "number", "changed", "id", "n", "component", "sequence_id")
    text = " ".join(f"Word{i % 60} of the text." for i in range(90)) + " password = abcdef123456"
    rows = [(1, text, "en", "s", len(text), *names), (2, text, "en", "s", len(text), *names), (3, text + " x", "en", "t", len(text) + 2, *([None] * len(names)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([("1", "some other words that are in no document of this table at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        found = sorted(got.collect(), key=lambda r: r["doc_id"])
        assert found if name == "minhash_dedup" else len(found) in (0, 3)
        for r in found:
            want = rows[r["doc_id"] - 1]
            assert tuple(r[n] for n in names) == tuple(want[5:]) and r["source"] == want[3]
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 3


def test_near_dedup_by_row(spark):
    """Ids that repeat or are null: one row of each group stays, and no text is lost."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (None, text(4)), (None, text(4)), (None, text(3)), (5, text(5) + " end"), (4, text(5))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, text(1)), (2, text(2)), (3, text(3)), (None, text(4)), (4, text(5))], key=str)


def test_packed_ids(spark):
    """Every piece has its token ids, of which the checksum was made."""
    pieces = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert pieces and all(len(r["ids"]) == r["length"] for r in pieces)
    assert len({tuple(r["ids"]) for r in pieces}) == len({r["ids_crc32"] for r in pieces})
