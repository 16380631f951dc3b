"""Statistics against plain Python, verdicts against labels, estimates against known rates."""

import math
from collections import Counter

import numpy as np
import pytest

from loomline.llm import ordinal
from loomline.llm.ordinal import fit, op10_ordinal, score, train
from loomline.llm.quality_rules import estimate, judge, op2_quality_rules, posterior

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    for s in SPACES:
        text = text.replace(s, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    words = split(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_statistics(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_quality_rules(spark, sf_dir).collect():
        assert tuple(r[1:7]) == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_edges(spark):
    texts = [None, "", " \n\x0b", "a\nb\na\n \n \nb", "é# " * 60, "x " * 100_000, "\u00a0a\u2003b c", "a b c a b c"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] + [(None, None, None)], "doc_id bigint, text string, kept string")
    got = {r["doc_id"]: r for r in judge(df, keep=("text",)).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(texts):
        assert tuple(got[i][n] for n in names) == brute(t)
        assert got[i]["row"]["text"] == t
    assert judge(df.limit(0)).count() == 0


def labelled(spark, df, sf):
    return {r["doc_id"]: r for r in df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()}


def test_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r for r in labelled(spark, op2_quality_rules(spark, sf), sf).values() if not r["base_failed"]]
    clean, junk = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in clean]) > 0.97
    assert np.mean([not r["kept"] for r in junk]) > 0.95


def test_estimate():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    up, down = np.array([[0.8, 0.6, 0.0], [0.2, 0.3, 0.0]]), np.array([[0.02, 0.01, 0.005], [0.5, 0.4, 0.3]])
    k = np.where(good, 0, 1)
    u = rng.random((20000, 3))
    votes = np.where(u < down[k], -1, np.where(u < (down + up)[k], 1, 0))
    patterns = Counter(map(tuple, votes))
    table = np.array(list(patterns), float)
    model = estimate(table, np.array(list(patterns.values()), float))
    assert (model[2][1] > 5 * model[2][0]).all() and model[1][0, 0] > 2 * model[1][1, 0]
    assert np.mean((posterior(votes, model) >= 0.5) == good) > 0.85


def test_ordinal_fit():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        rows.append(np.unique(np.append(rng.integers(100, 400, 20), [g] if rng.random() < 0.9 else [])).astype(np.int32))
        grades.append(g)
    weights, thresholds = fit(rows, np.array(grades))
    assert thresholds[0] < thresholds[1]
    assert weights[0] < weights[1] < weights[2]
    assert fit([], np.array([], int))[0].sum() == 0


def test_ordinal_against_plain_descent(monkeypatch):
    """Weights and thresholds minimise the penalised likelihood: plain descent on numerical slopes from them finds nothing better."""
    monkeypatch.setattr(ordinal, "DIMENSIONS", 6)
    monkeypatch.setattr(ordinal, "STEPS", 4000)
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(60)]
    grades = np.array([min(2, int((3 in r) + (4 in r) + (rng.random() < 0.2))) for r in rows])

    def loss(p):
        w, cut = p[:6], np.array([p[6], p[6] + math.exp(p[7])])
        total = 0.0
        for r, g in zip(rows, grades):
            tail = [1.0, *(1 / (1 + math.exp(c - sum(w[i] for i in r))) for c in cut), 0.0]
            total -= math.log(tail[g] - tail[g + 1])
        return total / len(rows) + ordinal.DECAY / 2 * sum(x * x for x in w)

    weights, thresholds = fit(rows, grades)
    found = loss(np.array([*weights, thresholds[0], math.log(thresholds[1] - thresholds[0])]))
    p = np.array([0.0] * 6 + [0.0, 0.0])
    for _ in range(3000):
        slope = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in 1e-5 * np.eye(8)])
        p = p - 0.8 * slope
        if np.abs(slope).max() < 1e-5:
            break
    assert found <= loss(p) + 1e-3


def test_ordinal_held_out(spark):
    """Trained on the labels of even ids, right on odd ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ratings = labels.selectExpr("doc_id", "quality + 1 - toxic as grade")
    got = score(docs, train(docs, ratings.filter("doc_id % 2 = 0"))).join(ratings.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, flawed = [r["kept"] for r in got if r["grade"] == 2], [r["kept"] for r in got if r["grade"] < 2]
    assert np.mean(good) > 0.97
    assert np.mean(flawed) < 0.1
    mean = [np.mean([r["expected_grade"] for r in got if r["grade"] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_ordinal_on_fresh_documents(spark):
    """No setting was chosen on sf0.01, whose documents are others than those of sf0.1."""
    read = lambda sf, name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    ratings = lambda sf: read(sf, "labels").selectExpr("doc_id", "quality + 1 - toxic as grade")
    got = score(read("sf0.01", "documents"), train(read("sf0.1", "documents"), ratings("sf0.1"))).join(ratings("sf0.01"), "doc_id").collect()
    assert np.mean([r["kept"] for r in got if r["grade"] == 2]) > 0.96
    assert np.mean([r["kept"] for r in got if r["grade"] < 2]) < 0.15


def test_ordinal_edges(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert op10_ordinal(spark, sf_dir).count() == n
    docs = spark.createDataFrame([(1, None, 0.1), (1, "a", 0.2), (None, "b " * 300_000 + "c" * 1_000_000, 0.3)], "doc_id bigint, text string, score double")
    kept = score(docs, train(docs, docs.selectExpr("doc_id", "1 as grade")), keep=("score", "text")).collect()
    assert sorted(r["row"]["score"] for r in kept) == [0.1, 0.2, 0.3] and all(isinstance(r["score"], float) for r in kept)
    ratings = spark.createDataFrame([(1, 2), (1, 0), (None, 1), (3, None), (4, 9)], "doc_id bigint, grade int")
    assert score(docs, train(docs, ratings)).count() == 3
    assert score(docs, train(docs, ratings.limit(0))).count() == 3
    assert score(docs.limit(0), train(docs.limit(0), ratings)).count() == 0
