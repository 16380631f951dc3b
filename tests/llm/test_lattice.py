"""The forward recursion against all segmentations; counts against plain Python; held-out likelihood."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomline.llm.lattice import START, Lattice, lattice_scores, op5_lattice, vocabulary_path


@pytest.fixture(scope="module")
def lattice():
    size = Lattice(vocabulary_path()).size
    p = np.random.default_rng(4).random(size)
    logs = np.log(p / p.sum())
    return Lattice(vocabulary_path(), logs), logs


def total(lattice, logs, text, j=0):
    """Sum over all segmentations from j on, one by one."""
    if j == len(text):
        return 1.0
    out = 0.0
    for k in range(j + 1, min(len(text), j + lattice.longest) + 1):
        if text[j:k] in lattice.number:
            out += math.exp(logs[lattice.number[text[j:k]]]) * total(lattice, logs, text, k)
    if j:
        out += math.exp(sum(logs[lattice.byte[b]] for b in text[j].encode())) * total(lattice, logs, text, j + 1)
    return out


def test_marginal(lattice):
    lattice, logs = lattice
    words = ["the", "tokens", "é", "ünïx", "aaaaaaa", "世", "x1#", START, "the", "nation", "inter"]
    got = lattice.words(words)
    for word, found in zip(words, got.tolist()):
        assert found == pytest.approx(math.log(total(lattice, logs, START + word)))
    assert math.isfinite(lattice.words(["a", "long" * 5000])[1])
    assert len(lattice.words([])) == 0


def test_score_is_the_sum_over_segmentations(spark):
    """The score of a whole text against an enumeration, with pieces counted in plain Python."""
    texts = ["the on the", "Inter nation é", "on", "", None, "unmet wörd on"]
    df = spark.createDataFrame([(i, t, i in (2, 5)) for i, t in enumerate(texts)], "doc_id bigint, text string, held boolean")
    model = Lattice(vocabulary_path())
    n, ends = np.full(model.size, 0.05), 0
    for i, t in enumerate(texts):
        if i not in (2, 5):
            ends += 1
            for w in (t or "").lower().split():
                for piece in model.model.encode(w):
                    n[piece] += 1
    whole = n.sum() + ends + 0.05
    logs = np.log(n / whole)
    for r in lattice_scores(df, held=F.col("held")).collect():
        want = math.log((ends + 0.05) / whole) + sum(math.log(total(model, logs, START + w)) for w in (texts[r["doc_id"]] or "").lower().split())
        assert r["score"] == pytest.approx(want / math.log(10))


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts, train = Counter(), 0
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in rows}
    for i, _ in rows:
        if not held[i]:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in op5_lattice(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] < 0


def test_held_out_likelihood(spark):
    """On documents that weren't learnt from.  base_score gives any number of unseen words the same share, and so isn't a distribution."""
    sf = "/root/testdata/sf0.1"
    rows = op5_lattice(spark, sf).filter("held_out").collect()
    own, word, base, n = (sum(r[c] for r in rows) for c in ("score", "word_score", "base_score", "n_tokens"))
    assert own / n > -5.8
    assert word / n > base / n - 0.5


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "a b", 2.0), (None, "c", 3.0), (2, "A  B\x0b\x1c", 4.0), (3, "z" * 50_000 + " " + "b " * 100_000, 5.0)], "doc_id bigint, text string, score double")
    got = lattice_scores(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 1), (1, 3), (2, 4), (3, 100_002)]
    assert all(math.isfinite(r[c]) for r in got for c in ("base_score", "score", "word_score"))
    assert lattice_scores(df.limit(0)).count() == 0
