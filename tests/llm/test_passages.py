"""Removed words against all windows of all documents in order."""

import hashlib
import random

from loomline.llm import passages
from loomline.llm.passages import op4_passages, repeated


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in sorted(split, key=lambda x: x[0]):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    out = {}
    for i, w in split:
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone.update(range(s, s + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return result(op4_passages(spark, str(tmp_path)))


def test_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert result(op4_passages(spark, sf_dir)) == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_made_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_WORDS", 60)
    monkeypatch.setattr(passages, "SHARD_DOCS", 3)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " ".join(base[:19]))]
    for i in range(3, 40):
        kind = i % 6
        if kind == 0:  # cuts of the base between other words
            a = r.randrange(80)
            text = [r.choice(vocabulary) for _ in range(r.randrange(15))] + base[a : a + r.randrange(10, 60)] + [r.choice(vocabulary) for _ in range(r.randrange(15))]
        elif kind == 1:
            text = list(base)
            text[r.randrange(120)] = "changed"
        elif kind == 2:
            text = ["same"] * r.randrange(10, 70)
        elif kind == 3:
            text = base[:30] * r.randrange(1, 4)
        elif kind == 4:
            text = [r.choice("ab") for _ in range(200)]
        else:
            text = [r.choice(vocabulary) for _ in range(60)]
        rows.append((i, " ".join(text)))
    r.shuffle(rows)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", 1), (1, text, "b", 1), (None, text, "c", 1), (2, text, None, 1), (2, f"{text} {text}", "", 1)], "doc_id bigint, text string, spans string, keys int")
    got = sorted((r["id"] or 0, r["n_words"], r["n_removed"]) for r in repeated(df).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30), (2, 60, 60)]


def test_very_long_text(spark, tmp_path):
    r = random.Random(5)
    long = " ".join(f"n{r.randrange(10**6)}" for _ in range(300_000))
    part = " ".join(long.split()[200_000:200_050])
    rows = [(1, long), (2, f"a {part} b"), (3, "x" * 3_000_000 + " " + part)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_the_automata_decide(spark, tmp_path, monkeypatch):
    """Without the automata's hits nothing goes, and hits are of words, not of hashes."""
    shard = passages.Shard()
    shard.add(b"a b\n c", 3)
    assert shard.occurrences(b"x a b c a b c".split(), 4) == [(1, 7)]
    assert shard.occurrences(b"x a b c y a b c".split(), 3) == [(5, 8)]
    assert shard.occurrences(b"a b c".split(), 2) == []
    part = " ".join(f"v{i}" for i in range(40))
    rows = [(1, part), (2, part)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[1] for _, r in sorted(result(op4_passages(spark, str(tmp_path))).items())] == [0, 40]
    monkeypatch.setattr(passages, "_located", lambda batches: iter(()))
    assert [r[1] for _, r in sorted(result(op4_passages(spark, str(tmp_path))).items())] == [0, 0]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
