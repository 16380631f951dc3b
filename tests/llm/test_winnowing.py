"""Every word of every shared window, against a search of all windows."""

import hashlib
import re

from loomline.llm import winnowing
from loomline.llm.winnowing import Index, decontaminate, op8_winnowing
from loomline.llm.texts import WordHashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (own := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[own]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in op8_winnowing(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


ITEMS = [(1, "A b-c, D e f g h i j k l m"), (2, "one two three"), (2, "one two four"), (3, None), (4, ""), (5, "x " * 30), (10, "a b c d e f g h i j"), (None, "zz yy"), (7, "été à l'heure")]
DOCS = [
    (1, "z a b c d e f g h i j k"), (2, "one two"), (3, "zero ONE, two-three one two four"), (4, None), (5, "x " * 12 + "y " + "x " * 9), (6, "été à l heure"), (7, ""), (8, "b c d e f g h i j k l m"),
    (9, "zz yy zz"), (9, "zz yy zz"), (None, "one two three"), (11, "ÉTÉ à l heure"),
]


def check(spark, docs, items):
    d = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id bigint, text string, items string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = []
    for r in decontaminate(d, b).collect():
        hit = sum(s["stop"] - s["start"] for s in r["spans"])
        got.append((r["doc_id"], r["n_words"], hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), hit > 0))
    want = brute(docs, [("" if i is None else i, t) for i, t in items])
    assert sorted(got, key=str) == want


def test_short_null_and_repeated(spark):
    check(spark, DOCS, ITEMS)


def test_larger_benchmark(spark, sf_dir, monkeypatch):
    """Joined by shuffles, the rows are the same."""
    want = sorted(map(str, op8_winnowing(spark, sf_dir).collect()))
    monkeypatch.setattr(winnowing, "INDEX_BYTES", 0)
    check(spark, DOCS, ITEMS)
    check(spark, [], ITEMS)
    assert sorted(map(str, op8_winnowing(spark, sf_dir).collect())) == want


def test_very_long_text(spark):
    long = [f"v{i % 9973}" for i in range(400_000)]
    check(spark, [(1, " ".join(long)), (2, "y" * 2_000_000)], [(1, " ".join(long[300_000:300_014])), (2, "yy")])


def test_empty_tables(spark):
    check(spark, [], ITEMS)
    check(spark, DOCS, [])


def test_guarantee():
    """Any run of ten item words is found, wherever it stands."""
    item = [b"w%d" % i for i in range(40)]
    index, memo = Index([("i", b" ".join(item))]), WordHashes()
    for start in range(31):
        doc = [b"p%d" % i for i in range(7)] + item[start : start + 10] + [b"q%d" % i for i in range(9)]
        mask, names = index.search(doc, memo.of(doc))
        assert names == {"i"} and mask.tolist() == [False] * 7 + [True] * 10 + [False] * 9
