"""Groups against all pairs compared exactly."""

import random
from itertools import combinations

import pandas as pd

from loomline.llm import minhash
from loomline.llm.minhash import near_duplicates, op1_minhash
from loomline.storage import Scratch


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 4 * len(x) >= 3 * len(y) and 4 * len(y) >= 3 * len(x) and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op1_minhash(spark, sf_dir)
    assert result(got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_chain_copies_and_edges(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i * 3] + [f"x{i}_{j}" for j in range(0)] + base[i * 3 :])) for i in range(3)]
    # a chain: each step changes one more word, the ends are too far apart to link
    for step in range(6):
        words = [f"v{i}" for i in range(120)]
        for j in range(step):
            words[10 + 17 * j] = f"new{j}"
        rows.append((10 + step, " ".join(words)))
    rows += [(30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "ONE\ttwo"), (35, "one two three"), (36, "é " * 6), (37, "é " * 9)]
    rows += [(40 + i, " ".join(base)) for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert result(near_duplicates(df)) == brute(rows)


def test_near_the_limit(spark, monkeypatch):
    """Many documents that share a passage and are about as alike as the limit, of many sizes."""
    monkeypatch.setattr(minhash, "RARE", 3)
    r = random.Random(11)
    core = [f"c{i}" for i in range(84)]
    rows = []
    for i in range(160):
        own = [f"o{i}_{j}" for j in range(r.randrange(0, 30))]
        rows.append((i, " ".join([*own[: len(own) // 2], *core[: r.randrange(78, 85)], *own[len(own) // 2 :]])))
    long = [f"l{i}" for i in range(3000)]
    for i in range(20):
        words = list(long)
        for k in range(r.randrange(0, 130)):
            words[r.randrange(3000)] = f"n{i}_{k}"
        rows.append((500 + i, " ".join(words)))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert result(near_duplicates(df)) == brute(rows)


def test_no_pairs_below_the_limit(spark, tmp_path):
    """Documents of one size that share 80 of 96 shingles (J = 0.71) don't meet in pairs."""
    scratch = Scratch(spark)
    n = 300
    rows = [(i, " ".join([f"o{i}_{j}" for j in range(16)] + [f"c{j}" for j in range(84)]), i, True) for i in range(n)]
    source = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "id bigint, text string")
    nodes = spark.createDataFrame([(i, o, a) for i, _, o, a in rows], "id bigint, own bigint, apart boolean")
    met = minhash._meetings(source, nodes, 75, scratch)
    assert met.count() == 0
    plan = met._jdf.queryExecution()
    joined = []
    todo = [plan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
    assert max(joined, default=0) < 60 * n


def test_repeated_null_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, "A B C D E F", None)],
        "doc_id bigint, text string, component_id string",
    ).withColumnRenamed("component_id", "n")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (3, 1, False), (None, None, True)]


def test_very_long_text(spark):
    r = random.Random(6)
    long = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    other = [w if r.random() > 0.02 else f"x{i}" for i, w in enumerate(long)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:120_000])), (4, "z" * 2_000_000)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
