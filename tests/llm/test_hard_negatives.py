"""Hard negatives against a comparison of every anchor with every row."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.llm.hard_negatives import mine

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score int"


def brute(rows, anchor, positives=5, negatives=10):
    sound = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, n, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for a in sound:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[3], r[3])), r[0], r[1], r[2]) for r in sound if r[1] != a[1])
        for p in [s for s in scored if s[3] == a[2]][:positives]:
            window = [s for s in scored if s[3] != a[2] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]]
            for rank, s in enumerate(window[:negatives], 1):
                out[(a[0], p[1], rank, s[1], -p[0], -s[0])] += 1
    return out


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = mine(df, F.col("vec_id") % 3 == 0, **sizes)
    return Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some(n, dims, labels):
    # halves and quarters are exact as floats; the sine only spreads them
    return [(i, [round(4 * math.sin(1 + i * 7 + j * j * 3)) / 4 for j in range(dims)], i * i % labels) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "anchor_block": 2, "width": 3}])
def test_against_every_pair(spark, sizes):
    rows = some(60, 8, 4)
    want = brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, rows, **sizes) == want and len(want) > 200


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(20, 5, 2) + [
        (3, None, 1), (6, [1.0, None], 1), (9, [nan, 1.0], 0), (12, [inf, 1.0], 0), (15, [-inf], 1), (18, [1.0], None), (None, [1.0], 1),
        (21, [], 0), (24, [1.0], 1), (27, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (30, [0.5, 0.5], 0), (30, [0.5, 0.5], 0), (33, [0.5, 0.5], 1), (34, [-0.25, 0.25], -3), (36, [0.1], 7),
    ]
    want = brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, rows) == want == mined(spark, rows, block=4, anchor_block=1, width=2)
    assert any(n > 1 for n in want.values())  # a repeated anchor repeats its result
    assert not any(k[0] == 36 for k in want)  # no positive


def test_large_components(spark):
    """Beyond 2^53 products are of whole numbers, not of doubles."""
    rows = [(0, [float(2**20), 1.0], 0), (1, [float(2**21), 3.0], 0), (2, [float(2**20), 5.0], 1), (4, [float(2**20), 4.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0) != Counter()


def test_empty_and_long(spark):
    assert mined(spark, []) == Counter()
    rows = some(12, 3000, 2)
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_a_hot_label_has_more_blocks(spark):
    rows = [(i, [1.0, (i % 5) / 4], 0 if i % 3 else 1 + i % 4) for i in range(90)]
    assert mined(spark, rows, block=8, anchor_block=4, width=1) == brute(rows, lambda i: i % 3 == 0)
