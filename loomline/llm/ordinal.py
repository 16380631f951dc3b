"""Quality by ordinal cumulative-link regression.

Ratings are graded 0 < 1 < 2.  One weight vector over hashed text features scores
a document, and ordered thresholds cut the score into grades:

    P(grade >= k) = sigmoid(score - threshold_k),   threshold_1 < threshold_2

so all grades share what makes a text better.  Selection goes by a tail
probability; the expected grade is the sum of all of them.

Features are hashed words, their first letters (what inflected and joined words
share), and the orders of some shares of the text.  Those of fewer than LEAST_SHARE of
the labelled documents get no weight: they can only be learnt by heart.  Thresholds
start from the grades' shares, so weights needn't first explain how common a grade is.

The fit reads at most MOST_LABELS labelled documents, those of the smallest hashed
ids; the scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.texts import binary, carried, handed_on, lists
from loomline.storage import bound_batches

#: Weights, labelled documents that the fit reads at most, weight decay, share of documents that a feature is in at least.
DIMENSIONS, MOST_LABELS, DECAY, LEAST_SHARE = 1 << 18, 6000, 1e-3, 0.006
#: Steps at most, past steps that tell the curvature, and the largest slope at which the fit ends.
STEPS, MEMORY, FLAT = 200, 10, 1e-6
#: Letters of a word that are a feature of their own; the tail probability from which a text is kept.
PREFIXES, LEAST = (4, 6), 0.83
MEMO = 150_000
TRIM = b".,;:!?\"'()[]{}"
MARKS = b"#*$%&|<>"


class Buckets(dict):
    """The weights' numbers for each word: of the lower-cased word, and of the first letters of a longer one without marks."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        low = word.lower()
        letters = low.strip(TRIM + MARKS).decode()
        parts = [low.strip(TRIM), *(b"\x01" + letters[:k].encode() for k in PREFIXES if len(letters) > k)]
        h = self[word] = tuple(xxhash.xxh3_64_intdigest(p) % DIMENSIONS for p in parts)
        return h


def _grade(name: bytes, part: float, whole: float) -> int:
    """A feature for the binary order of a share."""
    level = 9 if part <= 0 or whole <= 0 else min(9, int(-np.log2(min(1.0, part / whole))))
    return xxhash.xxh3_64_intdigest(b"\x00" + name + b"%d" % level) % DIMENSIONS


def features(text: bytes, memo: Buckets) -> np.ndarray:
    """Sorted distinct features: words, and the orders of some shares of the text."""
    words = text.split()
    if len(memo) > MEMO:
        memo.clear()
    n = len(words)
    if not n:
        return np.array([_grade(b"empty", 1, 1)], np.int32)
    kinds = set(words)
    distinct = np.fromiter(chain.from_iterable(map(memo.__getitem__, kinds)), np.int32)
    size = len(text)
    capitals = sum(map(bytes.isupper, words))
    shapes = [
        _grade(b"distinct", len(kinds), n), _grade(b"capitals", capitals, n), _grade(b"marks", size - len(text.translate(None, MARKS)), n),
        _grade(b"bars", text.count(b"|"), n), _grade(b"ends", sum(w[-1] in b".!?" for w in words), n), _grade(b"lines", text.count(b"\n"), n), _grade(b"digits", size - len(text.translate(None, b"0123456789")), size),
    ]
    return np.unique(np.concatenate([distinct, np.array(shapes, np.int32)]))


class _Loss:
    """The penalised likelihood of weights and thresholds, over features numbered without gaps.  It is convex."""

    def __init__(self, of: np.ndarray, index: np.ndarray, width: int, grades: np.ndarray, levels: int):
        self.of, self.index, self.width, self.grades, self.levels = of, index, width, grades, levels
        self.rows = np.arange(len(grades))

    def __call__(self, point: np.ndarray) -> tuple[float, np.ndarray]:
        weights, cuts = point[: self.width], point[self.width :]
        n = len(self.grades)
        if (np.diff(cuts) <= 0).any():
            return np.inf, point
        z = np.bincount(self.of, weights[self.index], n)
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -40, 40)))  # P(grade >= 1), P(grade >= 2), ..
        edge = np.pad(tail, ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0)))
        p = np.maximum(edge[self.rows, self.grades] - edge[self.rows, self.grades + 1], 1e-12)
        slope = np.pad(tail * (1 - tail), ((0, 0), (1, 1)))
        above, below = slope[self.rows, self.grades] / p / n, slope[self.rows, self.grades + 1] / p / n
        of_cuts = np.bincount(self.grades, above, self.levels + 1) - np.bincount(self.grades + 1, below, self.levels + 1)
        of_weights = np.bincount(self.index, (below - above)[self.of], self.width) + DECAY * weights
        return -np.log(p).mean() + DECAY / 2 * (weights @ weights), np.concatenate([of_weights, of_cuts[1 : self.levels]])


def _lowest(loss: _Loss, point: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking, until the slope is flat or no step helps."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = loss(point)
    for _ in range(STEPS):
        if np.abs(slope).max() < FLAT:
            break
        way, shares = slope.copy(), []
        for moved, turned in reversed(past):
            shares.append((moved @ way) / (moved @ turned))
            way -= shares[-1] * turned
        if past:
            moved, turned = past[-1]
            way *= (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(past, reversed(shares)):
            way += (share - (turned @ way) / (moved @ turned)) * moved
        length, fall = 1.0, slope @ way
        while length > 1e-10:
            ahead, there = loss(point - length * way)
            if ahead <= value - 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        moved, turned = -length * way, there - slope
        if moved @ turned > 0:
            past = [*past, (moved, turned)][-MEMORY:]
        point, value, slope = point + moved, ahead, there
    return point


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that minimise the penalised likelihood of ``grades`` from 0 to levels - 1."""
    weights = np.zeros(DIMENSIONS)
    if not len(rows):
        return weights, np.linspace(-1.0, 1.0, levels - 1)
    tails = np.array([((grades >= k).sum() + 0.5) / (len(rows) + 1) for k in range(1, levels)])
    thresholds = np.log((1 - tails) / tails) + 1e-3 * np.arange(levels - 1)
    index = np.concatenate(rows)
    used = np.flatnonzero(np.bincount(index, minlength=DIMENSIONS) >= max(1, LEAST_SHARE * len(rows)))
    number = np.full(DIMENSIONS, -1, np.int32)
    number[used] = np.arange(len(used))
    of, index = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), number[index]
    found = _lowest(_Loss(of[index >= 0], index[index >= 0], len(used), grades, levels), np.concatenate([np.zeros(len(used)), thresholds]))
    weights[used] = found[: len(used)]
    return weights, found[len(used) :]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Buckets()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("at"), lists([features(t or b"", memo) for t in binary(batch, "text")], pa.int32())], ["grade", "at", "features"])


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Fits on the ``ratings(id_col, grade_col)`` of smallest hashed ids, MOST_LABELS at most.

    Ratings without an id, a grade from 0 to levels - 1 or a document are left out.
    """
    bound_batches(docs.sparkSession)
    valid = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter(F.col("id").isNotNull() & F.col("grade").between(0, levels - 1))
    chosen = valid.distinct().orderBy(F.xxhash64("id"), "id", "grade").limit(MOST_LABELS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # an id may name many rows; of those, too, the ones of smallest hashes are taken
    found = texts.select("grade", F.xxhash64("id", "text").alias("at"), "text").mapInArrow(_featured, "grade int, at bigint, features array<int>")
    table = found.orderBy("at", "grade").limit(MOST_LABELS).toArrow()
    rows = [np.asarray(x, np.int32) for x in table.column("features").to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # sums don't depend on the order of tasks
    return fit([rows[i] for i in order], table.column("grade").to_numpy().astype(np.int64)[order], levels)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        memo = Buckets()
        for batch in batches:
            found = [float(weights[features(t or b"", memo)].sum()) for t in binary(batch, "__text")]
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(found, pa.float64())], [*rest, "__z"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: float = LEAST) -> DataFrame:
    """``docs`` to one row per row: id_col, row, score, p_ge_1.., expected_grade, kept.

    row is a struct of the columns of ``keep``, if any, so their names can't clash.
    kept: the probability of the highest grade is ``least`` or more.  A null or blank
    text has one feature of its own, very long ones are read whole.  Repeated rows are scored alike.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    weights, thresholds = model
    source = docs.select(*carried(id_col, keep), F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in source.schema if f.name != "__text"] + [T.StructField("__z", T.DoubleType())])
    scored = source.mapInArrow(_scorer(spark.sparkContext.broadcast(weights)), schema)
    tails: list[Column] = [1 / (1 + F.exp(F.lit(float(t)) - F.col("__z"))) for t in thresholds]
    expected = tails[0]
    for t in tails[1:]:
        expected = expected + t
    return scored.select(
        *handed_on(id_col, keep), F.col("__z").alias("score"),
        *(t.alias(f"p_ge_{i + 1}") for i, t in enumerate(tails)), expected.alias("expected_grade"), (tails[-1] >= least).alias("kept"),
    )


def op10_ordinal(spark, sf_dir: str) -> DataFrame:
    """Grades from ``labels``: a point for quality, a point for not being toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return score(docs, train(docs, ratings))
