"""Near-duplicate groups by min-max hashing.

Every document's set of 5-word shingles is hashed once under each of 64
permutations, and both the smallest and the largest value are kept: 128 signature
values for 64 evaluations.  Minima and maxima are banded apart, so the values of
one band come from different permutations and a band of four agrees with
probability J^4 exactly.  32 bands miss a pair at J = 0.75 with probability 5e-6
(and less above); every candidate is confirmed on the full sets.

Equal sets are one node throughout.  In a bucket of nodes that share a band every
member is compared with the bucket's smallest id (a star), and the confirmed
links give first components.  What a star leaves open are pairs of one bucket in
different components.  The members of such buckets are joined by prefixes: with
shingles in order of rarity, two sets at J >= t share one of the first
n - ceil(t n) + 1 of each, whatever the order is, and behind the first shared one
there must be room for the intersection, so nothing is lost; documents that merely
have a common passage differ in all their rare shingles and don't meet.  A bucket of
thousands of near copies costs one comparison for each of them.  Shingles that many
prefixes hold stand at their ends, where there is room for partners of few sizes only:
such postings are joined by shingle and size class, so documents that share nearly
enough, but not enough, don't meet in pairs either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.texts import P, WordHashes, binary, gram_hashes, lists, mixed, rows, signed
from loomline.operators.components import connected_components
from loomline.storage import Scratch, bound_batches

#: Permutations, values of a band, words of a shingle.
PERMUTATIONS, BAND, SHINGLE = 64, 4, 5
#: Counters of the sketch that orders shingles by rarity.
COUNTERS = 1 << 20
#: Prefixes up to which a shingle's postings are joined by the shingle alone; size classes of a doubling.
RARE, CLASSES = 50, 64
#: Ids up to which the side that selects candidate texts is broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000

_random = np.random.default_rng(20240501)
_A = _random.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, PERMUTATIONS, np.uint64)


def shingle_set(text: bytes, memo: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; a shorter text is one shingle, no word none."""
    words = memo.of(text.lower().split())
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(k, len(words))))


def extremes(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum under each permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 512):
        x = shingles[None, i : i + 512] * _A[:, None] + _B[:, None]
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return low, high


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: 16 of minima, then 16 of maxima."""
    if not len(shingles):
        return shingles
    values = np.concatenate(extremes(shingles)).reshape(-1, BAND)
    h = np.arange(1, len(values) + 1, dtype=np.uint64)
    for i in range(BAND):
        h = h * P + values[:, i]
    return mixed(h)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for ids, texts in rows(batches, "id", "text"):
        sizes, digests, keys = [], [], []
        for t in texts:
            s = shingle_set(t, memo)
            sizes.append(len(s))
            digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
            keys.append(signed(band_keys(s)))
        d = np.array(digests, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists(keys, pa.int64())],
            ["id", "n", "d1", "d2", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for ids, texts in rows(batches, "id", "text"):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists([signed(shingle_set(t, memo)) for t in texts], pa.int64())], ["id", "s"])


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold a shingle of each counter."""
    memo, total = WordHashes(), np.zeros(COUNTERS, np.int64)
    for _, texts in rows(batches, "id", "text"):
        for t in texts:
            np.add.at(total, (shingle_set(t, memo) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], ["counter", "n"])


def prefix(shingles: np.ndarray, tallies: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, of which any set that is similar enough shares one."""
    order = np.lexsort((shingles, tallies[(shingles % np.uint64(COUNTERS)).astype(np.int64)]))
    need = -(-len(shingles) * percent // 100)
    return shingles[order[: len(shingles) - need + 1]]


def _prefixes(tallies, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, sizes, tokens = batch.column("id").to_numpy(), [], []
            for t in binary(batch, "text"):
                s = shingle_set(t or b"", memo)
                tokens.append(signed(prefix(s, tallies.value, percent)))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), batch.column("own"), batch.column("apart"), pa.array(sizes, pa.int32()), lists(tokens, pa.int64())], ["id", "own", "apart", "n", "tokens"]
            )

    return run


class _Confirm:
    """Jaccard distances of pairs of ids on their full sets."""

    def __init__(self, source: DataFrame, scratch: Scratch):
        self.source, self.scratch = source, scratch

    def __call__(self, pairs: DataFrame, label: str) -> DataFrame:
        """(a, b) to (a, b, both, either): sizes of intersection and union."""
        wanted = self.scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{label}-ids")
        small = wanted.count() <= BROADCAST_IDS
        texts = self.source.join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
        sets = self.scratch.cut(texts.mapInArrow(_sets, "id bigint, s array<bigint>"), f"{label}-sets")
        left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        both = F.size(F.array_intersect("sa", "sb"))
        out = self.scratch.cut(
            pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
            .select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either")),
            label,
        )
        self.scratch.drop(wanted, sets)
        return out


def _size_class(n: Column) -> Column:
    """Grows with n; exact below CLASSES, about a hundredth wide above."""
    return F.when(n < CLASSES, n).otherwise(CLASSES + F.floor(CLASSES * F.log2(n / CLASSES))).cast("int")


def _meetings(source: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``nodes(id, own, apart)`` in different components that share a prefix shingle; one of them is apart."""
    small = nodes.count() <= BROADCAST_IDS
    texts = scratch.cut(source.join(F.broadcast(nodes) if small else nodes, "id"), "loose-texts")
    tallies = np.zeros(COUNTERS, np.int64)
    counted = texts.select("id", "text").mapInArrow(_tallies, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    tallies[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    tallies = source.sparkSession.sparkContext.broadcast(tallies.astype(np.int32))
    tokens = scratch.cut(texts.mapInArrow(_prefixes(tallies, percent), "id bigint, own bigint, apart boolean, n int, tokens array<bigint>").select("id", "own", "apart", "n", F.posexplode("tokens").alias("at", "token")), "prefixes")
    one = tokens.filter("apart").select("token", F.col("id").alias("x"), F.col("own").alias("ox"), F.col("n").alias("nx"), (F.col("n") - F.col("at")).alias("lx"))
    other = tokens.select("token", F.col("id").alias("y"), F.col("own").alias("oy"), F.col("n").alias("ny"), (F.col("n") - F.col("at")).alias("ly"), F.col("apart").alias("ay"))
    sizes = (F.col("nx") * 100 >= F.col("ny") * percent) & (F.col("ny") * 100 >= F.col("nx") * percent)
    # at a pair's first common shingle, what is left of both sets can still hold the intersection that is needed
    room = F.least("lx", "ly") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    # partners' sizes for which there is room behind a posting
    least, most = F.ceil(F.col("nx") * percent / 100), F.least(F.floor(F.col("lx") * (100 + percent) / percent) - F.col("nx"), F.floor(F.col("nx") * 100 / percent))
    hot = scratch.cut(tokens.groupBy("token").count().filter(F.col("count") > RARE).select("token"), "hot")
    classed = one.join(hot, "token", "left_semi").filter(least <= most).withColumn("class", F.explode(F.sequence(_size_class(least), _size_class(most))))
    often = classed.join(other.join(hot, "token", "left_semi").withColumn("class", _size_class(F.col("ny"))), ["token", "class"]).drop("class")
    rare = one.join(hot, "token", "left_anti").join(other, "token")
    met = rare.unionByName(often).filter((F.col("ox") != F.col("oy")) & sizes & room & (~F.col("ay") | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` to one row per row: id_col, n_shingles, component_id, kept, n_copies.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest id that links reach, and kept holds
    for that id.  n_copies counts the rows whose set equals this row's.

    A null or blank text has no shingles and is its own component.  id_col must be
    an integer that names a document: rows that repeat an id with the same text get
    the same result each (so both are kept), and rows that repeat it with another
    text are compared under that one id.  Very long texts are hashed whole.  A row without an id cannot be named by a
    link: its component is null and it is kept.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = scratch.cut(source.mapInArrow(_sketches, "id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>"), "sketches")
    # equal sets are one node, named by the smallest id
    sets = scratch.cut(
        sketches.filter("id is not null and n > 0").groupBy("d1", "d2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys")),
        "nodes",
    )
    entries = sets.select(F.explode("keys").alias("key"), F.col("node").alias("id"))
    centres = entries.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("top")).filter("top > centre").select("key", "centre")
    members = scratch.cut(entries.join(centres, "key").filter("id <> centre"), "members")
    confirm = _Confirm(source, scratch)
    linked = F.col("both") * 100 >= F.col("either") * percent
    scored = confirm(members.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = scored.filter(linked).select("a", "b")
    found = connected_components(links, scratch)
    # pairs of one bucket that the stars left in different components
    placed = (
        members.join(found, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component")
        .join(found.toDF("centre", "main"), "centre", "left").withColumn("main", F.coalesce("main", "centre"))
        .select("key", "id", "own", "main", (F.col("own") != F.col("main")).alias("apart"))
    )
    placed = scratch.cut(placed, "placed")
    loose = placed.filter("apart").select("key").distinct()
    nodes = scratch.cut(placed.join(loose, "key", "left_semi").groupBy("id", "own").agg(F.max("apart").alias("apart")), "loose")
    if not nodes.isEmpty():
        rest = scratch.cut(_meetings(source, nodes, percent, scratch), "open")
        more = confirm(rest, "rest").filter(linked).select("a", "b")
        found = connected_components(links.union(more), scratch)
    named = sets.join(found.toDF("node", "component"), "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"), "copies")
    out = sketches.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    lone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(lone, F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"), F.when(lone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"),
    )


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
