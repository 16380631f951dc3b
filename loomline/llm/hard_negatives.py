"""Hard negatives by block matrix multiplication in two dimensions.

Scores of anchors against all rows are a matrix product.  Rows and anchors are dealt
into blocks, and their vectors cut into chunks of dimensions, so a tile holds some
rows of one chunk.  A tile of rows meets a tile of anchors of the same chunk and
makes a partial tile of scores; partial tiles of a pair of blocks are shuffled
together and added, as 64-bit integers.  A summed tile is reduced at once: to the
best few positives of each of its anchors, or, in the second product, to the best
few negatives in each window that an anchor's positives open.

Blocks are made inside buckets of labels, as many as the bucket's rows need, so a
label of a third of all rows has more blocks and no larger ones.  Positives share
their anchor's bucket, so the first product takes those pairs of blocks alone; the
second takes all.  No tile grows with the table, and nothing but counts by bucket
and the longest vector's length reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.storage import Scratch, bound_batches

#: Rows and anchors of a block, dimensions of a chunk.
ROWS, ANCHORS, WIDTH = 2048, 128, 32
#: Buckets of labels.
BUCKETS = 16
#: Blocks of rows that meet one copy of a tile of anchors.
SLICE = 16

_TILE = "block int, k int, kind string, cells binary, ids binary, numbers binary, labels binary"
_POSITIVE = "a_number long, anchor_id long, score long, positive_id long, p_number long"
_NEGATIVE = "a_number long, anchor_id long, p_number long, positive_id long, positive_score long, score long, negative_id long, n_number long"


def _long(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _tile(width: int):
    """The rows of one block and chunk as one tile, in the order of their ids; the chunk 0 carries who they are."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        pieces = table.column("piece").combine_chunks()
        sizes = pieces.value_lengths().to_numpy()
        cells = np.zeros((len(sizes), width), np.int64)
        cells[np.arange(width) < sizes[:, None]] = pieces.flatten().to_numpy()
        ids, numbers, labels = (_long(table.column(n)) for n in ("vec_id", "number", "label"))
        order = np.lexsort((numbers, ids))
        low, high = (int(cells.min()), int(cells.max())) if cells.size else (0, 0)
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        first = key[1].as_py() == 0
        who = [(x[order].tobytes() if first else None) for x in (ids, numbers, labels)]
        values = [[key[0].as_py()], [key[1].as_py()], [kind], [cells[order].astype(kind).tobytes()], *([w] for w in who)]
        return pa.table(dict(zip(("block", "k", "kind", "cells", "ids", "numbers", "labels"), values)), schema=_SCHEMA)

    return build


_SCHEMA = pa.schema([("block", pa.int32()), ("k", pa.int32()), ("kind", pa.string()), *((n, pa.binary()) for n in ("cells", "ids", "numbers", "labels"))])


def _tiles(rows: DataFrame, chunks: int, width: int) -> DataFrame:
    """``rows`` (block, vec_id, number, label, cells) as tiles: one for each block and chunk of dimensions."""
    cut = rows.select("block", "vec_id", "number", "label", "cells", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("k"))
    cut = cut.select("block", "k", "vec_id", "number", "label", F.slice("cells", F.col("k") * width + 1, width).alias("piece"))
    return cut.groupBy("block", "k").applyInArrow(_tile(width), _TILE)


def _product(width: int):
    """Each pair of tiles as a partial tile of scores, anchors down, rows across."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("r_block", "a_block", "k", "r_ids", "r_numbers", "r_labels", "a_ids", "a_numbers", "a_labels")
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                a, r = (np.frombuffer(one.column(f"{s}_cells")[0].as_py(), one.column(f"{s}_kind")[0].as_py()).reshape(-1, width) for s in "ar")
                most = width * int(np.abs(a.astype(np.float64)).max(initial=0)) * int(np.abs(r.astype(np.float64)).max(initial=0))
                # products of doubles are exact, and fast, as long as every sum is below 2^53
                kind = np.float64 if most < 1 << 53 else np.int64
                scores = (a.astype(kind) @ r.astype(kind).T).astype("<i8")
                yield pa.RecordBatch.from_arrays([*(one.column(n) for n in names), pa.array([scores.tobytes()], pa.binary())], [*names, "scores"])

    return multiply


_PARTIAL = "r_block int, a_block int, k int, r_ids binary, r_numbers binary, r_labels binary, a_ids binary, a_numbers binary, a_labels binary, scores binary"


def _partials(rows: DataFrame, anchors: DataFrame, met: Column, slices: int, width: int) -> DataFrame:
    """Partial tiles of scores; ``met`` lists the blocks of anchors that a block of rows meets."""
    r = rows.withColumn("a_block", F.explode(met)).withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
    r = r.select("a_block", "slice", "k", *(F.col(c).alias(f"r_{c}") for c in rows.columns if c != "k"))
    a = anchors.select("k", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "k"))
    return r.join(a.hint("merge"), ["slice", "a_block", "k"]).mapInArrow(_product(width), _PARTIAL)


def _dealt(df: DataFrame, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """The block of each row: one of its bucket's, dealt by its number."""
    options = [F.when(F.col("bucket") == b, F.lit(start) + F.pmod(F.xxhash64("number"), F.lit(n))) for b, (start, n) in blocks.items() if n]
    return df.withColumn("block", F.coalesce(*options, F.lit(0)).cast("int"))


def _blocks(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Of each bucket the first block and how many there are."""
    found, start = {}, 0
    for bucket, n in sorted(counts.items()):
        found[bucket] = (start, -(-n // most))
        start += -(-n // most)
    return found


class _Summed:
    """One pair of blocks: the sum of its partial tiles, and who its rows and anchors are."""

    def __init__(self, table: pa.Table):
        head = table.column("k").to_pylist().index(0)
        who = {n: np.frombuffer(table.column(n)[head].as_py(), "<i8") for n in table.column_names if n[:2] in ("r_", "a_") and not n.endswith("block")}
        self.ids, self.numbers, self.labels = (who[f"r_{n}"] for n in ("ids", "numbers", "labels"))
        self.a_ids, self.a_numbers, self.a_labels = (who[f"a_{n}"] for n in ("ids", "numbers", "labels"))
        parts = (np.frombuffer(x.as_py(), "<i8") for x in table.column("scores"))
        self.scores = reduce(np.add, parts).reshape(len(self.a_ids), len(self.ids))


def _out(found: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*found) if found else [[np.empty(0, np.int64)]] * len(schema)
    return pa.table([np.concatenate(list(c)) for c in columns], schema=schema)


def _longs(names: str) -> pa.Schema:
    return pa.schema([(n.split()[0], pa.int64()) for n in names.split(", ")])


def _positives(count: int):
    """The best positives in a summed tile, of each anchor."""
    schema = _longs(_POSITIVE)

    def best(table: pa.Table) -> pa.Table:
        tile, found = _Summed(table), []
        for a, scores in enumerate(tile.scores):
            same = np.flatnonzero((tile.labels == tile.a_labels[a]) & (tile.numbers != tile.a_numbers[a]))
            top = same[np.argsort(-scores[same], kind="stable")[:count]]
            found.append((np.full(len(top), tile.a_numbers[a]), np.full(len(top), tile.a_ids[a]), scores[top], tile.ids[top], tile.numbers[top]))
        return _out(found, schema)

    return best


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), high * score // 100


def _negatives(count: int, low: int, high: int):
    """The best negatives in a summed tile, in the window of each anchor and positive."""
    schema = _longs(_NEGATIVE)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _out([], schema)
        tile, found = _Summed(left), []
        at = {n: i for i, n in enumerate(tile.a_numbers.tolist())}
        numbers, p_numbers, p_ids, p_scores = (right.column(c).to_pylist() for c in ("a_number", "p_number", "positive_id", "score"))
        ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, p_number, p_id, p_score in sorted(zip(numbers, p_numbers, p_ids, p_scores)):
            a = at[number]
            if a not in ordered:
                other = np.flatnonzero(tile.labels != tile.a_labels[a])
                order = other[np.argsort(-tile.scores[a][other], kind="stable")]
                ordered = {a: (order, -tile.scores[a][order])}
            order, falling = ordered[a]
            least, most = _bounds(p_score, low, high)
            start, stop = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            top = order[start : min(stop, start + count)]
            same = (number, int(tile.a_ids[a]), p_number, p_id, p_score)
            found.append((*(np.full(len(top), x, np.int64) for x in same), tile.scores[a][top], tile.ids[top], tile.numbers[top]))
        return _out(found, schema)

    return best


def _first(rows: DataFrame, by: list[str], order: list[Column], count: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= count)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, block: int = ROWS, anchor_block: int = ANCHORS, width: int = WIDTH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is true for the rows that are anchors; ``label``, if given, is the label to
    use.  A component x counts as floor(scale * x), and a score is an inner product of
    64-bit integers.  An anchor's positives are its best other rows of its label; each
    of them has as negatives the best rows of other labels whose score s satisfies
    low * p <= 100 * s <= high * p, p being the positive's score.  Ties go to the
    smaller id.  An anchor without positives, or a positive without negatives, has no rows.

    Rows without an id, a label or a vector, or with a null or non-finite component,
    take no part.  Vectors of different lengths are compared as if the shorter ones
    ended in zeros, and an empty one scores 0.  Components beyond 64 bits are cut to
    them, and sums beyond 64 bits wrap.  Blocks hold about ``block`` rows or ``anchor_block``
    anchors, tiles ``width`` dimensions.  Rows that repeat an id are rows of their own, so
    a repeated anchor repeats its result.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    used = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("cells"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    sound = F.forall("cells", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    used = used.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("cells").isNotNull()).filter(sound)
    whole = F.transform("cells", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = scratch.cut(used.select("vec_id", "label", whole.alias("cells"), "anchor", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("number")), "vectors")

    counted = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("cells")).alias("size")).collect()
    chunks = max([1, *(-(-r["size"] // width) for r in counted)])
    r_blocks = _blocks({r["bucket"]: r["n"] for r in counted}, block)
    a_blocks = _blocks({r["bucket"]: r["anchors"] for r in counted}, anchor_block)
    r_count, a_count = (sum(n for _, n in blocks.values()) for blocks in (r_blocks, a_blocks))
    slices = max(1, r_count // SLICE)

    def span(start: int, n: int) -> Column:
        return F.sequence(F.lit(start), F.lit(start + n - 1)) if n else F.array().cast("array<int>")

    tiles = scratch.cut(_tiles(_dealt(rows, r_blocks), chunks, width), "tiles")
    anchors = scratch.cut(_dealt(rows.filter("anchor"), a_blocks), "anchors")
    of_bucket = F.coalesce(*(F.when(F.col("block").between(start, start + n - 1), span(*a_blocks[b])) for b, (start, n) in r_blocks.items()), span(0, 0))
    keys = ["r_block", "a_block"]
    first = _partials(tiles, _tiles(anchors, chunks, width), of_bucket, slices, width).groupBy(*keys).applyInArrow(_positives(positives), _POSITIVE)
    windows = scratch.cut(_first(first, ["a_number"], [F.desc("score"), F.asc("positive_id"), F.asc("p_number")], positives).drop("rank"), "positives")

    # anchors without positives open no window
    opening = anchors.join(windows.select(F.col("a_number").alias("number")).distinct(), "number", "left_semi")
    second = _partials(tiles, _tiles(opening, chunks, width), span(0, a_count), slices, width)
    opened = windows.join(anchors.select(F.col("number").alias("a_number"), F.col("block").alias("a_block")), "a_number").withColumn("r_block", F.explode(span(0, r_count)))
    found = second.groupBy(*keys).cogroup(opened.groupBy(*keys)).applyInArrow(_negatives(negatives, low, high), _NEGATIVE)
    best = _first(found, ["a_number", "p_number"], [F.desc("score"), F.asc("negative_id"), F.asc("n_number")], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


#: The same by comparing every anchor with every row.
OP11_SQL = """
    with v as (
        select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as cells
        from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), s as (
        select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.cells, r.cells)::bigint as score
        from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
    ), p as (
        select anchor_id, vec_id as positive_id, score as positive_score
        from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
    )
    select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::integer as rank,
           vec_id as negative_id, positive_score, score as negative_score
    from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
    qualify rank <= 10
"""
