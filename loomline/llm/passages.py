"""Repeated passages, removed by sharded automata.

A window is 20 consecutive words.  Its anchor is the smallest hash of its 6-word
grams, the leftmost of equal ones; neighbouring windows mostly share it, and a run
of windows with the anchor at one place is a segment.  Equal passages are cut into
equal segments but for their ends, so counting segments (by anchor and content)
finds most of what recurs at an eighth of the rows.  Where one anchor stands in
different segments, the windows of these are counted themselves; the documents that
hold any are joined with their lists of such segments.

Counting confirms which segments and windows recur and tells the smallest document
that holds each, its origin.  These passages are read from their origins, dealt
into shards of bounded size, and each shard is compiled to an Aho-Corasick automaton
whose letters are words.  Every document that holds a recurring key streams, whole,
through the shards of that key's origin.  The automata locate all occurrences, word
by word; an occurrence goes if its origin is a smaller document, or the document
itself and it isn't the first there.  Equal hashes of unequal words can't remove
anything.  A shard that many documents need is compiled by several tasks, and each
takes a part of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.texts import P, Sums, Words, binary, distinct, mixed, signed, slices
from loomline.storage import Scratch, bound_batches

#: Words of a window and of an anchor's gram.
WINDOW, GRAM = 20, 6
#: Words of the patterns in one automaton; documents that one task streams through it; words of a segment, about.
SHARD_WORDS, SHARD_DOCS, SEGMENT = 250_000, 4000, 27
#: Rows of one Arrow batch of numbers.
ROWS = 100_000
SPANS = "array<struct<start:int,stop:int>>"


def leftmost_least(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the leftmost smallest of each ``span`` consecutive values, by doubling."""
    place, low, width = np.arange(len(values)), values, 1
    n = len(values) - span + 1
    if n <= 0:
        return place[:0], values[:0]
    while width < span:
        step = min(width, span - width)
        size = len(low) - step
        right = low[step:]
        less = right < low[:size]
        place, low = np.where(less, place[step:], place[:size]), np.where(less, right, low[:size])
        width += step
    return place[:n], low[:n]


class Segments:
    """The segments of all texts of a batch: windows lo..hi (inclusive) with anchor a and content c, in text ``of``."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column)
        self.runs = Sums(words.h)
        at = np.arange(max(0, len(words) - GRAM + 1))
        place, low = leftmost_least(self.runs.of(at, at + GRAM), WINDOW - GRAM + 1)
        first, stop = words.of[:-1], words.of[1:]
        enough = stop - first >= WINDOW
        edges = np.zeros(len(words) + 1, np.int64)
        edges[first[enough]] += 1
        edges[stop[enough] - WINDOW + 1] -= 1
        inside = np.cumsum(edges)[: len(place)] > 0  # windows that lie in one text
        starts, ends = inside.copy(), inside.copy()
        same = inside[1:] & inside[:-1] & (place[1:] == place[:-1])  # a repeated gram starts a segment of its own
        starts[1:] &= ~same
        ends[:-1] &= ~same
        self.lo, self.hi = np.flatnonzero(starts), np.flatnonzero(ends)
        self.a = signed(low[self.lo])
        self.c = signed(self.runs.of(self.lo, self.hi + WINDOW))
        self.of = np.searchsorted(words.of, self.lo, "right") - 1

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, text) of the windows in some of the segments."""
        lo, sizes = self.lo[some], (self.hi - self.lo + 1)[some]
        at = np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
        return at, signed(self.runs.of(at, at + WINDOW)), np.repeat(self.of[some], sizes)


def _tallied(keys: list[np.ndarray], of: np.ndarray, ids: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The distinct rows of each text, the times it holds them and its id; the last of ``keys`` tells rows apart."""
    codes, _, first = distinct(mixed(keys[-1].view(np.uint64) + of.astype(np.uint64) * P))
    times = np.bincount(codes, minlength=len(first))
    for i in range(0, len(first), ROWS):
        part = first[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[part]) for k in keys), pa.array(times[i : i + ROWS].astype(np.int32)), pa.array(ids[of[part]])], [*names, "m", "id"])


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, c, m, id) of every segment."""
    for batch in slices(batches, "text"):
        s = Segments(batch.column("text"))
        yield from _tallied([s.a, s.c], s.of, batch.column("id").to_numpy(), ["a", "c"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, m, id) of the windows in the segments that each text's list names."""
    for batch in slices(batches, "text"):
        s = Segments(batch.column("text"))
        _, h, of = s.windows(_listed(s.c, s.of, batch.column("keys"), np.arange(batch.num_rows)))
        yield from _tallied([h], of, batch.column("id").to_numpy(), ["h"])


def _listed(keys: np.ndarray, of: np.ndarray, lists: pa.ListArray, texts: np.ndarray) -> np.ndarray:
    """Which keys are in the list of their own text; ``texts`` numbers the text of each list."""
    owner = np.repeat(texts, lists.value_lengths().fill_null(0).to_numpy())
    tagged = lambda k, t: mixed(k.view(np.uint64) + t.astype(np.uint64) * P)
    return np.isin(tagged(keys, of), tagged(np.ascontiguousarray(lists.flatten().to_numpy()), owner))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the shards that they stream through, and passages of their origins to theirs.

    One row in is (id, digest, text, shard, parts, keys): with keys an origin's
    patterns go to all parts of the shard, without them the text goes to one part.
    """
    for batch in slices(batches, "text"):
        s = Segments(batch.column("text"))
        raw = binary(batch, "text")
        ids, digests, shards, parts = (batch.column(n).to_numpy() for n in ("id", "digest", "shard", "parts"))
        lists = batch.column("keys")
        asked = ~np.asarray(lists.is_null())
        rows = [(int(shards[i]), int(digests[i] % parts[i]), True, int(ids[i]), int(digests[i]), raw[i]) for i in np.flatnonzero(~asked)]
        if asked.any():
            at, h, of = s.windows(asked[s.of])
            key = np.concatenate([s.c, h])
            lo, size, of = np.concatenate([s.lo, at]), np.concatenate([s.hi - s.lo, np.zeros(len(at), np.int64)]) + WINDOW, np.concatenate([s.of, of])
            found = np.flatnonzero(_listed(key, of, lists, np.arange(batch.num_rows)))
            _, _, first = distinct(mixed(key[found].view(np.uint64) + of[found].astype(np.uint64) * P))
            for k in found[first].tolist():
                i = of[k]
                pattern = s.words.data[s.words.start[lo[k]] : s.words.stop[lo[k] + size[k] - 1]].tobytes()
                rows += [(int(shards[i]), p, False, int(ids[i]), int(digests[i]), pattern) for p in range(int(parts[i]))]
        for i in range(0, len(rows), 2000):
            columns = zip(*rows[i : i + 2000])
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "part", "whole", "id", "digest", "text"])


class Shard:
    """An automaton over words: each word of its patterns is a letter."""

    def __init__(self):
        self.letters: dict[bytes, str] = {}
        self.origins: dict[str, int] = {}
        self.automaton = None

    def add(self, pattern: bytes, origin: int) -> None:
        words = pattern.split()
        for w in words:
            if w not in self.letters:
                k = len(self.letters) + 1
                self.letters[w] = chr(k if k < 0xD800 else k + 0x800)
        spelt = "".join(map(self.letters.__getitem__, words))
        self.origins[spelt] = min(origin, self.origins.get(spelt, origin))

    def occurrences(self, words: list[bytes], doc: int) -> list[tuple[int, int]]:
        """Where in a document's words a passage stands that starts earlier: merged spans."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for spelt, origin in self.origins.items():
                self.automaton.add_word(spelt, (len(spelt), origin))
            self.automaton.make_automaton()
            self.long_enough = re.compile(rf"[^\0]{{{min(map(len, self.origins), default=1)},}}", re.S)
        if not self.origins:
            return []
        get = self.letters.get
        met, found = set(), []
        # between words of no pattern there must be room for one
        for stretch in self.long_enough.finditer("".join([get(w, "\0") for w in words])):
            begin = stretch.start() + 1
            for last, hit in self.automaton.iter(stretch[0]):
                size, origin = hit
                if origin >= doc:
                    if origin > doc or id(hit) not in met:
                        met.add(id(hit))
                        continue
                last += begin
                if found and found[-1][1] >= last - size >= found[-1][0]:
                    found[-1] = found[-1][0], last
                else:
                    found.append((last - size, last))
        return merged(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch put together."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


_KIND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, by document and shard; rows come by shard and part, patterns first."""
    place, shard = None, Shard()
    for batch in batches:
        ids, digests, spans = [], [], []
        columns = (batch.column(n).to_pylist() for n in ("shard", "part", "whole", "id", "digest", "text"))
        for number, part, whole, key, digest, text in zip(*columns):
            if (number, part) != place:
                place, shard = (number, part), Shard()
            if not whole:
                shard.add(text, key)
                continue
            found = shard.occurrences(text.split(), key)
            if found:
                ids.append(key)
                digests.append(digest)
                spans.append([{"start": a, "stop": b} for a, b in found])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(spans, _KIND)], ["id", "digest", "spans"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that stay, joined by one space."""
    for batch in slices(batches, "text"):
        sizes, gone, texts, spans = [], [], [], []
        for raw, found in zip(binary(batch, "text"), batch.column("spans").to_pylist()):
            words = (raw or b"").split()
            sizes.append(len(words))
            own = merged([(s["start"], s["stop"]) for s in found]) if found else []
            for start, stop in reversed(own):
                del words[start:stop]
            gone.append(sizes[-1] - len(words))
            texts.append(b" ".join(words))
            spans.append([{"start": a, "stop": b} for a, b in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, _KIND)],
            ["id", "n_words", "n_removed", "kept_text", "spans"],
        )


def _select(table, keep: bool):
    """Rows whose id may be in the filter, or those whose id is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.ascontiguousarray(batch.column("id").fill_null(0).to_numpy())
            held = bloom.holds(table.value, ids, signed(mixed(ids.view(np.uint64)))) if len(ids) else np.zeros(0, bool)
            yield batch.filter(pa.array((held & ~np.asarray(batch.column("id").is_null())) == keep))

    return run


def _filter(keys: DataFrame, column: str) -> np.ndarray:
    """A filter that ``_select`` reads: blocks by the id itself, bits by its mixed value."""
    n = keys.count()
    blocks = 1
    while blocks < bloom.MOST_BLOCKS and blocks * 256 < n * bloom.BITS:
        blocks *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((blocks, 8), np.uint32)
        for batch in batches:
            keys = np.ascontiguousarray(batch.column(0).to_numpy())
            w = mixed(keys.view(np.uint64))
            at = keys % blocks
            for i in range(8):
                np.bitwise_or.at(table[:, i], at, np.left_shift(np.uint32(1), ((w >> np.uint64(5 * i)) & np.uint64(31)).astype(np.uint32)))
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, i].view(np.int32)) for i in range(8))], ["block", *(f"w{i}" for i in range(8))])

    words = ", ".join(f"w{i} int" for i in range(8))
    rows = keys.select(column).mapInArrow(bits, f"block bigint, {words}").groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    table = np.zeros((blocks, 8), np.uint32)
    for i in range(8):
        table[rows.column("block").to_numpy(), i] = rows.column(f"w{i}").to_numpy().astype(np.int32).view(np.uint32)
    return table


def _sharded(keys: DataFrame) -> DataFrame:
    """``keys(key, first, ...)`` with the shard of each: that of its origin, or of a part of a very long one."""
    total = keys.count()
    shards = max(1, -(-total * SEGMENT // SHARD_WORDS))
    most = max(1, SHARD_WORDS // SEGMENT)
    long = keys.groupBy("first").count().filter(F.col("count") > most).select("first", F.ceil(F.col("count") / most).alias("cuts"))
    cut = F.coalesce(F.pmod("key", F.col("cuts")), F.lit(0))
    return keys.join(long, "first", "left").withColumn("shard", F.pmod(F.xxhash64("first", cut), F.lit(shards))).drop("cuts")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to one row per row: id, n_words, n_removed, kept_text, spans.

    A word goes if it lies in a window whose word sequence also starts earlier: in a
    document of a smaller id, or before it in the same one.  All windows are judged
    on the input.  spans are word ranges, stop exclusive; kept_text joins the words
    that stay by one space.  A null or blank text has no words.  Rows without an id
    neither lose words nor make others lose any; rows that repeat an id with the same
    text count as one document, those that repeat it with another text lose nothing to
    each other.  Whole texts of any length are read; a very long one takes about 25
    bytes of a worker's memory for each of its own.  An empty table gives an empty
    result.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    bound_batches(spark)
    scratch = Scratch(spark)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = every.filter(F.col("id").isNotNull())

    def holding(ids: DataFrame) -> DataFrame:
        # the filter's size is fixed and only saves work: the join that follows is exact whatever it lets through
        return source.mapInArrow(_select(sc.broadcast(_filter(ids, "id")), True), "id bigint, text string")

    segments = scratch.cut(source.mapInArrow(_segment_rows, "a bigint, c bigint, m int, id bigint"), "segments")
    firsts = scratch.cut(segments.groupBy("a", "c").agg(F.min("id").alias("first"), F.sum("m").alias("n")), "firsts")
    mixed_anchors = firsts.groupBy("a").count().filter("count > 1").select("a")
    listed = scratch.cut(segments.join(mixed_anchors, "a", "left_semi").groupBy("id").agg(F.collect_set("c").alias("keys")), "listed")
    windows = scratch.cut(holding(listed).join(listed, "id").mapInArrow(_window_rows, "h bigint, m int, id bigint"), "windows")
    scratch.drop(listed)
    # what recurs, with its origin and shard
    recurring = firsts.filter("n > 1").select(F.col("c").alias("key"), "first", F.lit(True).alias("segment")).unionByName(
        windows.groupBy("h").agg(F.min("id").alias("first"), F.sum("m").alias("n")).filter("n > 1").select(F.col("h").alias("key"), "first", F.lit(False).alias("segment"))
    )
    recurring = scratch.cut(recurring, "recurring")
    keys = scratch.cut(_sharded(recurring), "keys")
    scratch.drop(firsts, recurring)
    later = (F.col("first") < F.col("id")) | (F.col("m") > 1)
    found = segments.withColumnRenamed("c", "key").join(keys.filter("segment"), "key").filter(later).select("id", "shard").unionByName(
        windows.withColumnRenamed("h", "key").join(keys.filter("not segment"), "key").filter(later).select("id", "shard")
    )
    visits = scratch.cut(found.distinct(), "visits")
    scratch.drop(segments, windows)
    parts = visits.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("parts"))
    tasks = visits.withColumn("keys", F.lit(None).cast("array<bigint>")).unionByName(keys.groupBy(F.col("first").alias("id"), "shard").agg(F.collect_set("key").alias("keys")))
    tasks = scratch.cut(tasks.join(parts, "shard"), "tasks")
    texts = holding(tasks.select("id")).withColumn("digest", F.xxhash64("text"))
    dealt = texts.join(tasks, "id").mapInArrow(_dealt, "shard bigint, part int, whole boolean, id bigint, digest bigint, text binary")
    streamed = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "whole").mapInArrow(_located, f"id bigint, digest bigint, spans {SPANS}")
    spans = scratch.cut(streamed.groupBy("id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    schema = f"id bigint, n_words bigint, n_removed bigint, kept_text string, spans {SPANS}"
    changed = sc.broadcast(_filter(spans.select("id"), "id"))
    others = _select(changed, False)
    kept = every.withColumn("spans", F.lit(None).cast(SPANS)).mapInArrow(lambda batches: _kept(others(batches)), schema)
    joined = every.mapInArrow(_select(changed, True), "id bigint, text string").withColumn("digest", F.xxhash64("text")).join(spans, ["id", "digest"], "left")
    return kept.unionByName(joined.select("id", "text", "spans").mapInArrow(_kept, schema))


def kept_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op4_passages(spark, sf_dir: str) -> DataFrame:
    found = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", kept_digest(F.col("kept_text")).alias("kept_sha256"))
