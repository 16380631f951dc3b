"""Benchmark decontamination by winnowing.

A window is 10 consecutive words of an item.  Both sides hash their 5-word grams
and keep the smallest hash of each 6 consecutive ones; two texts that share a run
of 5 + 6 - 1 = 10 words keep the same gram of it, so every shared window is met.
Document fingerprints are joined with the benchmark's; at a hit the match is extended
to the windows around it, which are looked up by their own hash and compared word by
word.

An item of fewer than 10 words is one window of its own length m; its fingerprint
is its only m-gram, and documents are searched at every such m.

A benchmark of at most INDEX_BYTES is joined by an index that each task holds, in one
pass over the documents.  A larger one is winnowed in tasks and joined by shuffles:
documents' distinct fingerprints with the benchmark's, then the windows around the hits,
with their words, with the benchmark's windows.  Both give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.texts import WordHashes, binary, carried, gram_hashes, handed_on, signed
from loomline.storage import Scratch, bound_batches

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Benchmark bytes up to which every task holds the index, which takes some 140 times as much.
INDEX_BYTES = 1 << 20

#: 0-9, a-z and every byte of a character beyond ASCII are of words; A-Z are lower-cased.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def winnow(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The smallest of each ``span`` consecutive hashes."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low = grams[:n].copy()
    for i in range(1, span):
        np.minimum(low, grams[i : i + n], out=low)
    return low


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        memo = WordHashes()
        prints, windows = defaultdict(set), defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            m = min(WINDOW, len(words))
            h = memo.of(words)
            grams = gram_hashes(h, GRAM if m == WINDOW else m)
            prints[m].update((winnow(grams) if m == WINDOW else grams).tolist())
            for i, w in enumerate(gram_hashes(h, m).tolist()):
                windows[m][w, tuple(words[i : i + m])].add(item)
        self.by_length = {}
        for m, found in windows.items():
            by_hash = defaultdict(list)
            for (w, words), names in found.items():
                by_hash[w].append((words, tuple(sorted(names))))
            self.by_length[m] = (np.array(sorted(prints[m]), np.uint64), np.array(sorted(by_hash), np.uint64), dict(by_hash))

    def search(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items of these windows."""
        n = len(words)
        names: set[str] = set()
        edges = np.zeros(n + 1, np.int64)
        for m, (prints, keys, windows) in self.by_length.items():
            if n < m:
                continue
            if m == WINDOW:
                low = winnow(gram_hashes(hashes, GRAM))
                at = np.flatnonzero(_among(low, prints))
            else:
                at = np.flatnonzero(_among(gram_hashes(hashes, m), prints))
            if not len(at):
                continue
            whole = gram_hashes(hashes, m)[at]  # position i of low covers exactly the window that starts at i
            hit = _among(whole, keys)
            at, whole = at[hit], whole[hit]
            seen: dict[tuple, bool] = {}
            for s, w in zip(at.tolist(), whole.tolist()):
                own = tuple(words[s : s + m])
                if (w, own) not in seen:
                    seen[w, own] = False
                    for other, found in windows[w]:
                        if own == other:
                            names.update(found)
                            seen[w, own] = True
                if seen[w, own]:
                    edges[s] += 1
                    edges[s + m] -= 1
        return np.cumsum(edges[:-1]) > 0, names


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table; runs of one value are looked up once."""
    if not len(values) or not len(table):
        return np.zeros(len(values), bool)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    some = values[first]
    at = np.searchsorted(table, some)
    at[at == len(table)] = 0
    return np.repeat(table[at] == some, np.diff(np.append(first, len(values))))


def _runs(mask: np.ndarray) -> list[dict]:
    step = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": a, "stop": b} for a, b in zip(step[::2].tolist(), step[1::2].tolist())]


def _windows_of(items: DataFrame) -> DataFrame:
    """``items(item, text)`` to the distinct (m, print, w, words, item) of all their windows; a fingerprint is told by the window that keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), binary(batch, "text")):
                words = words_of(text)
                if not words:
                    continue
                m = min(WINDOW, len(words))
                h = memo.of(words)
                grams = gram_hashes(h, GRAM if m == WINDOW else m)
                prints, whole = winnow(grams) if m == WINDOW else grams, gram_hashes(h, m)
                for i in range(0, len(whole), 10_000):
                    part = range(i, min(i + 10_000, len(whole)))
                    texts = pa.array([b" ".join(words[k : k + m]) for k in part], pa.binary())
                    k = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m] * k, pa.int32()), pa.array(signed(prints[i : i + k])), pa.array(signed(whole[i : i + k])), texts, pa.array([item] * k, pa.string())],
                        ["m", "print", "w", "words", "item"],
                    )

    return items.mapInArrow(run, "m int, print bigint, w bigint, words binary, item string").distinct()


def _prints_of(lengths: list[int]):
    """Distinct (row, m, print) of each text, for windows of these lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), binary(batch, "text")):
                h = memo.of(words_of(text or b""))
                for m in lengths:
                    found = np.unique(winnow(gram_hashes(h, GRAM)) if m == WINDOW else gram_hashes(h, m))
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(np.full(len(found), m, np.int32)), pa.array(signed(found))], ["row", "m", "print"])

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows (row, m, w, words, starts) of each text whose fingerprint is in its list, each distinct window once."""
    memo = WordHashes()
    kinds = [("row", pa.int64()), ("m", pa.int32()), ("w", pa.int64()), ("words", pa.binary()), ("starts", pa.list_(pa.int32()))]
    for batch in batches:
        for row, text, hits in zip(batch.column("row").to_pylist(), binary(batch, "text"), batch.column("hits").to_pylist()):
            words = words_of(text or b"")
            h = memo.of(words)
            found: dict[tuple, list[int]] = defaultdict(list)
            for m in sorted({x["m"] for x in hits}):
                keys = np.sort(np.array([x["print"] for x in hits if x["m"] == m], np.int64).view(np.uint64))
                at = np.flatnonzero(_among(winnow(gram_hashes(h, GRAM)) if m == WINDOW else gram_hashes(h, m), keys))
                for s, w in zip(at.tolist(), signed(gram_hashes(h, m)[at]).tolist()):
                    found[m, w, b" ".join(words[s : s + m])].append(s)
            if found:
                columns = [[row] * len(found), *zip(*found.keys()), list(found.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def _joined(out: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """``out`` with the spans and items of its texts, by shuffles."""
    out = scratch.cut(out.withColumn("__at", F.monotonically_increasing_id()), "texts")
    windows = scratch.cut(_windows_of(items), "windows")
    texts = out.select(F.col("__at").alias("row"), F.col("__text").alias("text"))
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())  # WINDOW at most
    hits = texts.mapInArrow(_prints_of(lengths), "row bigint, m int, print bigint").join(windows.select("m", "print").distinct(), ["m", "print"], "left_semi")
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("m", "print")).alias("hits"))
    around = scratch.cut(texts.join(hits, "row").mapInArrow(_around, "row bigint, m int, w bigint, words binary, starts array<int>"), "around")
    known = windows.select("m", "w", "words").distinct()
    spans = around.join(known, ["m", "w", "words"], "left_semi").select("row", "m", F.explode("starts").alias("start"))
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("stop"))).alias("spans"))
    names = around.select("row", "m", "w", "words").join(windows.select("m", "w", "words", "item").distinct(), ["m", "w", "words"]).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged = [], []
            for text, found in zip(binary(batch, "__text"), batch.column("spans").to_pylist()):
                n = len(words_of(text or b""))
                mask = np.zeros(n, bool)
                for s in found:
                    mask[s["start"] : s["stop"]] = True
                sizes.append(n)
                merged.append(_runs(mask))
            new = {"n_words": pa.array(sizes, pa.int64()), "spans": pa.array(merged, batch.schema.field("spans").type)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    rest = [c for c in out.columns if c not in ("spans", "items", "__at")]
    done = out.drop("spans", "items").join(spans.withColumnRenamed("row", "__at"), "__at", "left").join(names.withColumnRenamed("row", "__at"), "__at", "left")
    done = done.select(*rest, none("spans").alias("spans"), none("items").alias("items"))
    return done.mapInArrow(counted, done.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``docs`` to one row per row: id_col, row, n_words, spans, items.

    row is a struct of the columns of ``keep``, if any, so their names can't clash.
    spans are the word ranges (end exclusive) that lie in occurrences of a window,
    merged; items the ids of the items whose windows occur, sorted as strings.  A
    null text has no words, very long ones are searched whole.  Items without words match nothing; a null item id
    counts as the empty name, and rows that repeat an item id are one item.  An
    empty benchmark hits nothing.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = docs.select(
        *carried(id_col, keep), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), F.col(text_col).alias("__text"),
    )
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= INDEX_BYTES:
        index = Index([(r["item"], r["text"].encode()) for r in items.collect()])
        out = out.mapInArrow(_adder(spark.sparkContext.broadcast(index)), out.schema)
    else:
        out = _joined(out, items, Scratch(spark))
    return out.select(*handed_on(id_col, keep), "n_words", "spans", "items")


def _adder(index) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Index = index.value
        memo = WordHashes()
        for batch in batches:
            sizes, spans, items = [], [], []
            for text in binary(batch, "__text"):
                words = words_of(text or b"")
                mask, names = table.search(words, memo.of(words))
                sizes.append(len(words))
                spans.append(_runs(mask))
                items.append(sorted(names))
            new = {"n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return add


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )
