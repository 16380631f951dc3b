"""Language-model scores by a subword lattice.

A word, with the mark of a word's start before it, is produced by every way of
cutting it into pieces of an existing subword vocabulary; its probability is the
sum over all of them of the product of the pieces' probabilities.  The forward
recursion

    log A(j) = logsumexp over pieces i..j of  log A(i) + log p(piece)

gives this sum in log space in time linear in the word.  No piece reaches across a
word's start, so a document's marginal over all segmentations is the product over
its words and its end, which is one more piece.  Each distinct word is computed
once; words of like lengths go through the recursion together.

The vocabulary's pieces and their order are given.  Where it has no unigram scores
of its own, they are taken from the training documents: the counts of the
vocabulary's segmentation of every training word.  Characters outside the vocabulary
fall back to bytes.

word_score is a second model beside it: a training word as a whole is one more piece
of the lattice, by its count less a discount; the discounts' mass (estimated from the
words met once and twice) is what the segmentations share:

    P(word) = (count - d) / N  +  d V / N * sum over segmentations

Word counts cover all training documents.  Words from a count on that leaves at
most FREQUENT of them go to every task; the others' counts are joined by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.texts import P, Powers, Words, binary, distinct, mixed, slices
from loomline.storage import Scratch, bound_batches

#: Words whose counts and probabilities are broadcast; distinct words that a task holds before it passes counts on.
FREQUENT, HELD = 200_000, 150_000
#: Added to the count of every piece.
PRIOR = 0.05
#: Characters of the words that go through the recursion together, and words that are gathered for it.
BLOCK, GATHERED = 100_000, 20_000
START = "▁"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces of a vocabulary with natural logarithms of their probabilities."""

    def __init__(self, path: str, logs: np.ndarray | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.number, self.byte = {}, [0] * 256
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.number[piece] = i
        self.longest = max(map(len, self.number))
        if logs is None:
            return
        self.byte_log = np.array([float(logs[i]) for i in self.byte])
        pieces = list(self.number)
        codes, lengths = _codes(pieces)
        hashes = _spans(codes, np.zeros(len(pieces), np.int64), lengths)
        order = np.argsort(hashes)
        self.keys, self.logs = hashes[order], np.array([float(logs[self.number[p]]) for p in pieces])[order]
        assert (self.keys[1:] != self.keys[:-1]).all(), "two pieces share a hash"
        # which lengths pieces have at all
        self.lengths = np.unique(lengths)[::-1]

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character's bytes."""
        found, back = np.unique(codes, return_inverse=True)
        logs = [sum(self.byte_log[b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in found.tolist()]
        return np.array(logs)[back].reshape(codes.shape)

    def words(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of the marginal probability of each word over all its segmentations."""
        out = np.empty(len(words))
        order = np.argsort([len(w) for w in words], kind="stable")
        at = 0
        while at < len(order):
            width = len(words[order[at]]) + 1
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * (len(words[order[stop]]) + 1) <= BLOCK and len(words[order[stop]]) <= 1.25 * width + 4:
                stop += 1
            some = order[at:stop]
            out[some] = self._forward([START + words[i] for i in some])
            at = stop
        return out

    def _forward(self, texts: list[str]) -> np.ndarray:
        codes, lengths = _codes(texts)
        k, n = codes.shape
        sums = _sums(codes)
        single = self._bytes(codes)
        down = Powers.of(n + 1)[1]
        a = np.full((k, n + 1), -np.inf)
        a[:, 0] = 0.0
        for j in range(1, n + 1):
            sizes = self.lengths[self.lengths <= j]
            starts = j - sizes
            h = mixed((sums[:, j, None] - sums[:, starts]) * down[starts] + sizes.astype(np.uint64))
            place = np.searchsorted(self.keys, h)
            place[place == len(self.keys)] = 0
            terms = np.where(self.keys[place] == h, self.logs[place] + a[:, starts], -np.inf)
            if j > 1:
                terms = np.concatenate([terms, (a[:, j - 1] + single[:, j - 1])[:, None]], 1)
            top = terms.max(1)
            base = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                a[:, j] = base + np.log(np.exp(terms - base[:, None]).sum(1))
        return a[np.arange(k), lengths]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row for each text, filled up with zeros; lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums by which any stretch of a row is hashed."""
    up = Powers.of(codes.shape[1] + 1)[0][: codes.shape[1]]
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + P) * up, axis=1, out=sums[:, 1:])
    return sums


def _spans(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, row = _sums(codes), np.arange(len(codes))
    return mixed((sums[row, stop] - sums[row, start]) * Powers.of(codes.shape[1] + 1)[1][start] + (stop - start).astype(np.uint64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' counts; the end is the empty word."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for t in binary(batch, "text"):
            counts.update((t or b"").lower().split())
            counts[b""] += 1
            if len(counts) > HELD:
                yield out()
    if counts:
        yield out()


def _segmented(path: str):
    """Counts of pieces in the vocabulary's own segmentation of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        total = np.zeros(lattice.size, np.int64)
        for batch in batches:
            words, times = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            ids = lattice.model.encode(words, num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((y for x in ids for y in x), np.int64, int(sizes.sum()))
            np.add.at(total, flat, np.repeat(times, sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"])

    return run


def _logs(found: pa.Table, size: int, ends: int) -> tuple[np.ndarray, float]:
    """Smoothed log probabilities of pieces, and that of an end."""
    n = np.full(size, PRIOR)
    n[found.column("piece").to_numpy()] += found.column("n").to_numpy()
    total = n.sum() + ends + PRIOR
    return np.log(n / total), math.log((ends + PRIOR) / total)


def _priced(path: str, logs):
    """Each word with the logarithm of its marginal over all segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, logs.value)
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            marginal = lattice.words(table.column("word").to_pylist())
            return pa.RecordBatch.from_arrays([table.column("word"), table.column("c"), pa.array(marginal)], ["word", "c", "p"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= GATHERED:
                yield out()
        if held:
            yield out()

    return run


def _scorer(model):
    """Sums over the frequent words of each text; its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = model.value
        known = dict(zip(words, range(len(words))))
        values = np.concatenate([values, np.zeros((len(values), 1))], 1)  # an unknown word adds nothing here
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), lower=True)
            n = batch.num_rows
            codes, _, first = distinct(w.h)
            met = [w.word(i) for i in first.tolist()]
            at = np.fromiter((known.get(x, -1) for x in met), np.int64, len(met))
            of = w.text_of()
            sums = [np.bincount(of, v[at][codes], n) if len(of) else np.zeros(n) for v in values]
            rare = np.flatnonzero(at[codes] < 0) if len(of) else np.empty(0, np.int64)
            pair, _, once = distinct(of[rare] * np.int64(len(met) + 1) + codes[rare])
            times = np.bincount(pair, minlength=len(once))
            texts = pa.array(met, pa.binary()).cast(pa.string()).take(pa.array(codes[rare[once]]))
            ends = np.searchsorted(of[rare[once]], np.arange(n + 1)).astype(np.int32)
            few = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([texts, pa.array(times.astype(np.int64))], ["word", "n"]))
            sizes = w.counts()
            often = sizes - np.bincount(of[rare], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(sizes + 1), pa.array(often.astype(np.int64)), *map(pa.array, sums), few],
                ["id", "held", "n_tokens", "known", "base", "score", "whole", "rare"],
            )

    return run


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def lattice_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, path: str | None = None) -> DataFrame:
    """``docs`` to one row per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score.

    base_score adds 0.1 to word counts; score is the lattice's marginal over all
    segmentations by the vocabulary; word_score has whole training words as further
    pieces.  All are log10 of the whole text's probability, with A-Z lower-cased and an
    end counted as a token.  Learns from the rows where ``held`` is false (by default
    a tenth is held out by id).  A null or blank text is its end alone.  Very long texts
    are scored whole, as are very long words.  Rows that repeat count each.  An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    path = path or vocabulary_path()
    held = held_out(id_col) if held is None else held
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(True)).alias("held"), F.col(text_col).alias("text"))
    counts = source.filter(~F.col("held")).mapInArrow(_counted, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = scratch.cut(counts, "counts")
    total, kinds_and_end, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    below = total + 0.1 * (kinds_and_end + 1)
    words = counts.filter("word <> ''")
    # the smallest binary order of counts that leaves FREQUENT words at most
    orders = sorted(words.groupBy(F.floor(F.log2("c")).alias("o")).count().collect(), reverse=True)
    least, n = 1 << 62, 0
    for o, k in orders:
        n += k
        if n > FREQUENT:
            break
        least = 1 << o

    pieces = words.mapInArrow(_segmented(path), "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    logs, end = _logs(pieces, Lattice(path).size, ends)
    once, twice, kinds = words.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count("*")).first()
    discount = (once + 0.5) / (once + 2 * twice + 1)
    # without training documents an end is as likely as a word
    share, whole_end = (math.log(discount * kinds / total), math.log(ends / total)) if kinds else (math.log(0.5), math.log(0.5))
    # every training word is computed once; the frequent ones go to every task
    marginals = _priced(path, spark.sparkContext.broadcast(logs))
    priced = scratch.cut(words.mapInArrow(marginals, "word string, c bigint, p double"), "priced")
    often = priced.filter(F.col("c") >= least).select(F.col("word").cast("binary"), "c", "p").toArrow()
    c, p = often.column("c").to_numpy(), often.column("p").to_numpy()
    values = np.array([np.log10((c + 0.1) / below), p, np.log((c - discount) / max(total, 1) + np.exp(share + p))]).reshape(3, -1)
    model = spark.sparkContext.broadcast((often.column("word").to_pylist(), values))
    schema = f"id {source.schema['id'].dataType.simpleString()}, held boolean, n_tokens bigint, known bigint, base double, score double, whole double, rare array<struct<word:string,n:bigint>>"
    scored = scratch.cut(source.mapInArrow(_scorer(model), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    few = priced.filter(F.col("c") < least)
    # only documents that weren't learnt from hold words that training didn't
    new = scored.filter("held").select(F.inline("rare")).select("word").distinct().join(few, "word", "left_anti").withColumn("c", F.lit(0).cast("long"))
    prices = few.unionByName(scratch.cut(new.mapInArrow(marginals, "word string, c bigint, p double"), "new"))
    rare = scored.select("row", F.inline("rare")).join(prices, "word")
    spelt = F.col("p") + F.lit(share)
    whole = F.when(F.col("c") > 0, F.log((F.col("c") - discount) / max(total, 1) + F.exp(spelt))).otherwise(spelt)
    sums = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.col("p")).alias("rest"), F.sum(F.col("n") * whole).alias("whole_rest"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(below))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"),
    )
    known_end, base_end = 1 if ends else 0, math.log10((ends + 0.1) / below)
    both = lambda one, rest: F.col(one) + F.coalesce(rest, F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (both("base", "more") + base_end).alias("base_score"),
        ((both("score", "rest") + end) / math.log(10)).alias("score"), ((both("whole", "whole_rest") + whole_end) / math.log(10)).alias("word_score"),
    )


def op5_lattice(spark, sf_dir: str) -> DataFrame:
    return lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
