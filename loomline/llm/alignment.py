"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

Both tokenizers' tokens are laid over the same bytes; where a token of each ends, a
group ends, and tokens whose bytes overlap are linked.  Neither tokenizer joins
across a space that follows a visible character (the vocabulary is asked, see
``Pair``), so a text is the sequence of its units, cut there, and each distinct unit
is tokenized and aligned once while it is remembered.

A document's linked pairs with their multiplicities are its postings.  They are
written once, summed to corpus-wide counts of pairs, and shuffled by the side id of
the second tokenizer: a group of the shuffle holds the postings of some side ids,
and beside them all counts of these ids, so an id's highest count is known there.
Spark sorts both streams by group, spilling what doesn't fit.  A group with more
postings than a task should hold is split over salts by document, and its counts,
which the vocabularies bound, are copied to each.  Every group emits what its
postings add to each document; the sums by document are the result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.texts import carried, handed_on, slices
from loomline.storage import Scratch, bound_batches

#: Groups of side ids; postings of a group before it is split; units that a worker remembers, and the longest of them.
GROUPS, POSTINGS, MEMO, REMEMBERED = 256, 1 << 20, 300_000, 200
#: Characters of a text that are aligned at once.
STRETCH = 1 << 19
_CUT = re.compile(r"(?<=\S)(?= )")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


#: Byte-level letters: a printable byte is its own letter, the others are numbered from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class Pair:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(_BYTES[c] for c in token) if all(c in _BYTES for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: No piece holds a space behind another character, so none crosses the start of a unit.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_table, self.b_table = pa.array(self.a_bytes, pa.large_binary()), pa.array(self.b_bytes, pa.large_binary())
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        #: Each id as text with what may follow it: another id of its side, the other side, another group.
        self.written = pa.array([f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"], pa.large_string())

    def units(self, text: str) -> list[str]:
        """A space and the text, cut ahead of each space that follows a visible character."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of each unit by either tokenizer, and whether both spell it byte by byte."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        whole = [u.encode() for u in units]
        if self._spell(whole, a, self.a_table) and self._spell(whole, b, self.b_table):
            return a, b, [True] * len(units)
        sound = [b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y)) for u, x, y in zip(whole, a, b)]
        return a, b, sound

    @staticmethod
    def _spell(whole: list[bytes], ids: list[list[int]], table: pa.Array) -> bool:
        """Whether all units' tokens are their bytes."""
        data, ends = _taken(table, _flat(ids))
        stops = np.append(0, ends)[np.cumsum(_lengths(ids))]
        return bool((stops == np.cumsum(_lengths(whole))).all()) and data == b"".join(whole)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def _lengths(lists: list) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def _taken(table: pa.Array, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the table's values at these places in a row, and where each ends."""
    if not len(at):
        return b"", np.empty(0, np.int64)
    found = table.take(pa.array(at))
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(at) + 1]
    return found.buffers()[2].to_pybytes()[ends[0] : ends[-1]], ends[1:] - ends[0]


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each stretch in turn."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that overlap; both rows of tokens cover the same bytes."""
    first = np.searchsorted(b_end, np.append(0, a_end[:-1]), "right")
    last = np.searchsorted(b_end, a_end, "left")
    counts = last - first + 1
    return np.repeat(np.arange(len(a_end)), counts), _ragged(first, counts)


class Units:
    """What is remembered of each unit: its counts, its groups as text and the codes of its links."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        #: groups as text, each with a semicolon behind it; None where the bytes differ
        self.texts: list[bytes | None] = []
        #: of each unit: tokens of a, of b, groups, links, and where its codes start
        self.counts = np.zeros((1024, 5), np.int64)
        self.codes, self.used = np.empty(1 << 16, np.uint64), 0

    def learn(self, units: list[str]) -> None:
        a, b, sound = self.pair.tokens(units)
        n = len(self.texts)
        while len(self.counts) < n + len(units):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        good = [i for i, s in enumerate(sound) if s]
        self.texts.extend([b"" if s else None for s in sound])
        self.at.update((u, n + i) for i, u in enumerate(units))
        if not good:
            return
        if len(good) < len(units):
            a, b = [a[i] for i in good], [b[i] for i in good]
        flat_a, flat_b, a_count, b_count = _flat(a), _flat(b), _lengths(a), _lengths(b)
        a_end, b_end = _ends(self.pair.a_size[flat_a]), _ends(self.pair.b_size[flat_b])
        link_a, link_b = links(a_end, b_end)
        unit_of = np.repeat(np.arange(len(good)), a_count)
        link_count = np.bincount(unit_of[link_a], minlength=len(good))
        # both rows of ends rise, so a token closes a group if its end is among the other's
        met = np.searchsorted(b_end, a_end)
        closes_a = b_end[met] == a_end
        closes_b = np.zeros(len(b_end), bool)
        closes_b[met[closes_a]] = True
        group_count = np.bincount(unit_of[closes_a], minlength=len(good))
        codes = flat_b[link_b].astype(np.uint64) << np.uint64(32) | flat_a[link_a].astype(np.uint64)
        if self.used + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes[: self.used], np.empty(max(len(self.codes), len(codes)), np.uint64)])
        self.codes[self.used : self.used + len(codes)] = codes
        places = n + np.array(good)
        starts = self.used + np.cumsum(link_count) - link_count
        self.counts[places] = np.stack([a_count, b_count, group_count, link_count, starts], 1)
        self.used += len(codes)
        for place, text in zip(places.tolist(), self._groups(flat_a, closes_a, flat_b, closes_b, group_count)):
            self.texts[place] = text

    def _groups(self, flat_a: np.ndarray, closes_a: np.ndarray, flat_b: np.ndarray, closes_b: np.ndarray, group_count: np.ndarray) -> Iterator[bytes]:
        """Each unit's groups as text: a's ids joined by commas, a bar, b's, a semicolon."""
        a_group, b_group = (np.cumsum(c) - c for c in (closes_a, closes_b))
        # a token stands behind those of earlier groups, of its side, and of the other side's part ahead of it
        a_place = np.arange(len(flat_a)) + np.searchsorted(b_group, a_group, "left")
        b_place = np.arange(len(flat_b)) + np.searchsorted(a_group, b_group, "right")
        written = np.empty(len(flat_a) + len(flat_b), np.int64)
        written[a_place] = flat_a * 3 + closes_a
        written[b_place] = flat_b * 3 + 2 * closes_b
        data, ends = _taken(self.pair.written, written)
        stops = ends[np.sort(b_place[closes_b])[np.cumsum(group_count) - 1]].tolist()
        start = 0
        for stop in stops:
            yield data[start:stop]
            start = stop

    def prepare(self, units: list[str]) -> None:
        """Remembers units ahead of ``places``, all at once."""
        if len(self.texts) > MEMO:
            self.forget()
        new = list(dict.fromkeys(u for u in units if u not in self.at))
        if new:
            self.learn(new)

    def places(self, units: list[str]) -> np.ndarray:
        """Where each unit is remembered."""
        return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def trim(self, units: list[str]) -> None:
        """Forgets long units, which hardly come again."""
        for u in units:
            if len(u) > REMEMBERED:
                self.at.pop(u, None)


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their times."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(times, starts) if len(codes) else times


def aligned(text: str, units: Units, cut: list[str] | None = None) -> tuple[list[int], str, np.ndarray, np.ndarray] | None:
    """(tokens of a, of b, groups, links), digest of the groups, distinct codes and their multiplicities; None without tokens.

    ``cut`` are the text's units if they are prepared already.
    """
    if not text:
        return None
    ready = cut is not None
    cut = cut or units.pair.units(text)
    totals, digest, parts = np.zeros(4, np.int64), hashlib.sha256(), []
    start = 0
    while start < len(cut):
        stop, size = start, 0
        while stop < len(cut) and (ready or size < STRETCH):
            size += len(cut[stop])
            stop = len(cut) if ready else stop + 1
        if not ready:
            units.prepare(cut[start:stop])
        places = units.places(cut[start:stop])
        texts = list(map(units.texts.__getitem__, places.tolist()))
        if not ready:
            units.trim(cut[start:stop])
        if None in texts:
            # the units' bytes differ; those of the whole text decide
            return _unsound(text, units.pair) if len(cut) > 1 else None
        written = b"".join(texts)
        digest.update(written if stop < len(cut) else written[:-1])
        place, times = np.unique(places, return_counts=True)
        counts = units.counts[place]
        totals += (counts[:, :4] * times[:, None]).sum(0)
        parts.append(_summed(units.codes[_ragged(counts[:, 4], counts[:, 3])], np.repeat(times, counts[:, 3])))
        start = stop
    codes, times = parts[0] if len(parts) == 1 else _summed(*map(np.concatenate, zip(*parts)))
    return totals.tolist(), digest.hexdigest(), codes, times


def aligned_all(texts: list[str], units: Units) -> list[tuple | None]:
    """``aligned`` for each text; the new units of all are tokenized together, unless there is more than a stretch of text."""
    if sum(map(len, texts)) > STRETCH:
        return [aligned(t, units) for t in texts]
    cuts = [units.pair.units(t) for t in texts]
    every = list(chain.from_iterable(cuts))
    units.prepare(every)
    found = [aligned(t, units, c) for t, c in zip(texts, cuts)]
    units.trim(every)
    return found


def _unsound(text: str, pair: Pair) -> tuple[list[int], str, np.ndarray, np.ndarray] | None:
    whole = Units(pair)
    whole.learn([" " + text])
    if whole.texts[0] is None:
        return None
    return whole.counts[0, :4].tolist(), hashlib.sha256(whole.texts[0][:-1]).hexdigest(), *_summed(whole.codes[: whole.used], np.ones(whole.used, np.int64))


#: One for each worker process, for all of its tasks.
_OF_WORKER: dict[tuple[str, str], Units] = {}


def _units(paths: tuple[str, str]) -> Units:
    if paths not in _OF_WORKER:
        _OF_WORKER[paths] = Units(Pair(*paths))
    return _OF_WORKER[paths]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligner(paths: tuple[str, str]):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(paths)
        for batch in slices(batches, "__text"):
            found = aligned_all([t or "" for t in batch.column("__text").to_pylist()], units)
            new = {n: pa.array([f[0][i] if f else 0 for f in found], pa.int64()) for i, n in enumerate(_COUNTS)}
            new["groups_sha256"] = pa.array([f[1] if f else "" for f in found])
            new["codes"] = pa.array([f[2].astype("<u8").tobytes() if f else b"" for f in found], pa.binary())
            new["times"] = pa.array([f[3].astype("<u4").tobytes() if f else b"" for f in found], pa.binary())
            new["__text"] = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return align


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    values = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind), np.array([len(v) // size for v in values], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a batch links each pair, and in how many documents."""
    for batch in batches:
        codes, _ = _joined(batch.column("codes"), "<u8")
        times, _ = _joined(batch.column("times"), "<u4")
        pairs, sums = _summed(codes, np.stack([times, np.ones_like(times)], 1).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(32)).astype(np.int64)), pa.array((pairs & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["b", "a", "times", "postings"])


def _group(b: np.ndarray, groups: int) -> np.ndarray:
    return b % groups


def _dealer(groups: int, salts: list[int]):
    """Postings of a batch as one row for each group of side ids and salt."""
    of_group = np.array(salts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = _joined(batch.column("codes"), "<u8")
            times, _ = _joined(batch.column("times"), "<u4")
            number = np.repeat(batch.column("number").to_numpy(), sizes)
            group = _group((codes >> np.uint64(32)).astype(np.int64), groups)
            salt = number % of_group[group]
            order = np.lexsort((codes, salt, group))
            group, salt, number, codes, times = group[order], salt[order], number[order], codes[order], times[order]
            starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (salt[1:] != salt[:-1]))) if len(group) else np.empty(0, np.int64)
            base = int(number.min()) if len(number) else 0
            # the numbers of a batch follow one another
            away = (number - base).astype("<u8" if len(number) and int(number.max()) - base >= 1 << 32 else "<u4")
            stops = [*starts[1:], len(group)]
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(starts, stops)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[starts], pa.int32()), pa.array(salt[starts], pa.int32()), pa.array(np.full(len(starts), base, np.int64)), pa.array([away.dtype.str] * len(starts), pa.string()), cut(away), cut(codes), cut(times)],
                ["part", "salt", "base", "kind", "away", "codes", "times"],
            )

    return deal


_DEALT = "part int, salt int, base long, kind string, away binary, codes binary, times binary"
_ADDED = pa.schema([("number", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _contribute(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """What the postings of some side ids add to each document; ``counts`` has all counts of these ids."""
    if not postings.num_rows:
        return _ADDED.empty_table()
    pairs = counts.column("b").to_numpy().astype(np.uint64) << np.uint64(32) | counts.column("a").to_numpy().astype(np.uint64)
    order = np.argsort(pairs)
    pairs, total = pairs[order], counts.column("times").to_numpy()[order]
    side = pairs >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    highest = np.repeat(np.maximum.reduceat(total, starts), np.diff(np.append(starts, len(pairs))))
    number, best, added = [], [], []
    for base, kind, away, codes, times in zip(*(postings.column(c).to_pylist() for c in ("base", "kind", "away", "codes", "times"))):
        at = np.searchsorted(pairs, np.frombuffer(codes, "<u8"))
        m = np.frombuffer(times, "<u4").astype(np.int64)
        own, inverse = np.unique(np.frombuffer(away, kind), return_inverse=True)
        number.append(base + own.astype(np.int64))
        # sums of whole numbers: bincount's doubles would round large ones
        for out, each in ((best, m * (total[at] == highest[at])), (added, m * total[at])):
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, inverse, each)
            out.append(sums)
    number, best, added = map(np.concatenate, (number, best, added))
    codes, sums = _summed(number.astype(np.uint64), np.stack([best, added], 1))
    return pa.table([codes.astype(np.int64), sums[:, 0], sums[:, 1]], schema=_ADDED)


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), paths: tuple[str, str] | None = None, groups: int = GROUPS, postings: int = POSTINGS
) -> DataFrame:
    """``docs`` to one row per row: id_col, row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    paths name the byte-level tokenizer (a) and the piece model (b).  n_best counts the
    links whose pair is linked as often as any of its side id in all texts; count_sum
    adds the counts of the links' pairs.  Null and empty texts, and those whose tokens
    don't spell a space and the text byte by byte, have no tokens: zeros and no
    digest.  Very long texts are cut at the same places as others.  Rows that repeat
    are counted each; an empty table gives an empty result.  row is a struct of the
    columns of ``keep``, if any, so their names can't clash; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    zero = F.lit(0).cast("long")
    out = docs.select(
        *carried(id_col, keep), F.monotonically_increasing_id().alias("number"), F.col(text_col).alias("__text"), *(zero.alias(n) for n in _COUNTS), F.lit("").alias("groups_sha256"),
        F.lit(b"").alias("codes"), F.lit(b"").alias("times"),
    )
    found = scratch.cut(out.mapInArrow(_aligner(paths or vocabulary_paths()), out.schema).drop("__text"), "aligned")
    linked = found.filter("n_links > 0")
    counted = linked.select("codes", "times").mapInArrow(_counted, "b long, a long, times long, postings long").groupBy("b", "a").agg(F.sum("times").alias("times"), F.sum("postings").alias("postings"))
    counts = scratch.cut(counted.withColumn("part", (F.col("b") % groups).cast("int")), "counts")
    # as many rows as groups
    sizes = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("postings").alias("n")).collect()}
    salts = [max(1, -(-sizes.get(g, 0) // postings)) for g in range(groups)]
    dealt = linked.select("number", "codes", "times").mapInArrow(_dealer(groups, salts), _DEALT)
    each = F.element_at(F.array(*map(F.lit, salts)), F.col("part") + 1)
    copied = counts.select("part", "b", "a", "times", F.explode(F.sequence(F.lit(0), each - 1)).alias("salt"))
    keys = ["part", "salt"]
    added = dealt.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInArrow(_contribute, "number long, n_best long, count_sum long")
    summed = added.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    done = found.drop("codes", "times").join(summed, "number", "left")
    return done.select(*handed_on(id_col, keep), *_COUNTS, *(F.coalesce(c, zero).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
