"""Packing into windows by order-preserving dynamic programming.

The token streams of a run of documents, in the table's order, are cut into
windows of at most 4096 tokens.  A window may end after a document (free), after
a sentence (a small penalty for truncating the document) or, where neither is in
reach or the run ends, after any token (a larger penalty).  With S(j) the least
cost of the stream up to cut point j,

    S(j) = penalty(j) + min over cut points i, 0 < j - i <= 4096, of S(i) + 4096 - (j - i)

and as the padding is linear in i, the minimum of S(i) + i over a sliding window
is kept in a monotone queue: every cut point enters and leaves once.  A window
whose length is a power of two is not padded, so those few predecessors are tried
as well.  No row is shuffled; a task packs its own partition in runs of bounded size.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.texts import binary
from loomline.storage import bound_batches

LENGTH, END = 4096, 2
#: Cost in tokens of cutting a document after a sentence, and elsewhere.
SENTENCE, ANYWHERE = 1.0, 24.0
#: Tokens after which a run is packed, at the next end of a document.
RUN = 1 << 20
#: Distinct pieces whose ids a worker remembers; beyond it only those met again since the last time are kept.
MEMO = 400_000
#: End marks that stand after a word.
MARKS = b".,;:!?"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Byte-level letters: a printable byte is its own letter, the others are numbered from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer's words never reach across ASCII white space, so a text's ids are
    those of its space-separated pieces in turn, and each distinct piece is encoded
    once while it is remembered.  A piece of letters with end marks is two of the
    tokenizer's words; its letters go straight to the vocabulary's merges, any other
    piece through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            bare = token.removesuffix("</w>")
            if bare and bare[-1] in ".!?" and not any(c.isalnum() for c in bare):
                self.ends[i] = True

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.encode(piece)
        self[piece] = found
        return found

    def encode(self, piece: bytes) -> bytes:
        bare = piece.rstrip(MARKS)
        if bare.isalpha() and bare.isascii():
            word = bare.lower().decode()
        else:
            word = bare.decode()
            lower = word.lower()
            if not lower.isalpha() or "Σ" in word or not unicodedata.is_normalized("NFC", word) or not unicodedata.is_normalized("NFC", lower):
                return np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            word = lower.encode().decode("latin-1").translate(_LETTERS)
        if len(bare) < len(piece):
            # the letters and the marks are remembered apart
            return self[word.encode("utf-8") if bare.isascii() else bare] + self[piece[len(bare) :]]
        return np.array([t.id for t in self.merges.tokenize(word)], "<u4").tobytes()

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")


#: One for each worker process, for all of its tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_points(sizes: list[int], sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end and their penalties; position 0 first, the end last.

    sizes: tokens of each document; sentences: positions in it after its sentences.
    """
    total = sum(sizes)
    cost = np.full(total + 1, np.inf)
    at = 0
    for size, inner in zip(sizes, sentences):
        cost[at + inner] = SENTENCE
        at += size
        cost[at] = 0.0
    cost[0] = 0.0
    # long stretches without a sentence, and the run's end, may be cut anywhere
    free = np.flatnonzero(np.isfinite(cost))
    for a, b in zip(free[:-1][np.diff(free) > LENGTH // 2], free[1:][np.diff(free) > LENGTH // 2]):
        cost[a + 1 : b] = ANYWHERE
    tail = max(1, total - LENGTH)
    cost[tail:total] = np.minimum(cost[tail:total], ANYWHERE)
    points = np.flatnonzero(np.isfinite(cost))
    return points, cost[points]


def best_cuts(points: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cheapest chain of cut points from the first to the last, both included."""
    at, cost = points.tolist(), penalties.tolist()
    place = {p: k for k, p in enumerate(at)}
    powers = [1 << k for k in range(length.bit_length() - 1)]
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (S(i) + i, i) with rising values
    tail = at[-1] - length
    for k in range(1, len(at)):
        j = at[k]
        while at[queue[0][1]] < j - length:
            queue.popleft()
        value, i = queue[0]
        least = value + length - j
        if j - at[i] == length:
            least = best[i]
        if j >= tail or cost[k] == 0.0:  # windows that need no padding
            for p in powers:
                o = place.get(j - p)
                if o is not None and best[o] < least:
                    least, i = best[o], o
        best[k], back[k] = least + cost[k], i
        value = best[k] + j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, k))
    cuts, k = [at[-1]], len(at) - 1
    while k:
        k = back[k]
        cuts.append(at[k])
    return cuts[::-1]


def pack(sizes: list[int], sentences: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each document its pieces as (start in it, window, offset in the window)."""
    cuts = np.array(best_cuts(*cut_points(sizes, sentences)))
    out, at, w = [], 0, 0
    for size in sizes:
        pieces, start = [], 0
        while start < size:
            while cuts[w + 1] <= at + start:
                w += 1
            pieces.append((start, w, int(at + start - cuts[w])))
            start = int(min(size, cuts[w + 1] - at))
        out.append(pieces)
        at += size
    return out


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


def _packer(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray, np.ndarray]] = []
        tokens = 0
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, tokens
            last, rows = 0, []
            for (key, ids, _), pieces in zip(held, pack([len(h[1]) for h in held], [h[2] for h in held])):
                stops = [p[0] for p in pieces[1:]] + [len(ids)]
                for (start, window, offset), stop in zip(pieces, stops):
                    part = ids[start:stop]
                    rows.append((key, start, stop - start, zlib.crc32(part.tobytes()), len(ids), number + window, offset, part.astype(np.int32) if with_ids else None))
                    last = window
            number += last + 1
            held.clear()
            tokens = 0
            for i in range(0, len(rows), 5000):
                columns = list(zip(*rows[i : i + 5000]))
                types = [kind, *[pa.int64()] * 6, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, text in zip(batch.column("id").to_pylist(), binary(batch, "text")):
                ids = np.append(encode(text or b""), np.array([END], "<u4"))
                ends = encode.ends[np.minimum(ids[:-1], len(encode.ends) - 1)]
                inner = np.flatnonzero(ends[:-1] & ~ends[1:]) + 1 if len(ends) > 1 else np.empty(0, np.int64)
                held.append((key, ids, inner))
                tokens += len(ids)
                if tokens >= RUN:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` to one row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A sequence is the pieces of one sequence_id by offset, 4096 tokens at most;
    pieces keep the order of documents in their partition.  ids is null without
    with_ids.  A null or blank text is its end token alone.  A text of any length
    is cut across sequences.  Repeated rows are packed each.  An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, {SCHEMA}"
    return source.mapInArrow(_packer(path or vocabulary_path(), with_ids), schema).withColumnRenamed("id", id_col)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
