"""Words, shingles and hashes of whole texts, for Arrow batches.

ASCII white space is what ``bytes.split`` cuts at: exactly 0x20 and 0x09-0x0D.
``bytes.lower`` changes A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

P = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Words whose hashes a worker remembers.
MEMO = 150_000


class WordHashes(dict):
    """Remembers the 64-bit hash of each word it has met; when full, only of those met since it was last full."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        h = self.older.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_OF_WORKER = WordHashes()


def hashes_of_worker() -> WordHashes:
    """One for each worker process, for all of its tasks."""
    return _OF_WORKER


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * P + words[i : i + n]
    return mixed(h)


def carried(key: str, keep: tuple[str, ...]) -> list[Column]:
    """The id as ``__id`` and the kept columns in one struct ``__row``: no name of theirs can clash with a result's."""
    return [F.col(key).alias("__id"), *([F.struct(*dict.fromkeys(keep)).alias("__row")] if keep else [])]


def handed_on(key: str, keep: tuple[str, ...]) -> list[Column]:
    """What ``carried`` took along: the id under its name, the kept columns in ``row``."""
    return [F.col("__id").alias(key), *([F.col("__row").alias("row")] if keep else [])]


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's UTF-8 values."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def rows(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts of each batch; a null text is empty."""
    for batch in batches:
        yield batch.column(key).to_pylist(), [t or b"" for t in binary(batch, text)]


#: White space, and A-Z to a-z, by byte.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: A random odd number for each byte; bytes that are hashed at once.
_BYTE = np.random.default_rng(20240502).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_CHUNK = 1 << 18


class Powers:
    """Powers of an odd number and of its inverse, as far as they have been asked for."""

    inverse = np.uint64(pow(int(P), -1, 2**64))
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", P), ("down", cls.inverse)):
                table = np.full(max(n, 2 * len(cls.up)), base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table, dtype=np.uint64))
        return cls.up, cls.down


class Sums:
    """Hashes of runs of values, from running sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.of(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


class Words:
    """All words of a column of whole texts, found and hashed together.

    data: the texts' bytes; start, stop: the words' bytes in them; h: a hash of each
    word, the same in every batch; of: the number of the first word of each text,
    with the number of all words behind.  A null text has no words.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        whole = column.cast(pa.large_binary())
        if whole.null_count:
            whole = whole.fill_null(b"")
        ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
        raw = whole.buffers()[2] if len(whole) else None
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
        self.data = data = _LOWER[data] if lower else data
        ends = ends - ends[0]
        ink = ~_BLANK[data]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        edge = ends[:-1][ends[:-1] < len(data)]
        first[edge] = ink[edge]
        edge = ends[1:][ends[1:] > 0] - 1
        last[edge] = ink[edge]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, ends)
        self.h = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(self.h):
            begin = self.start[k]
            j = max(k + 1, int(np.searchsorted(self.stop, begin + _CHUNK, "right")))
            part = Sums(_BYTE[data[begin : self.stop[j - 1]]])
            self.h[k:j] = part.of(self.start[k:j] - begin, self.stop[k:j] - begin)
            k = j

    def __len__(self) -> int:
        return len(self.h)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.of)

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], name: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of at most ``size`` bytes of text, or one longer text each: a bound on the memory of a part."""
    for batch in batches:
        column = batch.column(name).cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each hash among the distinct ones, the distinct ones, where each of them is first), in order of appearance."""
    found = pa.array(h).dictionary_encode()
    codes, values = found.indices.to_numpy(), found.dictionary.to_numpy()
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, values, first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list for each array."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
