"""Media columns: bytes as PNG images in a binary column, read back, checked and fingerprinted.

An image is written as grey 8-bit samples, rows of a fixed width, in PNG's chunks: a
header, the zlib stream in parts, an end, each with its checksum.  Of the filters
none, sub and up each row gets that whose residue has the least entropy.

The reader takes any 8-bit PNG that is not interlaced.  It tests the signature, every
chunk's checksum, the header, the stream's own checksum and its length, and undoes
all five filters with numpy: sub and up are running sums; rows of average and Paeth
depend on the pixel to the left, above and above left, and so are undone along
diagonals, all rows at once.  A fault is named in the result and ends no job.

The fingerprint is 64 bits: exact area means on 32 x 32 fields, their cosine
transform's 8 x 8 lowest frequencies in whole numbers, each bit whether a
coefficient is above the median.  Whole numbers make it the same on any machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.texts import binary, carried, handed_on, slices
from loomline.storage import Scratch, bound_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a row, the sample that fills the last row, bytes of a part of the stream.
WIDTH, FILL, PART = 576, 255, 1 << 16
#: Samples of a pixel by colour type: grey, colour, palette, grey with alpha, colour with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
FIELDS, LOW = 32, 8
#: Cosines in units of 2^-14.
_COSINES = np.rint(np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(FIELDS) + 1) / (2 * FIELDS)) * (1 << 14)).astype(np.int64)
_NONE, _SUB, _UP, _AVERAGE, _PAETH = range(5)


class Fault(ValueError):
    """What is wrong with an image."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _entropy(rows: np.ndarray) -> np.ndarray:
    """Of each row's bytes, up to a factor and a term that all rows share."""
    counts = np.bincount((np.arange(len(rows))[:, None] * 256 + rows).ravel(), minlength=256 * len(rows)).reshape(-1, 256)
    return -(counts * np.log2(np.maximum(counts, 1))).sum(1)


def encode(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` as a grey PNG of rows of ``width``; the last row is filled up, and there is always one."""
    height = max(1, -(-len(data) // width))
    rows = np.full(height * width, FILL, np.uint8)
    rows[: len(data)] = np.frombuffer(data, np.uint8)
    rows = rows.reshape(height, width)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    tried = [rows, rows - left, rows - up]
    best = np.argmin([_entropy(t) for t in tried], axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = np.choose(best[:, None], tried)
    stream = zlib.compress(lines.tobytes())
    parts = [_chunk(b"IDAT", stream[i : i + PART]) for i in range(0, len(stream), PART)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk up to the end, their checksums tested."""
    if image[:8] != SIGNATURE:
        raise Fault("signature")
    at = 8
    while at + 12 <= len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        if at + 12 + size > len(image):
            break
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise Fault("checksum")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise Fault("end")


def _diagonals(lines: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of any filters: (rows, pixels, channels), undone along diagonals below the row ``above``."""
    height, width, channels = lines.shape
    out = np.zeros((height + 1, width + 1, channels), np.int16)
    out[0, 1:] = above
    for t in range(height + width - 1):
        r = np.arange(max(0, t - width + 1), min(height, t + 1))
        c = t - r
        a, b, d = out[r + 1, c], out[r, c + 1], out[r, c]
        pa_, pb, pd = np.abs(b - d), np.abs(a - d), np.abs(a + b - 2 * d)
        paeth = np.where((pa_ <= pb) & (pa_ <= pd), a, np.where(pb <= pd, b, d))
        guess = np.choose(kinds[r][:, None], [np.zeros_like(a), a, b, (a + b) >> 1, paeth])
        out[r + 1, c + 1] = (lines[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """(rows, 1 + width * channels) of filter bytes and residues to (rows, width, channels)."""
    kinds, rest = lines[:, 0], lines[:, 1:].reshape(len(lines), -1, channels)
    if kinds.max(initial=0) > _PAETH:
        raise Fault("filter")
    out = np.empty_like(rest)
    ahead = np.where(kinds >= _AVERAGE, _AVERAGE, kinds)
    starts = np.flatnonzero(np.append(True, ahead[1:] != ahead[:-1]))
    above = np.zeros_like(rest[0])
    for start, stop in zip(starts, [*starts[1:], len(kinds)]):
        part = rest[start:stop]
        if ahead[start] == _AVERAGE:
            out[start:stop] = _diagonals(part, kinds[start:stop], above)
        elif ahead[start] == _UP:
            np.add(np.cumsum(part, axis=0, dtype=np.uint8), above, out=out[start:stop])
        elif ahead[start] == _SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[start:stop])
        else:
            out[start:stop] = part
        above = out[stop - 1]
    return out


def decode(image: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Samples (rows, width, channels) and the palette, if there is one; raises Fault."""
    header, palette, stream = None, None, []
    for kind, data in chunks(image):
        if header is None and kind != b"IHDR":
            raise Fault("header")
        if kind == b"IHDR":
            header = data
        elif kind == b"PLTE":
            palette = data
        elif kind == b"IDAT":
            stream.append(data)
    if header is None or len(header) != 13:
        raise Fault("header")
    width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", header)
    if not width or not height or depth != 8 or colour not in CHANNELS or any(rest) or colour == 3 and (not palette or len(palette) % 3):
        raise Fault("header")
    line = 1 + width * CHANNELS[colour]
    try:
        # no more is unpacked than the header promises
        unpacked = (z := zlib.decompressobj()).decompress(b"".join(stream), height * line + 1)
    except zlib.error:
        raise Fault("stream") from None
    if len(unpacked) != height * line or not z.eof:
        raise Fault("stream")
    samples = unfilter(np.frombuffer(unpacked, np.uint8).reshape(height, line), CHANNELS[colour])
    if colour == 3:
        found = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if samples.max() >= len(found):
            raise Fault("palette")
        return samples, found
    return samples, None


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of FIELDS equal stretches along axis 0, in units of 1 / FIELDS of a row."""
    n = len(rows)
    whole = np.zeros((n + 1, *rows.shape[1:]), np.int64)
    np.cumsum(rows, axis=0, out=whole[1:])
    q, part = np.divmod(np.arange(FIELDS + 1) * n, FIELDS)
    edge = np.append(rows, np.zeros_like(rows[:1]), axis=0)[q]
    return np.diff(FIELDS * whole[q] + part[:, None] * edge, axis=0)


def fingerprint(grey: np.ndarray) -> bytes:
    """64 bits of an image (rows, width) of 8-bit grey."""
    area = _sums(_sums(grey.astype(np.int64)).T).T
    mean = area * 256 // grey.size
    low = (_COSINES @ mean @ _COSINES.T).ravel()
    return np.packbits(low > np.sort(low[1:])[len(low[1:]) // 2]).tobytes()


def grey(samples: np.ndarray, palette: np.ndarray | None) -> np.ndarray:
    """Colours weighed as 77, 150 and 29 parts of 256; alpha counts for nothing."""
    pixels = palette[samples[:, :, 0]] if palette is not None else samples
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return ((pixels[:, :, :3].astype(np.int64) @ np.array([77, 150, 29])) >> 8).astype(np.uint8)


def to_media(data: DataFrame, id_col: str = "doc_id", data_col: str = "text", keep: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """``data`` to one row per row: id_col, row, n_bytes, media.

    media is the PNG of the bytes of ``data_col`` (text as UTF-8), n_bytes how many
    they are.  Null and empty are an image of one row of fill.  Very long values are
    one image; repeated rows have equal images; an empty table gives an empty result.
    row is a struct of the columns of ``keep``, if any, so their names can't clash;
    other columns are ignored.
    """
    bound_batches(data.sparkSession)
    out = data.select(*carried(id_col, keep), F.lit(0).cast("long").alias("n_bytes"), F.col(data_col).cast("binary").alias("media"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            values = [v or b"" for v in binary(batch, "media")]
            new = {"n_bytes": pa.array(map(len, values), pa.int64()), "media": pa.array([encode(v, width) for v in values], pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return out.mapInArrow(write, out.schema).select(*handed_on(id_col, keep), "n_bytes", "media")


_FEATURES = {"width": ("int", pa.int32()), "height": ("int", pa.int32()), "samples": ("binary", pa.binary()), "hash": ("binary", pa.binary()), "fault": ("string", pa.string())}


def from_media(images: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``images`` to one row per row: id_col, row, media, width, height, samples, hash, fault.

    samples are the image's bytes in order of rows, hash its fingerprint of 8 bytes.
    fault is null for a sound image; else it is what failed first (signature,
    checksum, end, header, stream, filter, palette; null, for no image), and the others are null.
    An empty table gives an empty result; ties cannot arise.
    """
    bound_batches(images.sparkSession)
    none = [F.lit(None).cast(kind).alias(n) for n, (kind, _) in _FEATURES.items()]
    out = images.select(*carried(id_col, keep), F.col(media_col).cast("binary").alias("media"), *none)

    def one(image: bytes | None) -> tuple:
        if image is None:
            return None, None, None, None, "null"
        try:
            samples, palette = decode(image)
        except Fault as fault:
            return None, None, None, None, str(fault)
        return samples.shape[1], samples.shape[0], samples.tobytes(), fingerprint(grey(samples, palette)), None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            columns = zip(*map(one, binary(batch, "media")))
            new = {n: pa.array(c, kind) for (n, (_, kind)), c in zip(_FEATURES.items(), columns)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return out.mapInArrow(read, out.schema).select(*handed_on(id_col, keep), "media", *_FEATURES)


def op12_png(spark, sf_dir: str) -> DataFrame:
    stored = Scratch(spark).cut(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    found = from_media(stored, keep=("n_bytes",))
    return found.select(
        "doc_id", "row.n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("hash")).alias("feature"),
    )
