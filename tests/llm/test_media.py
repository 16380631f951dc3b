"""Images against a plain reader and writer, and features against digests of the payload."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from loomline.llm import media
from loomline.llm.media import Fault, decode, encode, fingerprint, from_media, op12_png, to_media


def payload(text):
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % 576 or (0 if data else 576))


def test_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_png(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = payload(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((docs[r["doc_id"]] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        image = encode(p)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), fingerprint(np.frombuffer(p, np.uint8).reshape(-1, 576)).hex())
    assert len({r["feature"] for r in rows}) > len(rows) // 2


def plain_filter(rows, kinds, bpp):
    """The format's filters, byte by byte."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds):
        line = bytearray([kind])
        for i, x in enumerate(row):
            a, b, c = row[i - bpp] if i >= bpp else 0, above[i], above[i - bpp] if i >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes(line)
        above = row
    return out


def image(width, height, colour, lines, palette=b"", part=50):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    stream = zlib.compress(lines)
    parts = b"".join(chunk(b"IDAT", stream[i : i + part]) for i in range(0, len(stream), part))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"tEXt", b"a\0b") + parts + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,bpp", [(0, 1), (2, 3), (4, 2), (6, 4), (3, 1)])
def test_all_filters(colour, bpp):
    rnd = random.Random(colour)
    for height, width in ((1, 1), (7, 5), (13, 40), (30, 2)):
        rows = [bytes(rnd.choice((0, 1, 200, rnd.randrange(256))) for _ in range(width * bpp)) for _ in range(height)]
        kinds = [rnd.randrange(5) for _ in rows]
        palette = bytes(range(256)) * 3 if colour == 3 else b""
        samples, found = decode(image(width, height, colour, plain_filter(rows, kinds, bpp), palette))
        assert samples.tobytes() == b"".join(rows) and (found is not None) == (colour == 3)


def test_faults():
    good = encode(b"hello world" * 300)
    assert decode(good)[0].tobytes().startswith(b"hello world")
    assert any(good.count(k) for k in (b"IDAT",))
    flipped = bytearray(good)
    flipped[60] ^= 1
    lines = plain_filter([b"abc", b"def"], [0, 0], 1)
    cases = {
        "signature": [b"", b"GIF89a", good[1:]], "checksum": [bytes(flipped)], "end": [good[:-12], good[:40], media.SIGNATURE],
        "stream": [image(3, 3, 0, lines), image(3, 1, 0, lines), image(2**31 - 1, 2**31 - 1, 0, lines)], "filter": [image(3, 2, 0, b"\x05abc\0def")],
        "header": [image(0, 2, 0, lines), image(3, 2, 3, lines), image(3, 2, 5, lines), media.SIGNATURE + media._chunk(b"IEND", b"")], "palette": [image(3, 2, 3, lines, b"\0" * 30)],
    }
    for name, images in cases.items():
        for one in images:
            with pytest.raises(Fault, match=name):
                decode(one)


def test_every_cut_and_flip_is_told():
    good = encode(b"\x00\x01" * 400)
    for i in range(len(good)):
        for bad in (good[:i], good[:i] + bytes([good[i] ^ 16]) + good[i + 1 :]):
            with pytest.raises(Fault):
                decode(bad)


def test_fingerprint():
    """Against sums and cosines of fractions of pixels, where no coefficient is near the median; small changes leave it near."""
    rnd = np.random.default_rng(3)
    for height, width in ((1, 576), (5, 7), (100, 33), (64, 64)):
        grey = np.cumsum(rnd.integers(0, 9, (height, width)), axis=1).astype(np.uint8)
        fine = np.repeat(np.repeat(grey, 32, 0), 32, 1).reshape(32, height, 32, width).mean((1, 3))
        cos = np.array([[math.cos(math.pi * u * (2 * x + 1) / 64) for x in range(32)] for u in range(8)])
        low = (cos @ fine @ cos.T).ravel()
        median = np.sort(low[1:])[31]
        sure = np.abs(low - median) > 3
        got = np.unpackbits(np.frombuffer(fingerprint(grey), np.uint8)).astype(bool)
        assert (got == (low > median))[sure].all() and (height == 1 or sure.sum() > 20)
        noisy = np.clip(grey.astype(int) + rnd.integers(-1, 2, grey.shape), 0, 255).astype(np.uint8)
        assert (np.unpackbits(np.frombuffer(fingerprint(noisy), np.uint8)).astype(bool) == got).sum() >= 48


def test_edges(spark):
    long = "päper " * 400_000
    rows = [(1, None), (2, ""), (None, "x"), (4, "x"), (4, "x"), (5, "a" * 576), (6, long), (7, "\0￿𝕏")]
    df = spark.createDataFrame([(a, b, "k", 0) for a, b in rows], "doc_id bigint, text string, media string, n_bytes int")
    stored = to_media(df, keep=("doc_id", "media"))
    assert stored.columns == ["doc_id", "row", "n_bytes", "media"]
    back = from_media(stored, keep=("n_bytes",)).collect()
    assert sorted((str(r["doc_id"]), bytes(r["samples"])) for r in back) == sorted((str(a), payload(b)) for a, b in rows)
    assert all(r["fault"] is None and r["width"] == 576 and r["width"] * r["height"] == len(r["samples"]) for r in back)
    none = from_media(spark.createDataFrame([(1, None), (2, b"no")], "doc_id int, media binary")).collect()
    assert [r["fault"] for r in sorted(none)] == ["null", "signature"] and all(r["hash"] is None for r in none)
    assert from_media(to_media(df.limit(0))).count() == 0
