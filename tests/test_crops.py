"""Crops equal numpy slices; failed and repeated attempts leave nothing behind."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.sources import crops


def pixels_of(path, channels):
    data = open(path, "rb").read()
    at, found, size = 8, b"", None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n])
        if kind == b"IHDR":
            size = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
        found += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(found), np.uint8).reshape(size[1], -1)[:, 1:].reshape(size[1], size[0], channels)


@pytest.fixture
def made(spark):
    rnd = np.random.default_rng(1)
    pages = {("b", 1): rnd.integers(0, 256, (20, 30, 3), np.uint8), ("b", 2): rnd.integers(0, 256, (9, 7, 1), np.uint8), ("c", 1): rnd.integers(0, 256, (4, 4, 3), np.uint8)}
    images = spark.createDataFrame([(b, p, bytearray(x.tobytes()), x.shape[1], x.shape[2]) for (b, p), x in pages.items()], "book string, page int, pixels binary, width int, channels int")
    rows = [
        ("k1", "b", 1, "b/p1/step_01.png", [2, 3, 5, 6]), ("k2", "b", 1, "b/p1/step_02.png", [-4, -2, 10, 12]), ("k3", "b", 1, "b/p1/step_03.png", [25, 15, 100, 100]), ("k4", "b", 2, "b/p2/step_01.png", [0, 0, 7, 9]),
        ("k5", "b", 2, "", [0, 0, 1, 1]), ("k6", "b", 2, "b/p2/none.png", [50, 50, 5, 5]), ("k7", "x", 9, "x.png", [0, 0, 1, 1]), ("k8", "b", 2, "b/p2/step_01.png", [1, 1, 2, 2]), ("k9", "b", 2, "b/p2/gone.png", [-9, 0, 3, 3]),
    ]
    return pages, images, spark.createDataFrame(rows, "id string, book string, page int, image string, bbox array<int>")


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_crops(made, tmp_path):
    pages, images, frames = made
    for _ in range(2):  # again over what is there
        crops.write_crops(frames, images, str(tmp_path))
        assert files(tmp_path) == ["b/p1/step_01.png", "b/p1/step_02.png", "b/p1/step_03.png", "b/p2/step_01.png"]
    for path, page, (x, y, w, h) in (("b/p1/step_01.png", ("b", 1), (2, 3, 5, 6)), ("b/p1/step_02.png", ("b", 1), (-4, -2, 10, 12)), ("b/p1/step_03.png", ("b", 1), (25, 15, 100, 100)), ("b/p2/step_01.png", ("b", 2), (1, 1, 2, 2))):
        want = pages[page][max(0, y) : y + h, max(0, x) : x + w]
        assert (pixels_of(tmp_path / path, want.shape[2]) == want).all()


def test_a_failing_task(spark, made, tmp_path):
    """A page whose bytes don't fit its width fails the job; nothing is put in place and nothing is left."""
    _, images, frames = made
    bad = images.withColumn("width", F.when(F.col("page") == 2, 8).otherwise(F.col("width"))).repartition(3)
    with pytest.raises(Exception):
        crops.write_crops(frames, bad, str(tmp_path))
    assert files(tmp_path) == []


def test_a_repeated_attempt(tmp_path):
    """Of two attempts of one task only the one that counted is put in place."""
    import pyarrow as pa

    page = np.arange(12, dtype=np.uint8)
    batch = pa.RecordBatch.from_pylist([{"pixels": page.tobytes(), "width": 4, "channels": 1, "crops": [{"path": "a/1.png", "x": 1, "y": 0, "w": 2, "h": 2}]}])
    writer = crops._Writer(str(tmp_path))
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != kept.folder and len(files(tmp_path)) == 2
    writer.commit([kept, None])
    assert files(tmp_path) == ["a/1.png"] and os.listdir(tmp_path) == ["a"]
    assert (pixels_of(tmp_path / "a/1.png", 1)[:, :, 0] == page.reshape(3, 4)[:2, 1:3]).all()
    empty = crops._Writer(str(tmp_path / "none"))
    empty.abort([])
    empty.commit([empty.write(iter([]))])
    assert files(tmp_path / "none") == []
