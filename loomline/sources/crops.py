"""Crops of page images as PNG files, by a data source that commits as a whole.

Tasks crop bytes in Arrow batches and write to a folder of their own attempt.  When
all are done the driver puts the files of the attempts that counted in place, each by
a rename; a failed or repeated attempt leaves nothing but staged files, which the end
of the job removes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_CROPS = "array<struct<path:string,x:int,y:int,w:int,h:int>>"
#: PNG's colour types by samples of a pixel.
_COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def png(pixels: np.ndarray) -> bytes:
    """(rows, width, channels) of 8-bit samples as an image without filters."""
    height, width, channels = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, _COLOUR[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def crop(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of a page that a box covers; boxes may reach over its edges."""
    return pixels[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]


def crops_of(frames: DataFrame, images: DataFrame) -> DataFrame:
    """images(book, page, pixels, width, channels) with the crops of frames(book, page, image, bbox): one row a page, so its pixels go once.

    Of frames of one path the last by id stays; frames without a path are passed over.
    """
    named = frames.filter("image is not null and image <> ''").groupBy("book", "page", "image").agg(F.max_by("bbox", "id").alias("b"))
    one = F.struct(F.col("image").alias("path"), *(F.get("b", i).cast("int").alias(c) for i, c in enumerate("xywh")))
    each = named.groupBy("book", "page").agg(F.array_sort(F.collect_list(one)).cast(_CROPS).alias("crops"))
    return images.join(each, ["book", "page"]).select("pixels", F.col("width").cast("int").alias("width"), F.col("channels").cast("int").alias("channels"), "crops")


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote: where it staged, and the paths."""

    folder: str
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._fs()
        folder, paths = f"{root}/_staged/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(folder)
        for batch in iterator:
            for pixels, width, channels, crops in zip(*(batch.column(c).to_pylist() for c in ("pixels", "width", "channels", "crops"))):
                page = np.frombuffer(pixels or b"", np.uint8).reshape(-1, width, channels)
                for c in crops or []:
                    part = crop(page, c["x"], c["y"], c["w"], c["h"])
                    if not part.size:
                        continue
                    with store.open_output_stream(f"{folder}/{len(paths)}.png") as out:
                        out.write(png(part))
                    paths.append(c["path"])
        return Written(folder, paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._fs()
        made = set()
        for m in filter(None, messages):
            for i, path in enumerate(m.paths):
                parent = f"{root}/{path}".rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent)
                    made.add(parent)
                store.move(f"{m.folder}/{i}.png", f"{root}/{path}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._fs())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        staged = f"{root}/_staged/{self.job}"
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)
        if not store.get_file_info(fs.FileSelector(f"{root}/_staged", allow_not_found=True)) and store.get_file_info(f"{root}/_staged").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staged")


class PageCrops(DataSource):
    """``df.write.format("page_crops").mode("append").option("path", folder)`` of ``crops_of``'s rows; the folder may be of any store pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "page_crops"

    def schema(self) -> str:
        return f"pixels binary, width int, channels int, crops {_CROPS}"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("page_crops appends; equal paths are replaced")
        return _Writer(self.options["path"])


def write_crops(frames: DataFrame, images: DataFrame, folder: str) -> None:
    """Each frame's crop at its image path below ``folder``."""
    spark = frames.sparkSession
    spark.dataSource.register(PageCrops)
    crops_of(frames, images).write.format("page_crops").mode("append").option("path", folder).save()
