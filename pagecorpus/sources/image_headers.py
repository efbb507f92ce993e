"""Pixel sizes from the headers of image files, without decoding them.

Only headers are read: fixed places of PNG, GIF, BMP and WebP, the chain of segments of a JPEG
and the first directory of a TIFF, each reached by seeking.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.operators.paging import supported_pages
from pagecorpus.sources.remote import UNREADABLE_FILE, open_stream

# Fixed values of the formats.
PNG, GIF, BMP, JPEG = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a"), b"BM", b"\xff\xd8"
#: JPEG markers that carry a frame's size, and those without a length.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset(range(0xD0, 0xD9)) | {0x01}
#: TIFF tags of width and height, and the sizes of their number types.
TIFF_WIDTH, TIFF_HEIGHT = 256, 257
TIFF_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}

SIZE = "format string, width int, height int"
LARGEST = 2**31 - 1


def _at(stream: BinaryIO, place: int, form: str) -> tuple:
    """The numbers of a struct format at a place of the file."""
    stream.seek(place)
    need = struct.calcsize(form)
    raw = stream.read(need)
    if len(raw) < need:
        raise EOFError
    return struct.unpack(form, raw)


def _jpeg(stream: BinaryIO) -> tuple[int, int]:
    place = 2
    while True:
        mark, kind = _at(stream, place, ">BB")
        if mark != 0xFF:
            raise ValueError("no marker")
        if kind == 0xFF:  # a fill byte
            place += 1
        elif kind in BARE:
            place += 2
        elif kind in FRAMES:
            _, _, height, width = _at(stream, place + 2, ">HBHH")
            return width, height
        elif kind in (0xD9, 0xDA):
            raise ValueError("no frame before the image data")
        else:
            place += 2 + _at(stream, place + 2, ">H")[0]


def _tiff(stream: BinaryIO, order: str) -> tuple[int, int]:
    (version,) = _at(stream, 2, f"{order}H")
    # The large form has offsets and counts of eight bytes.
    if version == 42:
        first, count, entry, value = _at(stream, 4, f"{order}I")[0], "H", "HHI", 8
    elif version == 43:
        first, count, entry, value = _at(stream, 8, f"{order}Q")[0], "Q", "HHQ", 12
    else:
        raise ValueError("no TIFF")
    (n,) = _at(stream, first, order + count)
    start, step = first + struct.calcsize(order + count), 12 if version == 42 else 20
    found: dict[int, int] = {}
    for i in range(n):
        tag, kind, _ = _at(stream, start + i * step, order + entry)
        if tag in (TIFF_WIDTH, TIFF_HEIGHT):
            (found[tag],) = _at(stream, start + i * step + value, order + TIFF_TYPES[kind])
        if len(found) == 2 or tag > TIFF_HEIGHT:  # entries are in order of their tags
            break
    return found[TIFF_WIDTH], found[TIFF_HEIGHT]


def _webp(stream: BinaryIO) -> tuple[int, int]:
    (chunk,) = _at(stream, 12, "4s")
    if chunk == b"VP8X":
        a, b, c, d, e, f = _at(stream, 24, "6B")
        return 1 + a + (b << 8) + (c << 16), 1 + d + (e << 8) + (f << 16)
    if chunk == b"VP8L":
        mark, bits = _at(stream, 20, "<BI")
        if mark == 0x2F:
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if chunk == b"VP8 ":
        code, width, height = _at(stream, 23, "<3sHH")
        if code == b"\x9d\x01\x2a":
            return width & 0x3FFF, height & 0x3FFF
    raise ValueError("no image chunk")


def image_size(stream: BinaryIO) -> tuple[str, int, int] | None:
    """``(format, width, height)`` of an image file, None if it has no size above zero."""
    try:
        stream.seek(0)
        head = stream.read(16)
        if head.startswith(PNG):
            kind, size = "png", _at(stream, 16, ">II")
        elif head.startswith(GIF):
            kind, size = "gif", _at(stream, 6, "<HH")
        elif head.startswith(JPEG):
            kind, size = "jpeg", _jpeg(stream)
        elif head[:2] in (b"II", b"MM"):
            kind, size = "tiff", _tiff(stream, "<" if head[:1] == b"I" else ">")
        elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            kind, size = "webp", _webp(stream)
        elif head.startswith(BMP):
            (header,) = _at(stream, 14, "<I")
            kind, size = "bmp", _at(stream, 18, "<HH" if header == 12 else "<ii")
            size = size[0], abs(size[1])  # a negative height: rows from the top
        else:
            return None
    except (EOFError, ValueError, KeyError, struct.error):
        return None
    return (kind, *size) if all(0 < s <= LARGEST for s in size) else None


def _sized(batches: Iterator[pd.DataFrame], opened) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [opened(source) or (None, None, None) for source in batch.iloc[:, -1]]
        columns = {n: pd.Series([f[i] for f in found], dtype=kind) for i, (n, kind) in enumerate((("format", "object"), ("width", "Int32"), ("height", "Int32")))}
        yield batch.iloc[:, :-1].assign(**{n: c.set_axis(batch.index) for n, c in columns.items()})


def _status() -> Column:
    return F.when(F.col("width").isNull(), schema.INVALID_IMAGE).otherwise(schema.OK)


def sizes_of(images: DataFrame, content: str = "content") -> DataFrame:
    """``images`` without ``content``, with ``format, width, height`` and ``status``.

    What no known header describes, nulls and cut headers have status ``invalid_image``.
    """
    rest = [c for c in images.columns if c not in (content, "format", "width", "height", "status")]
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*rest).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _sized(batches, lambda raw: None if raw is None else image_size(io.BytesIO(raw)))

    made = images.select(*rest, content).mapInPandas(run, f"{form}, {SIZE}" if form else SIZE)
    return made.withColumn("status", _status())


def page_sizes(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, rel_path, format, width, height, status`` of the supported pages below ``root``.

    A task opens each file and reads its header only.
    """
    from pagecorpus.sources.scan import file_manifest

    pages = supported_pages(file_manifest(spark, root, recursive), "rel_path", recursive)

    def opened(path: str) -> tuple[str, int, int] | None:
        try:
            with open_stream(path) as stream:
                return image_size(stream)
        except UNREADABLE_FILE:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _sized(batches, opened)

    rows = pages.select("path", "rel_path", F.col("path").alias("_open"))
    return rows.mapInPandas(run, f"path string, rel_path string, {SIZE}").withColumn("status", _status())
