"""Sizes from headers of all page formats."""

import io
import struct

import pytest

from pagecorpus import schema
from pagecorpus.functions import paths
from pagecorpus.sources import image_headers as ih


def tiff(order, width, height, large=False, kind=3):
    o = "<" if order == b"II" else ">"
    form = {3: "H", 4: "I"}[kind]
    entries = [(254, 4, 1, 0), (256, kind, 1, width), (257, kind, 1, height), (258, 3, 1, 8)]
    if large:
        body = order + struct.pack(f"{o}HHHQ", 43, 8, 0, 24) + b"\0" * 8 + struct.pack(f"{o}Q", len(entries))
        for tag, k, n, v in entries:
            body += struct.pack(f"{o}HHQ", tag, k, n) + struct.pack(o + (form if tag in (256, 257) else "I"), v).ljust(8, b"\0")
        return body
    body = order + struct.pack(f"{o}HI", 42, 16) + b"\0" * 8 + struct.pack(f"{o}H", len(entries))
    for tag, k, n, v in entries:
        body += struct.pack(f"{o}HHI", tag, k, n) + struct.pack(o + (form if tag in (256, 257) else "I"), v).ljust(4, b"\0")
    return body


def jpeg(width, height, frame=0xC0, before=b""):
    return b"\xff\xd8" + before + bytes([0xFF, frame]) + struct.pack(">HBHH", 17, 8, height, width) + b"\3" * 10


def webp(chunk):
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


GOOD = {
    "png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1234, 567), 1234, 567),
    "gif": (b"GIF89a" + struct.pack("<HH", 640, 481), 640, 481),
    "old_bmp": (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 70, 80), 70, 80),
    "bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 700, 800), 700, 800),
    "top_bmp": (b"BM" + b"\0" * 12 + struct.pack("<Iii", 124, 700, -800), 700, 800),
    "jpeg": (jpeg(300, 200), 300, 200),
    "progressive": (jpeg(65535, 1, 0xC2, b"\xff\xe0\x00\x04ab" + b"\xff\xff\xff\xe1" + struct.pack(">H", 60_002) + b"x" * 60_000 + b"\xff\x01"), 65535, 1),
    "tiff": (tiff(b"II", 900, 1000), 900, 1000),
    "big_endian": (tiff(b"MM", 900, 100_000, kind=4), 900, 100_000),
    "large_tiff": (tiff(b"MM", 9, 11, large=True), 9, 11),
    "lossy": (webp(b"VP8 " + struct.pack("<I", 10) + b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 500, 400)), 500, 400),
    "lossless": (webp(b"VP8L" + struct.pack("<IBI", 5, 0x2F, 499 | 399 << 14 | 1 << 28)), 500, 400),
    "extended": (webp(b"VP8X" + struct.pack("<I4s", 10, b"\0" * 4) + (70_000 - 1).to_bytes(3, "little") + (3 - 1).to_bytes(3, "little")), 70_000, 3),
}
BAD = {
    "empty": b"",
    "text": b"not an image at all",
    "cut_png": GOOD["png"][0][:20],
    "no_size": b"GIF89a" + struct.pack("<HH", 0, 481),
    "no_frame": b"\xff\xd8\xff\xda\x00\x08",
    "no_marker": b"\xff\xd8ab",
    "cut_jpeg": jpeg(3, 2, before=b"\xff\xe1\xff\xff"),
    "no_tags": b"II" + struct.pack("<HIH", 42, 8, 0),
    "far": b"MM" + struct.pack(">HI", 42, 10**9),
    "type": tiff(b"II", 9, 9).replace(struct.pack("<HHI", 256, 3, 1), struct.pack("<HHI", 256, 2, 1)),
    "chunk": webp(b"ANIM" + b"\0" * 20),
}


@pytest.mark.parametrize("name", GOOD)
def test_sizes(name):
    raw, width, height = GOOD[name]
    assert ih.image_size(io.BytesIO(raw))[1:] == (width, height)
    # Every cut is invalid or has the same size.
    for n in range(min(len(raw), 200)):
        found = ih.image_size(io.BytesIO(raw[:n]))
        assert found is None or found[1:] == (width, height)


@pytest.mark.parametrize("name", BAD)
def test_no_size(name):
    assert ih.image_size(io.BytesIO(BAD[name])) is None


def test_rows_and_files(spark, tmp_path):
    rows = [(n, bytearray(raw)) for n, (raw, _, _) in GOOD.items()] + [(n, bytearray(raw)) for n, raw in BAD.items()] + [("null", None)]
    sized = ih.sizes_of(spark.createDataFrame(rows, "name string, content binary"))
    assert sized.columns == ["name", "format", "width", "height", "status"]
    got = {r.name: (r.width, r.height, r.status) for r in sized.collect()}
    assert got == {n: (w, h, schema.OK) for n, (_, w, h) in GOOD.items()} | {n: (None, None, schema.INVALID_IMAGE) for n in [*BAD, "null"]}
    kinds = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "lossless", "tif": "tiff", "tiff": "big_endian", "bmp": "bmp", "gif": "gif"}
    for ending, name in kinds.items():
        (tmp_path / f"page.{ending}").write_bytes(GOOD[name][0] + b"\0" * 1000)
    (tmp_path / "broken.webp").write_bytes(b"RIFF")
    (tmp_path / "other.txt").write_bytes(GOOD["png"][0])
    found = {r.rel_path: (r.width, r.height, r.status) for r in ih.page_sizes(spark, str(tmp_path)).collect()}
    assert found == {f"page.{e}": (*GOOD[n][1:], schema.OK) for e, n in kinds.items()} | {"broken.webp": (None, None, schema.INVALID_IMAGE)}
