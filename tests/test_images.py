import struct
import zlib

import pytest

from adatlas.functions.images import size_of
from adatlas.sources import tables as S


def png(w, h, tail=True):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 50)) + (chunk(b"IEND", b"") if tail else b"")


def jpeg(w, h, *segments):
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", n + 2) + b"\0" * n for n in segments) + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0\xff\xd9"


@pytest.mark.parametrize("content, size", [
    (png(900, 7), (900, 7)), (png(900, 7, False), None), (png(900, 7).replace(b"IHDR\0\0", b"IHDR\1\0"), None), (jpeg(640, 480), (640, 480)), (jpeg(640, 480, 10, 300), (640, 480)), (jpeg(0, 480), None),
    (b"GIF89a" + struct.pack("<HH", 3, 1000) + b"\0\0\0;", (3, 1000)), (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), (5, 6)), (b"", None), (b"\xff\xd8\xff\xd9", None), (b"<html>", None), (b"\x89PNG\r\n\x1a\n", None)])
def test_sizes_by_structure(content, size):
    got = size_of(content, content[-16:])
    assert (got[:2] if got[0] is not None else None) == size


def test_files_of_a_folder(spark, tmp_path):
    files = {"a.png": png(900, 7), "b.jpg": jpeg(640, 480, 65533, 65533), "c.png": b"", "d.gif": b"no image", "e.png": png(10, 10, False)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    expected = spark.createDataFrame([("i", k, f"{tmp_path}/{name}") for k, name in enumerate([*files, "absent.png"])], "issue_id string, page_no int, image_path string")
    got = {r.page_no: (r.width, r.unreadable, r.low_resolution) for r in S.image_files(spark, str(tmp_path), expected).collect()}
    assert got == {0: (900, False, False), 1: (640, False, True), **dict.fromkeys((2, 3, 4, 5), (None, True, False))}
