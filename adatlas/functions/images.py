"""Sizes of images from their first bytes: no picture is decoded."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file in which its size is looked for first, and bytes of its end.
HEAD, TAIL = 1 << 16, 16
SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("more", T.BooleanType())])


def png(head: bytes, tail: bytes) -> tuple:
    """Width and height of the first chunk, if its checksum holds and the file ends with the last one."""
    if head[12:16] != b"IHDR" or len(head) < 33 or b"IEND" not in tail or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        return None, None, False
    return *struct.unpack(">II", head[16:24]), False


def jpeg(head: bytes) -> tuple:
    """Width and height of the frame header; `more` where the segments before it are longer than what is given."""
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None, None, False
        kind = head[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:  # fill bytes and marks without a body
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return (width, height, False) if width and height else (None, None, False)
        if kind in (0xD9, 0xDA):  # the end, or the picture before any frame
            return None, None, False
        at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None, None, True


def size_of(head: bytes, tail: bytes) -> tuple:
    """(width, height, more) of a PNG, JPEG, GIF or BMP; nulls for any other file or a damaged one."""
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        return png(head, tail)
    if head.startswith(b"\xff\xd8\xff"):
        return jpeg(head)
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 13:
        return *struct.unpack("<HH", head[6:10]), False
    if head.startswith(b"BM") and len(head) >= 26:
        return *map(abs, struct.unpack("<ii", head[18:26])), False
    return None, None, False


@F.pandas_udf(SIZE)
def sizes(heads: pd.Series, tails: pd.Series) -> pd.DataFrame:
    rows = [(None, None, False) if h is None else size_of(bytes(h), bytes(t)) for h, t in zip(heads, tails)]
    return pd.DataFrame(rows, columns=SIZE.names).astype({"width": "Int64", "height": "Int64", "more": bool})


def ends(content: Column) -> tuple[Column, Column]:
    return F.substring(content, 1, HEAD), F.substring(content, -TAIL, TAIL)
