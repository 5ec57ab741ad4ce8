"""Width and height of images from their first bytes."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def dimensions(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) of PNG, GIF, BMP, ICO, WebP, JPEG and SVG data; the largest picture of an ICO; None where unknown."""
    data = bytes(data or b"")
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:4] == b"\x00\x00\x01\x00":
            sizes = [(data[6 + 16 * k] or 256, data[7 + 16 * k] or 256) for k in range(struct.unpack("<H", data[4:6])[0])]
            return ("ico", *max(sizes, key=lambda s: s[0] * s[1]))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return "webp", w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                mark = data[at + 1]
                if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
                    at += 1 if mark == 0xFF else 2
                    continue
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
            return "jpeg", None, None
    except (struct.error, IndexError, ValueError):
        return None, None, None
    head = data[:4096].decode("utf-8", "replace")
    if m := re.search(r"<svg\b[^>]*>", head, re.IGNORECASE):
        w, h = (re.search(rf"\b{n}\s*=\s*[\"']\s*([\d.]+)(?:px)?\s*[\"']", m[0]) for n in ("width", "height"))
        if w and h:
            return "svg", round(float(w[1])), round(float(h[1]))
        box = re.search(r"viewBox\s*=\s*[\"']\s*[-\d.]+[\s,]+[-\d.]+[\s,]+([\d.]+)[\s,]+([\d.]+)", m[0])
        return ("svg", round(float(box[1])), round(float(box[2]))) if box else ("svg", None, None)
    return None, None, None


def image_dimensions(content: Column) -> Column:
    """Struct of format, width and height of binary data."""

    @F.pandas_udf(StructType.fromDDL("format string, width int, height int"))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame([dimensions(d) for d in rows], columns=["format", "width", "height"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return run(content)
