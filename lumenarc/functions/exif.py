"""EXIF of JPEG files: dates and position read, and written without touching what else the file holds.

A TIFF block is a tree of directories that point into it by offsets. Writing
appends new directories to the block and redirects the header; every old
offset (maker notes, thumbnail) stays valid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Fixed values of the EXIF format: tag numbers, and the bytes of each value type.
DATE_TIME, ORIGINAL, DIGITIZED = 0x0132, 0x9003, 0x9004
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
HEAD_BYTES = 64 * 1024
DATE_FORMAT = "%Y:%m:%d %H:%M:%S"

FIELDS = StructType([StructField("original", StringType()), StructField("modified", StringType()), StructField("latitude", DoubleType()), StructField("longitude", DoubleType())])

Entries = dict[int, tuple[int, int, bytes]]


def segments(jpeg: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of each segment before the image data; a cut or broken file ends early."""
    if jpeg[:2] != b"\xff\xd8":
        return
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF:
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4])
        if marker == 0xDA or length < 2 or at + 2 + length > len(jpeg):
            return
        yield marker, at, at + 2 + length
        at += 2 + length


def find_tiff(jpeg: bytes) -> tuple[int, int] | None:
    """Where the EXIF segment is."""
    return next(((a, b) for m, a, b in segments(jpeg) if m == 0xE1 and jpeg[a + 4 : a + 10] == b"Exif\0\0"), None)


class Tiff:
    """One TIFF block. Directories and values outside it are read as absent."""

    def __init__(self, block: bytes):
        self.block = block
        self.order = {b"II": "<", b"MM": ">"}.get(block[:2])
        if self.order is None or len(block) < 8:
            raise ValueError("not a TIFF block")

    def number(self, at: int, size: int) -> int:
        return struct.unpack_from(self.order + {2: "H", 4: "I"}[size], self.block, at)[0]

    def directory(self, at: int) -> tuple[Entries, int]:
        """Entries by tag (type, count, the four raw bytes) and the offset of the next directory."""
        if at < 8 or at + 2 > len(self.block):
            return {}, 0
        end = at + 2 + 12 * self.number(at, 2)
        if end + 4 > len(self.block):
            return {}, 0
        found = {self.number(e, 2): (self.number(e + 2, 2), self.number(e + 4, 4), self.block[e + 8 : e + 12]) for e in range(at + 2, end, 12)}
        return found, self.number(end, 4)

    def first(self) -> tuple[Entries, int]:
        return self.directory(self.number(4, 4))

    def below(self, entries: Entries, tag: int) -> Entries:
        return self.directory(struct.unpack(self.order + "I", entries[tag][2])[0])[0] if tag in entries else {}

    def value(self, entries: Entries, tag: int) -> bytes | None:
        if tag not in entries:
            return None
        kind, count, raw = entries[tag]
        size = TYPE_BYTES.get(kind, 1) * count
        if size <= 4:
            return raw[:size]
        at = struct.unpack(self.order + "I", raw)[0]
        return self.block[at : at + size] if at + size <= len(self.block) else None

    def text(self, entries: Entries, tag: int) -> str | None:
        raw = self.value(entries, tag)
        return raw.split(b"\0")[0].decode("latin-1").strip() or None if raw else None

    def degrees(self, entries: Entries, tag: int, negative: str) -> float | None:
        raw = self.value(entries, tag)
        if raw is None or len(raw) != 24:
            return None
        n = struct.unpack(self.order + "6I", raw)
        if 0 in n[1::2]:
            return None
        size = n[0] / n[1] + n[2] / n[3] / 60 + n[4] / n[5] / 3600
        return -size if (self.text(entries, tag - 1) or "").upper() == negative else size


def read(jpeg: bytes | None) -> tuple[str | None, str | None, float | None, float | None]:
    """Original date, date of change, latitude, longitude; null where absent, broken or not a JPEG."""
    try:
        where = find_tiff(jpeg or b"")
        if where is None:
            return None, None, None, None
        tiff = Tiff(jpeg[where[0] + 10 : where[1]])
        top = tiff.first()[0]
        gps = tiff.below(top, GPS_IFD)
        return tiff.text(tiff.below(top, EXIF_IFD), ORIGINAL), tiff.text(top, DATE_TIME), tiff.degrees(gps, 2, "S"), tiff.degrees(gps, 4, "W")
    except (ValueError, struct.error):
        return None, None, None, None


@F.pandas_udf(FIELDS)
def fields(head: pd.Series) -> pd.DataFrame:
    """The EXIF fields of each file from its first 64 KiB, Arrow batch by batch."""
    return pd.DataFrame([read(h) for h in head], columns=["original", "modified", "latitude", "longitude"]).astype({"latitude": float, "longitude": float})


def _rationals(order: str, degrees: float) -> bytes:
    whole = round(abs(degrees) * 3600 * 10000)
    minutes, rest = divmod(whole, 60 * 10000)
    return struct.pack(order + "6I", minutes // 60, 1, minutes % 60, 1, rest, 10000)


def with_tags(jpeg: bytes, taken: datetime | None = None, position: tuple[float, float] | None = None) -> bytes:
    """The JPEG with these fields set; ValueError if it is none or its EXIF segment would be too long.

    The position (0, 0) means none is known and isn't written.
    """
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    where = find_tiff(jpeg)
    tiff = Tiff(jpeg[where[0] + 10 : where[1]] if where else b"MM\0*\0\0\0\0")
    order, block = tiff.order, bytearray(tiff.block)

    def append(entries: Entries, new: dict[int, tuple[int, bytes]], following: int) -> int:
        for tag, (kind, data) in new.items():
            if len(data) > 4:
                block.extend(b"\0" * (len(block) % 2))
                raw = struct.pack(order + "I", len(block))
                block.extend(data)
            else:
                raw = data.ljust(4, b"\0")
            entries[tag] = (kind, len(data) // TYPE_BYTES[kind], raw)
        block.extend(b"\0" * (len(block) % 2))
        at = len(block)
        block.extend(struct.pack(order + "H", len(entries)))
        for tag, (kind, count, raw) in sorted(entries.items()):
            block.extend(struct.pack(order + "HHI", tag, kind, count) + raw)
        block.extend(struct.pack(order + "I", following))
        return at

    top, following = tiff.first()
    changes: dict[int, tuple[int, bytes]] = {}
    if taken is not None:
        clock = taken.strftime(DATE_FORMAT).encode() + b"\0"
        at = append(tiff.below(top, EXIF_IFD), {ORIGINAL: (2, clock), DIGITIZED: (2, clock)}, 0)
        changes |= {DATE_TIME: (2, clock), EXIF_IFD: (4, struct.pack(order + "I", at))}
    if position is not None and position != (0, 0):
        north, east = position
        gps = {0: (1, b"\2\3\0\0"), 1: (2, b"S\0" if north < 0 else b"N\0"), 2: (5, _rationals(order, north)), 3: (2, b"W\0" if east < 0 else b"E\0"), 4: (5, _rationals(order, east))}
        changes[GPS_IFD] = (4, struct.pack(order + "I", append(tiff.below(top, GPS_IFD), gps, 0)))
    if not changes:
        return jpeg
    block[4:8] = struct.pack(order + "I", append(top, changes, following))
    if len(block) + 8 > 0xFFFF:
        raise ValueError("no room in the EXIF segment")
    segment = b"\xff\xe1" + (len(block) + 8).to_bytes(2) + b"Exif\0\0" + bytes(block)
    before, after = where or (2, 2)
    return jpeg[:before] + segment + jpeg[after:]
