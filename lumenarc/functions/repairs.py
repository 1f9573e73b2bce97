"""Repairs of names and sampled signatures of contents.

NFC and FNV have no built-in form; they are Arrow-batched, NFC for names beyond ASCII alone.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spanish letters that code page 437 has where Latin-1 has these signs; constants of FNV-1a.
LATIN_SIGNS, LETTERS = "\u00a0\u00a1\u00a2\u00a3\u00a4\u00a5", "áíóúñÑ"
FNV32_BASIS, FNV32_PRIME = 0x811C9DC5, 0x01000193
FNV64_BASIS, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
CHUNK, TWO_POINT_FROM = 4096, 64 << 20
TWO_POINT_EXTENSIONS = ["mp4", "mov", "m4v", "mkv", "avi", "hevc", "heif", "heic", "webm"]

EMOJI = r"[[\p{Emoji}--[0-9#*]]\uFE0E\uFE0F]"


def enye(name: Column) -> Column:
    """A yen sign is Ñ beside a capital, else ñ."""
    return F.regexp_replace(F.regexp_replace(name, "(?<=[A-ZÑ])¥|¥(?=[A-ZÑ])", "Ñ"), "¥", "ñ")


def utf8_read_as_latin1(name: Column) -> Column:
    """Reads the characters as Latin-1 bytes of UTF-8 text, if the name shows the usual marks and loses them by it."""
    marked = name.rlike("[ÃÂ]") & name.rlike(r"^[\x00-\xff]*$")
    again = F.when(marked, F.make_valid_utf8(F.encode(F.when(marked, name), "ISO-8859-1").cast("string")))
    return F.when(again.isNotNull() & ~again.rlike("[ÃÂ]"), again).otherwise(name)


def cp437_read_as_latin1(name: Column) -> Column:
    return F.when(name.rlike(r"[\u00a0\u00a2\u00a3\u00a4]"), F.translate(name, LATIN_SIGNS, LETTERS)).otherwise(name)


def repair(name: Column) -> Column:
    """All three repairs, in the order that archives need."""
    return cp437_read_as_latin1(utf8_read_as_latin1(enye(name)))


@F.pandas_udf(StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(name: Column) -> Column:
    """Characters and accents composed; names of ASCII alone, which have none to compose, don't leave the JVM."""
    return F.coalesce(_composed(F.when(name.rlike(r"[^\x00-\x7f]"), name)), name)


@cache
def emoji_ranges() -> str:
    """The characters of EMOJI as ranges of a pattern's class: the JVM's patterns know no such property."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = [ord(c) for c in regex.findall(f"(?V1){EMOJI}", every)]
    starts = [c for c, before in zip(found, [-2, *found], strict=False) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -2], strict=True) if after != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


def emoji_to_hex(name: Column) -> Column:
    """``_0x1f600_`` for each emoji and variation selector; with one, also for all beyond the basic plane."""
    code = lambda c: F.concat(F.lit("_0x"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-32"))), "^0+", ""), F.lit("_"))
    coded = F.transform(F.regexp_extract_all(name, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(c.rlike(rf"[{emoji_ranges()}\x{{10000}}-\x{{10FFFF}}]"), code(c)).otherwise(c))
    return F.when(name.rlike(f"[{emoji_ranges()}]"), F.array_join(coded, "")).otherwise(name)


def hex_to_emoji(path: Column) -> Column:
    """Undoes ``emoji_to_hex`` in the last segment; numbers of no character stay as they are."""
    form = r"_0x([0-9a-fA-F]{1,6})_"
    head = F.regexp_extract(path, "(?s)^(?:.*/)?", 0)
    last = F.substring(path, F.length(head) + 1, F.length(path))

    def char(code: Column) -> Column:
        n = F.conv(code, 16, 10).cast("int")
        known = (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(F.concat(F.lit("_0x"), code, F.lit("_")))

    # One text more than there are codes: nothing follows the last.
    back = F.zip_with(F.split(last, form, -1), F.regexp_extract_all(last, F.lit(form), F.lit(1)), lambda text, code: F.concat(text, F.coalesce(char(code), F.lit(""))))
    return F.when(last.rlike(form), F.concat(head, F.array_join(back, ""))).otherwise(path)


#: Bytes of contents that are hashed at a time.
GRID = 16 << 20


def fnv1a(slices: list[bytes], basis: int, prime: int, dtype: type) -> np.ndarray:
    """FNV-1a of each slice: byte by byte, all slices at a time, in unsigned arithmetic that wraps."""
    sizes = np.array([len(s) for s in slices], np.int64)
    order, out, at = np.argsort(-sizes, kind="stable"), np.full(len(slices), basis, dtype), 0
    while at < len(order) and sizes[order[at]]:
        # The longest that are left, as many as fit into one grid of their width.
        own = order[at : at + max(1, GRID // int(sizes[order[at]]))]
        grid = np.zeros((len(own), sizes[own[0]]), np.uint8)
        for row, i in enumerate(own):
            grid[row, : sizes[i]] = np.frombuffer(slices[i], np.uint8)
        h, live = np.full(len(own), basis, dtype), np.searchsorted(-sizes[own], -np.arange(grid.shape[1]), "left")
        for j, n in enumerate(live):
            h[:n] = (h[:n] ^ grid[:n, j]) * dtype(prime)
        out[own] = h
        at += len(own)
    return out


def signatures_of(sizes: list[int], exts: list[str], heads: list[bytes], middles: list[bytes], tails: list[bytes]) -> list[str]:
    """``size|ext|head|middle|tail``, each 4 KiB in FNV-1a 32; films and files from 64 MiB have no middle (0)."""
    no_middle = [n <= CHUNK or e in TWO_POINT_EXTENSIONS or n >= TWO_POINT_FROM for n, e in zip(sizes, exts, strict=True)]
    head, middle, tail = (fnv1a(slices, FNV32_BASIS, FNV32_PRIME, np.uint32) for slices in (heads, middles, tails))
    return [f"{n}|{e}|{x}|{0 if skip else y}|{z}" for n, e, x, y, z, skip in zip(sizes, exts, head, middle, tail, no_middle, strict=True)]


@F.pandas_udf(StringType())
def slice_signature(size: pd.Series, ext: pd.Series, head: pd.Series, middle: pd.Series, tail: pd.Series) -> pd.Series:
    """The signature of a content of which only three slices are at hand."""
    return pd.Series(signatures_of([int(n) if pd.notna(n) else 0 for n in size], list(ext), *([b or b"" for b in x] for x in (head, middle, tail))))


@F.pandas_udf(StringType())
def quick_signature(content: pd.Series, ext: pd.Series) -> pd.Series:
    """The signature of a whole content."""
    bodies = [b or b"" for b in content]
    n = CHUNK
    return pd.Series(signatures_of([len(b) for b in bodies], list(ext), [b[:n] for b in bodies], [b[len(b) // 2 : len(b) // 2 + n] for b in bodies], [b[max(0, len(b) - n) :] for b in bodies]))


@F.pandas_udf(StringType())
def sample_fingerprint(content: pd.Series) -> pd.Series:
    """``<size>b:head:middle:tail``, each up to 64 KiB in FNV-1a 64 hex; ``SZ0`` for nothing."""
    n = 64 << 10
    bodies = [b or b"" for b in content]
    starts = [(0, max(0, len(b) // 2 - n // 2), max(0, len(b) - n)) for b in bodies]
    prints = [fnv1a([b[s[k] : s[k] + n] for b, s in zip(bodies, starts, strict=True)], FNV64_BASIS, FNV64_PRIME, np.uint64) for k in range(3)]
    return pd.Series([f"{len(b)}b:{x:016x}:{y:016x}:{z:016x}" if b else "SZ0" for b, x, y, z in zip(bodies, *prints, strict=True)])


def type_by_content(head: Column) -> Column:
    """The MIME type that the first bytes show, of the types with a preferred extension; null if they show none."""
    starts = lambda hexed, at=0: F.hex(F.substring(head, at + 1, len(hexed) // 2)) == hexed
    brand = lambda *names: starts("66747970", 4) & F.substring(head, 9, 4).cast("string").isin(*names)
    riff = lambda kind: starts("52494646") & starts(kind, 8)
    return (
        F.when(starts("FFD8FF"), "image/jpeg").when(starts("89504E470D0A1A0A"), "image/png").when(starts("47494638"), "image/gif")
        .when(riff("57454250"), "image/webp").when(riff("41564920"), "video/x-msvideo")
        .when(brand("heic", "heix", "mif1", "msf1"), "image/heic").when(brand("avif"), "image/avif").when(brand("qt  "), "video/quicktime")
        .when(starts("667479703367", 4), "video/3gpp").when(starts("66747970", 4), "video/mp4").when(starts("1A45DFA3"), "video/x-matroska")
        .when(starts("49492A00") | starts("4D4D002A"), "image/tiff").when(starts("424D"), "image/bmp").when(starts("464C5601"), "video/x-flv")
    )
