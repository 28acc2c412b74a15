"""Numbers, hexadecimal text and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1
#: Fixed values of the container's codec.
OFFSET_SHIFT = 0xA2FB6AD1
SIZE_SHIFT = 0xE7B5D9F8


def _bytes(data: Column, at: int, n: int) -> Column:
    return F.hex(F.substring(data, at + 1, n))


def uint_be(data: Column, at: int, n: int) -> Column:
    """Unsigned number of n (1 to 7) bytes, most significant first; null if they are not all there."""
    h = _bytes(data, at, n)
    return F.when(F.length(h) == 2 * n, F.conv(h, 16, 10).cast("long"))


def uint_le(data: Column, at: int, n: int) -> Column:
    """Unsigned number of n (1 to 7) bytes, least significant first; null if they are not all there."""
    h = _bytes(data, at, n)
    swapped = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.when(F.length(h) == 2 * n, F.conv(swapped, 16, 10).cast("long"))


def hex_text(data: Column) -> Column:
    """'89 50 4E' of bytes."""
    return F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))


def printable(data: Column) -> Column:
    """Bytes as ASCII text, a dot for each that does not print."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), r"[^\x20-\x7E]", ".")


def from_hex(text: Column) -> Column:
    """Bytes of hexadecimal text with any white space; none where it is invalid or null."""
    return F.coalesce(F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("hex")), F.to_binary(F.lit(""), F.lit("hex")))


def human_size(size: Column) -> Column:
    """'1.50 KiB', up to GiB; halves round to even, as C prints them."""
    out = None
    for k, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB")))):
        x = size / F.lit(float(1024**k))
        text = F.concat(size.cast("string"), F.lit(" B")) if k == 0 else F.format_string(f"%.2f {unit}", F.bround(x, 2))
        out = text if out is None else F.when(size < 1024 ** (k + 1), text).otherwise(out)
    return out


def space_needed(estimate: Column) -> Column:
    """Bytes to ask for before writing: a hundredth more, 16 MiB more at least."""
    return estimate + F.greatest(F.lit(16 << 20), F.floor(estimate / 100))


def encode_offset(offset: Column) -> Column:
    return (offset + F.lit(OFFSET_SHIFT)).bitwiseAND(F.lit(MASK32))


def decode_offset(stored: Column) -> Column:
    return (stored - F.lit(OFFSET_SHIFT)).bitwiseAND(F.lit(MASK32))


def encode_size(size: Column) -> Column:
    """A payload's size as the container stores it: constant + size rotated by 13 bits + its low 12 bits."""
    rotated = F.shiftleft(size, 13).bitwiseAND(F.lit(MASK32)).bitwiseOR(F.shiftright(size, 19))
    return (F.lit(SIZE_SHIFT) + rotated + size.bitwiseAND(F.lit(0xFFF))).bitwiseAND(F.lit(MASK32))
