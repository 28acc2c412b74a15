"""Formats of assets by extension and first bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import uint_le

UNKNOWN = "UNKNOWN"
#: First bytes (hex) and what they mean, in order of precedence.
SIGNATURES = [
    ("89504E470D0A1A0A", "PNG"), ("424D", "BMP"), ("44445320", "DDS"), ("52494646", "RIFF container (WAV/AVI/WebP)"), ("4F676753", "Ogg"), ("494433", "MP3 with ID3"),
    ("504B0304", "ZIP"), ("1F8B", "GZIP"), ("4D5A", "Windows executable"), ("FFD8FF", "JPEG"), ("474946383761", "GIF"), ("474946383961", "GIF"),
]
ASF = "3026B2758E66CF11A6D900AA0062CE6C"
RIFF_KINDS = [("57415645", "WAV"), ("41564920", "AVI"), ("57454250", "WebP")]
DS_STORE = "0000000142756431"
CONTAINER = "CD326E5914000000FFFF010004004352696F"
FOLDER = "A4CBF62914000000FFFF01000B00434175746F466F6C646572"
#: Formats by extension.
BY_EXTENSION = {".png": "PNG", ".ogg": "Ogg", ".wmv": "ASF/WMV", ".asf": "ASF/WMV", ".cmap": "CMAP", ".ors": "ORS", ".ini": "INI", ".txt": "TXT", ".dat": "DAT/UNKNOWN"}
#: Formats whose content is checked when an asset changes.
CHECKED = ("PNG", "Ogg", "ASF/WMV", "CMAP", "ORS", "INI", "TXT")
MOST_PIXELS = 100_000_000


def _begins(h: Column, prefix: str) -> Column:
    return F.startswith(h, F.lit(prefix))


def by_extension(extension: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(table[F.lower(extension)], F.lit(UNKNOWN))


def detect(header: Column, extension: Column | None = None, size: Column | None = None) -> Column:
    """The format that first bytes, extension and size give; the first rule that holds counts."""
    h = F.hex(header)
    ext = F.lower(F.coalesce(extension, F.lit(""))) if extension is not None else F.lit("")
    width, height = uint_le(header, 0, 4), uint_le(header, 4, 4)
    area = width * height
    fits = F.lit(True) if size is None else size.isNull() | (size == area + 8)
    text = F.regexp_replace(h, "^EFBBBF", "")
    zero = text.rlike("^(..)*?00")
    out = F.when((ext == ".ors") & h.rlike("^(20|09|0A|0B|0C|0D)*5B"), "ORS script")
    out = out.when(ext.isin(".ds_store", "[no extension]") & _begins(h, DS_STORE), "macOS DS_Store").when(_begins(h, ASF), "ASF/WMV")
    out = out.when((ext == ".cmap") & (width > 0) & (height > 0) & (area <= MOST_PIXELS) & fits, "CMAP raster")
    out = out.when((ext == ".ini") & _begins(text, "5B"), "INI text").when((ext == ".txt") & ~zero, "UTF-8 text")
    for prefix, label in SIGNATURES:
        if label.startswith("RIFF"):
            for kind, sub in RIFF_KINDS:
                out = out.when(_begins(h, prefix) & (F.substring(h, 17, 8) == kind), sub)
        out = out.when(_begins(h, prefix), label)
    return out.otherwise(UNKNOWN)


def is_container(content: Column) -> Column:
    """Do bytes begin as an object container does?"""
    return F.coalesce(_begins(F.hex(F.substring(content, 1, len(CONTAINER) // 2)), CONTAINER), F.lit(False))


def payload_type(sample: Column, declared: Column) -> Column:
    """A container payload's type by first bytes, then by the class its record declares."""
    h = F.hex(sample)
    out = F.when(_begins(h, SIGNATURES[0][0]), "PNG")
    for prefix, label in (("4F676753", "OGG"), (ASF, "WMV_ASF"), ("52494646", "RIFF"), ("424D", "BMP"), ("44445320", "DDS"), ("FFD8FF", "JPEG"), ("504B0304", "ZIP"), (CONTAINER, "CRIO")):
        out = out.when(_begins(h, prefix), label)
    out = out.when((h == FOLDER) | declared.eqNullSafe(F.lit("CAutoFolder")), "FOLDER")
    return out.when(declared.isNotNull() & (declared != ""), declared).otherwise(UNKNOWN)


def sections(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?md)^\s*\[([^\]\r\n]+)\]"), F.lit(1))


def keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?md)^\s*([^\s=\[\];#][^=\r\n]*?)\s*="), F.lit(1))


def footer(data: Column, size: Column) -> Column:
    """The 32-byte footer of a stack archive; signatures and size stay even where it is not valid."""
    first, last = F.decode(F.substring(data, 1, 12), "ISO-8859-1"), F.decode(F.substring(data, 17, 16), "ISO-8859-1")
    index_size = uint_le(data, 12, 4)
    offset = size - 32 - index_size
    whole = F.octet_length(data) == 32
    valid = whole & (first == "STKFile0PIDX") & (last == "STKFile0PACKFILE") & (offset >= 0)
    return F.struct(
        F.lit("Stack PIDX").alias("format"), F.coalesce(valid, F.lit(False)).alias("valid"), F.when(whole, first).alias("index_signature"), F.when(whole, last).alias("archive_signature"),
        F.when(whole, index_size).alias("index_size"), F.when(valid, offset).alias("index_offset"),
    )
