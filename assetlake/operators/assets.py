"""Edited assets against their originals: every format is read in full, then the rules of ``rules`` compare."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..sources import media
from ..sources.arrow import flat_map
from . import raster, rules


def with_content(rows: DataFrame, location: str = "location") -> DataFrame:
    """Adds the content of the file at ``location``, read in the task of its row."""
    names = rows.columns

    def read(*row) -> Iterator[tuple]:
        with open(row[names.index(location)], "rb") as f:
            yield (*row, f.read())

    return flat_map(rows, read, StructType([*rows.schema.fields, StructField("content", BinaryType())]), block=16)


def _rasters(files: DataFrame) -> DataFrame:
    rows = raster.decoded(files)
    ids = raster.pixels(rows.withColumnRenamed("path", "name")).groupBy(F.col("name").alias("path")).agg(F.array_sort(F.collect_set("value")).alias("region_ids"))
    return rows.join(ids, "path", "left").select("path", "width", "height", "region_ids", "error")


#: What reads a format's files, and what compares two of them.
READERS = {
    "PNG": (media.png_checked, rules.png), "Ogg": (lambda files: media.ogg_properties(media.ogg_pages(files)), rules.ogg), "ASF/WMV": (media.asf_properties, rules.asf),
    "CMAP": (_rasters, rules.raster), "INI": (media.text_properties, rules.text), "TXT": (media.text_properties, rules.text), "ORS": (media.text_properties, rules.text),
}


def compared(pairs: DataFrame) -> DataFrame:
    """archive, path, errors, warnings of edits (archive, path, format, old, new: contents) of the formats that are checked.

    An edit that cannot be read has that as its one error; an original that cannot be read leaves a warning.
    """
    key = F.concat_ws("\x00", "archive", "path")
    out = None
    for reader, rule in {id(r): (r, c) for r, c in READERS.values()}.values():
        names = [n for n, (r, _) in READERS.items() if r is reader]
        own = pairs.where(F.col("format").isin(*names))
        sides = []
        for side in ("old", "new"):
            props = reader(own.select(key.alias("path"), F.col(side).alias("content")))
            fields = [c for c in props.columns if c not in ("path", "text", "content")]
            sides.append(props.select("path", F.struct(*fields).alias(side)))
        both = rules.compared(sides[1].join(sides[0], "path", "left"), rule)
        old, new = F.col("old.error"), F.col("new.error")
        errors = F.when(new.isNotNull(), F.array(new)).when(old.isNotNull(), F.array().cast("array<string>")).otherwise(F.col("errors"))
        warnings = F.when(new.isNotNull(), F.array().cast("array<string>")).when(old.isNotNull(), F.array(F.lit("the original cannot be read"))).otherwise(F.col("warnings"))
        parts = F.split("path", "\x00")
        rows = both.select(parts[0].alias("archive"), parts[1].alias("path"), errors.alias("errors"), warnings.alias("warnings"))
        out = rows if out is None else out.unionByName(rows)
    return out
