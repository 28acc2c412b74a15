"""Region rasters: one byte a pixel says its region. Rows: name, width, height, pixels (binary)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import formats
from ..functions.binary import uint_le
from ..sources.arrow import flat_map


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds width, height, pixels, error of raster files: 8 bytes of dimensions, then width * height bytes."""
    c = F.col(content)
    w, h = uint_le(c, 0, 4), uint_le(c, 4, 4)
    error = (
        F.when(h.isNull(), "shorter than its header").when((w == 0) | (h == 0), "empty dimensions")
        .when(w * h > formats.MOST_PIXELS, "more pixels than allowed").when(F.octet_length(c) != w * h + 8, "length is not width * height + 8")
    )
    body = F.expr(f"substring({content}, 9)")
    return files.withColumns({"width": w, "height": h, "error": error}).withColumn("pixels", F.when(F.col("error").isNull(), body))


def pixels(rasters: DataFrame) -> DataFrame:
    """name, x, y, value of every pixel: a raster becomes lines, then lines become pixels, so that no row holds more
    than the raster once and no array more than a line."""
    at = lambda y: F.substring("pixels", (y * F.col("width") + 1).cast("int"), F.col("width").cast("int"))
    lines = rasters.where("pixels is not null").select("name", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1), at)).alias("y", "line"))
    lines = lines.select("name", F.col("y").cast("long").alias("y"), F.hex("line").alias("h"))
    digits = F.transform(F.sequence(F.lit(0), (F.length("h") / 2 - 1).cast("int")), lambda x: F.conv(F.substring("h", (2 * x + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    return lines.select("name", "y", F.posexplode(digits).alias("x", "value")).select("name", F.col("x").cast("long").alias("x"), "y", "value")


def with_regions(rasters: DataFrame) -> DataFrame:
    """Adds region_ids, the values in order that a raster has: one pass over its bytes, no row a pixel."""
    place = rasters.columns.index("pixels")

    def read(*row) -> Iterator[tuple]:
        data = row[place]
        yield (*row, None if data is None else np.flatnonzero(np.bincount(np.frombuffer(data, np.uint8), minlength=256)).tolist())

    return flat_map(rasters, read, StructType([*rasters.schema.fields, StructField("region_ids", ArrayType(IntegerType()))]), block=16)


def histogram(cells: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """name (null for all rasters together), value, pixel_count."""
    sets = [[F.col(name), F.col(value)], [F.col(value)]]
    return cells.groupingSets(sets, name, value).agg(F.count("*").alias("pixel_count"))


def summary(counts: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Per raster: min, max, distinct values and the histogram in order of value."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), F.col("pixel_count").alias("count"))))
    return counts.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("distinct_values"), ordered.alias("histogram"))


def palette(spark) -> DataFrame:
    """256 rows id, red, green, blue: hues at golden-ratio steps, saturation 0.78, value 1."""
    hue = F.col("id") * F.lit(0.618033988749895)
    hue = (hue - F.floor(hue)) * 6
    sector = F.floor(hue)
    f, s = hue - sector, F.lit(0.78)
    v, p, q, t = F.lit(1.0), 1.0 - s, 1.0 - s * f, 1.0 - s * (1.0 - f)
    pick = lambda *x: F.bround(255 * F.element_at(F.array(*x), (sector % 6 + 1).cast("int"))).cast("int")
    return spark.range(256).withColumn("id", F.col("id").cast("int")).select("id", pick(v, q, p, p, t, v).alias("red"), pick(t, v, v, q, p, p).alias("green"), pick(p, p, t, v, v, q).alias("blue"))


def coloured(cells: DataFrame, colours: DataFrame, value: str = "value") -> DataFrame:
    """Pixels with their colours; the palette has 256 rows and is broadcast."""
    return cells.join(F.broadcast(colours), F.col(value) == F.col("id")).drop("id")


def regions_of(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """Pixels (red, green, blue) back to region ids; unknown colours have none."""
    return cells.join(F.broadcast(colours), ["red", "green", "blue"], "left").withColumnRenamed("id", "value")


def nearest(target: Column, source_size: int | Column, target_size: int | Column) -> Column:
    """Source place of a target place in nearest-neighbour resizing."""
    s, t = (x if isinstance(x, Column) else F.lit(x) for x in (source_size, target_size))
    return F.least(s - 1, F.floor(target * s / t))


def over_grey(channel: Column, alpha: Column) -> Column:
    """A channel laid over grey 32 by its alpha."""
    return F.floor((channel * alpha + 32 * (255 - alpha) + 127) / 255)


def blended(background: Column, colour: Column, region: Column, opacity: float) -> Column:
    """A palette channel over a background channel; region 0 leaves the background."""
    w = round(opacity * 256)
    return F.when(region == 0, background).otherwise(F.shiftright(colour * w + background * (256 - w) + 128, 8))


def new_regions(edited: DataFrame, original: DataFrame, name: str = "name") -> DataFrame:
    """Rasters whose edit uses regions that the original has not: name, new_ids. Rows: name, region_ids."""
    both = edited.join(original.select(name, F.col("region_ids").alias("old")), name)
    return both.select(name, F.array_sort(F.array_except("region_ids", "old")).alias("new_ids")).where(F.size("new_ids") > 0)


#: Endings that a raster's picture lacks, tried in this order.
ENDINGS = ("_WIDE_FULL", "_WIDE_NOTE", "_WIDE", "_FULL", "_NOTE", "_H")


def companions(rasters: DataFrame, pictures: DataFrame) -> DataFrame:
    """The picture of each raster: the same stem, or the stem without the first of ENDINGS that it has.

    Rows: folder, stem; pictures also path. Case is ignored; the stem itself comes first; without a picture no row.
    """
    stem = F.upper("stem")
    shorter = None
    for e in ENDINGS:
        test, cut = F.endswith(stem, F.lit(e)), F.expr(f"left(stem, length(stem) - {len(e)})")
        shorter = F.when(test, cut) if shorter is None else shorter.when(test, cut)
    candidates = F.array_compact(F.array("stem", shorter))
    tried = rasters.select("folder", "stem", F.posexplode(candidates).alias("priority", "candidate")).withColumn("low", F.lower("candidate"))
    found = tried.join(pictures.select("folder", F.lower("stem").alias("low"), F.col("path").alias("picture")), ["folder", "low"])
    first = F.row_number().over(Window.partitionBy("folder", "stem").orderBy("priority", "picture"))
    return found.withColumn("n", first).where("n = 1").select("folder", "stem", "picture", "priority")
