"""May an edited asset stand for the original? Structs of properties in, lists of errors and warnings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

def _list(*found: Column) -> Column:
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _changed(old: Column, new: Column, field: str) -> Column:
    return ~old[field].eqNullSafe(new[field])


def png(old: Column, new: Column) -> tuple[Column, Column]:
    """Dimensions, bit depth, interlacing must stay; so must the colour type, but for adding or dropping alpha."""
    colours = F.array_sort(F.array(old["color_type"], new["color_type"]))
    swap = (colours == F.array(F.lit(2), F.lit(6))) | (colours == F.array(F.lit(0), F.lit(4)))
    turned = _changed(old, new, "color_type")
    errors = _list(
        F.when(_changed(old, new, "width") | _changed(old, new, "height"), "dimensions changed"), F.when(_changed(old, new, "bit_depth"), "bit depth changed"),
        F.when(_changed(old, new, "interlace"), "interlacing changed"), F.when(turned & ~swap, "color type changed"),
    )
    return errors, _list(F.when(turned & swap, "alpha channel changed"))


def ogg(old: Column, new: Column) -> tuple[Column, Column]:
    errors = _list(*[F.when(_changed(old, new, f), f"{f} changed") for f in ("codec", "channels", "sample_rate")])
    return errors, _list(F.when(_changed(old, new, "nominal_bitrate"), "nominal_bitrate changed"))


def asf(old: Column, new: Column) -> tuple[Column, Column]:
    """Streams one by one; another number of streams is the only error then. Duration only warns."""
    differs = F.size(old["streams"]) != F.size(new["streams"])
    at = F.sequence(F.lit(1), F.size(old["streams"]))

    def of(i: Column) -> Column:
        a, b = F.element_at(old["streams"], i), F.element_at(new["streams"], i)
        label = F.concat(F.lit("stream "), i.cast("string"))
        say = lambda test, what: F.when(test, F.concat(label, F.lit(f" {what} changed")))
        same = a["type"].eqNullSafe(b["type"])
        video, audio = same & (a["type"] == "video"), same & (a["type"] == "audio")
        return F.array_compact(F.array(say(~same, "type"), *[say(video & _changed(a, b, f), f) for f in ("width", "height", "codec")], *[say(audio & _changed(a, b, f), f) for f in ("format_tag", "channels", "sample_rate")]))

    inside = F.flatten(F.transform(F.when(F.size(old["streams"]) > 0, at).otherwise(F.array().cast("array<int>")), of))
    errors = F.when(differs, F.array(F.lit("number of streams changed"))).otherwise(inside)
    return errors, _list(F.when(~differs & _changed(old, new, "duration_seconds"), "duration changed"))


def raster(old: Column, new: Column) -> tuple[Column, Column]:
    fresh = F.array_sort(F.array_except(new["region_ids"], old["region_ids"]))
    say = F.format_string("dimensions changed from %dx%d to %dx%d", old["width"], old["height"], new["width"], new["height"])
    errors = _list(F.when(_changed(old, new, "width") | _changed(old, new, "height"), say), F.when(F.size(fresh) > 0, F.concat(F.lit("new region IDs: "), F.array_join(fresh.cast("array<string>"), ", "))))
    return errors, F.array().cast("array<string>")


def text(old: Column, new: Column) -> tuple[Column, Column]:
    """Encoding, sections and keys must stay. A baseline without sections may gain a byte-order mark."""
    legacy = old["sections"].isNull() & (old["encoding"] == "UTF-8") & (new["encoding"] == "UTF-8-SIG")
    kept = lambda f: F.when(old[f].isNotNull() & _changed(old, new, f), f"text structure changed: {f}")
    errors = _list(F.when(_changed(old, new, "encoding") & ~F.coalesce(legacy, F.lit(False)), "text encoding changed"), kept("sections"), kept("keys"))
    return errors, _list(F.when(old["newlines"].isNotNull() & _changed(old, new, "newlines"), "text newline convention changed"))


def compared(rows: DataFrame, rule, old: str = "old", new: str = "new") -> DataFrame:
    errors, warnings = rule(F.col(old), F.col(new))
    return rows.withColumn("errors", errors).withColumn("warnings", warnings)


def manifest_violations(files: DataFrame, archives: DataFrame) -> DataFrame:
    """rule, n of every rule that a package manifest breaks.

    files: archive, path, member, size_bytes, original_sha256, modified_sha256; archives: name.
    """
    known = archives.select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    f = files.withColumn("low", F.lower("archive")).join(known, "low", "left")
    member = F.concat(F.lit("files/"), F.col("archive"), F.lit("/"), F.col("path"))
    rules = {
        "archive name": ~paths.is_archive_name(F.col("archive")), "archive not declared": F.col("known").isNull(), "path": ~paths.is_relative(F.col("path")),
        "member": ~F.col("member").eqNullSafe(member), "size": F.coalesce(F.col("size_bytes") < 0, F.lit(True)),
        "original digest": ~F.coalesce(paths.is_digest(F.col("original_sha256")), F.lit(False)), "modified digest": ~F.coalesce(paths.is_digest(F.col("modified_sha256")), F.lit(False)),
        "unchanged file": F.col("original_sha256").eqNullSafe(F.col("modified_sha256")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]))
    each = f.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    twice = f.groupBy("low", F.lower("path").alias("p")).count().where("count > 1").agg(F.lit("duplicate path").alias("rule"), F.count("*").alias("n")).where("n > 0")
    return each.unionByName(twice)


def basic_errors(size: Column, name: Column, is_file: Column) -> Column:
    """What is wrong with an archive before it is opened."""
    return _list(F.when(size.isNull(), "does not exist"), F.when(size.isNotNull() & ~is_file, "is not a file"), F.when(size == 0, "is empty"), F.when(~F.lower(name).endswith(".gpk"), "has another extension"))


def payload_failure(old: Column, new: Column) -> Column:
    """The first thing that keeps a payload out of a container, or null."""
    return (
        F.when(new["size"].isNull(), "payload is missing").when(new["size"] > (1 << 32) - 1, "payload is too large").when(_changed(old, new, "payload_type"), "payload type changed")
        .when((new["payload_type"] == "PNG") & (_changed(old, new, "width") | _changed(old, new, "height")), "dimensions changed")
        .when((new["payload_type"] == "PNG") & (F.coalesce(new["trailing_bytes"], F.lit(0)) > 0), "bytes after the image")
        .when((new["payload_type"] == "FOLDER") & _changed(old, new, "sha256"), "folder payload changed")
    )
