"""Assigning barcodes to places on a slide, and counting occupied regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import tag


def spot_name(row: Column, col: Column, size: int) -> Column:
    """``s_002um_00005_00009-1`` for native 2 um coordinates, binned to ``size`` um (even, at least 2)."""
    if size < 2 or size % 2:
        raise ValueError("the bin size must be even and at least 2")
    at = lambda c: F.floor(c * 2 / size).cast("int")
    return F.format_string(f"s_{size:03d}um_%05d_%05d-1", at(row), at(col))


def native_spot(name: Column) -> tuple[Column, Column]:
    """Row and column of a native spot name; null for other text."""
    pattern = "^s_002um_([0-9]{5})_([0-9]{5})(?:-1)?$"
    part = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i).cast("int"))
    return part(1), part(2)


def by_native_name(counts: DataFrame, slide: DataFrame, barcode: str = "barcode") -> DataFrame:
    """``counts`` with the map's barcode where ``barcode`` is a native spot name; other barcodes stay, unknown spots leave."""
    row, col = native_spot(F.col(barcode))
    spots = slide.where("array_row is not null and array_col is not null").select(F.col("array_row").alias("_r"), F.col("array_col").alias("_c"), F.col("barcode").alias("_own"))
    named = counts.withColumns({"_row": row, "_col": col})
    joined = named.join(spots, (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")), "left")
    return joined.where("_row is null or _own is not null").withColumn(barcode, F.coalesce("_own", barcode)).drop("_row", "_col", "_r", "_c", "_own")


def unique_map(slide: DataFrame, barcode: str = "barcode") -> DataFrame:
    """The map itself, or an error if a barcode occurs twice."""
    if not slide.groupBy(barcode).count().where("count > 1").isEmpty():
        raise ValueError("duplicate barcode in a slide map")
    return slide


def assigned(reads: DataFrame, comment: str, slide: DataFrame, unit: str = "bin", size: int = 2, tissue_only: bool = False, reserved: tuple[str, ...] = ()) -> DataFrame:
    """``reads`` with ``cb, status, unit`` by a map of ``barcode, array_row, array_col, in_tissue, cell_id``.

    Status: ``missing_barcode``, ``invalid_tags`` (the barcode tag twice, or a tag in ``reserved``), ``unknown_barcode``, ``missing_coordinates``, ``outside_tissue``,
    ``missing_cell`` or ``assigned``.  Maps have one row a spot and are broadcast by Spark while they are small.
    """
    if unit not in ("bin", "cell") or unit == "cell" and size != 2:
        raise ValueError("unit is bin, or cell with a bin size of 2")
    m = slide.select(F.col("barcode").alias("_b"), F.col("array_row").alias("_row"), F.col("array_col").alias("_col"), F.col("in_tissue").alias("_in"), F.col("cell_id").alias("_cell"))
    joined = reads.withColumn("cb", tag(F.col(comment), "CB")).join(m, F.col("cb") == F.col("_b"), "left")
    twice = F.size(F.regexp_extract_all(F.col(comment), F.lit("(?:^|[ \\t])(CB:Z:)"), F.lit(1))) > 1
    if reserved:
        twice = twice | F.coalesce(F.col(comment).rlike(f"(?:^|[ \\t])(?:{'|'.join(reserved)}):"), F.lit(False))
    status = (
        F.when(F.col("cb").isNull() | (F.col("cb") == ""), "missing_barcode")
        .when(twice, "invalid_tags")
        .when(F.col("_b").isNull(), "unknown_barcode")
        .when(F.col("_row").isNull() | F.col("_col").isNull(), "missing_coordinates")
    )
    if tissue_only:
        status = status.when(F.coalesce("_in", F.lit(0)) != 1, "outside_tissue")
    if unit == "cell":
        status = status.when(F.col("_cell").isNull(), "missing_cell")
    place = spot_name(F.col("_row"), F.col("_col"), size) if unit == "bin" else F.col("_cell")
    out = joined.withColumn("status", status.otherwise("assigned"))
    return out.withColumn("unit", F.when(F.col("status") == "assigned", place)).drop("_b", "_row", "_col", "_in", "_cell")


def assigned_by_axes(barcodes: DataFrame, barcode: str, axis1: DataFrame, axis2: DataFrame, length1: int) -> DataFrame:
    """``array_row, array_col, status`` of barcodes made of two parts, joined by a hyphen or run together.

    The first part gives the column, the second the row; two small equality joins, no product of the axes.
    """
    b = F.col(barcode)
    parts = barcodes.withColumns(
        {
            "_1": F.when(b.contains("-"), F.substring_index(b, "-", 1)).otherwise(F.substring(b, 1, length1)),
            "_2": F.when(b.contains("-"), F.substring_index(b, "-", -1)).otherwise(F.expr(f"substring(`{barcode}`, {length1 + 1})")),
        }
    )
    x, y = axis1.select(F.col("barcode").alias("_1"), "array_col"), axis2.select(F.col("barcode").alias("_2"), "array_row")
    both = parts.join(x, "_1", "left").join(y, "_2", "left").drop("_1", "_2")
    return both.withColumn("status", F.when(F.col("array_col").isNotNull() & F.col("array_row").isNotNull(), "assigned").otherwise("unknown_barcode"))


def overlaid(slide: DataFrame, metadata: DataFrame) -> DataFrame:
    """Map with metadata by native spot (``array_row, array_col``): a matching row replaces all annotations, none is inherited."""
    notes = ["in_tissue", "cell_id"]
    meta = metadata.select("array_row", "array_col", F.struct(*notes).alias("_m"))
    both = slide.join(meta, ["array_row", "array_col"], "left")
    return both.withColumns({c: F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)) for c in notes}).drop("_m")


def occupied_regions(spots: DataFrame, row: str = "array_row", col: str = "array_col", side: int = 8, least: int = 32) -> DataFrame:
    """``region_row, region_col, occupied_2um_spots, selected`` of aligned regions of ``side`` by ``side`` spots; repeats don't count."""
    region = lambda c: F.floor(F.col(c) / side).cast("long")
    distinct = spots.where(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).alias("_r"), F.col(col).alias("_c")).distinct()
    regions = distinct.groupBy(region("_r").alias("region_row"), region("_c").alias("region_col")).agg(F.count(F.lit(1)).alias("occupied_2um_spots"))
    return regions.withColumn("selected", F.col("occupied_2um_spots") >= least)
