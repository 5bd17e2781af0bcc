"""Side tables from files: counts, whitelists, slide maps, axes and batches."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.spatial import native_spot, unique_map
from readloom.operators.whitelist import cleaned
from readloom.plans.publish import guard


def uri(path: str) -> str:
    """Address of a file: any that names its file system as it is, a plain path as a local file, which must be there."""
    if "://" in path:
        return path
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return f"file://{os.path.abspath(path)}"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(uri(path))


def count_table(spark: SparkSession, path: str) -> DataFrame:
    """``barcode, count`` of lines split by commas, tabs or blanks; lines without a number, as a header, are dropped."""
    parts = F.split(F.trim("value"), "[,\\s]+")
    rows = _lines(spark, path).select(F.upper(F.element_at(parts, 1)).alias("barcode"), F.expr("try_cast(try_element_at(split(trim(value), r'[,\\s]+'), 2) as bigint)").alias("count"))
    return rows.where("barcode <> '' and count is not null")


def whitelist_file(spark: SparkSession, path: str, packed_length: int | None = None) -> DataFrame:
    """Distinct ``barcode`` of a file; an error if it has none."""
    found = cleaned(_lines(spark, path).select(F.element_at(F.split("value", ","), 1).alias("barcode")), packed_length=packed_length)
    if found.isEmpty():
        raise ValueError(f"no valid barcodes in {path}")
    return found


#: Columns of a slide map and their types.
SLIDE_COLUMNS = {"array_row": "int", "array_col": "int", "in_tissue": "int", "cell_id": "string", "pxl_row_in_fullres": "double", "pxl_col_in_fullres": "double", "x": "double", "y": "double"}


def slide_map(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated map or axis with ``barcode`` and known columns; missing optional columns become null, a barcode may occur once."""
    raw = spark.read.csv(uri(path), sep="\t", header=True)
    if "barcode" not in raw.columns:
        raise ValueError(f"no column barcode in {path}")
    known = [F.expr(f"try_cast(`{c}` as {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in SLIDE_COLUMNS.items()]
    return unique_map(raw.select(F.upper("barcode").alias("barcode"), *known))


def spot_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated notes by native spot: ``array_row, array_col, in_tissue, cell_id``, or a spot name ``barcode`` instead of the coordinates."""
    raw = spark.read.csv(uri(path), sep="\t", header=True)
    if "barcode" in raw.columns and "array_row" not in raw.columns:
        row, col = native_spot(F.col("barcode"))
        raw = raw.withColumns({"array_row": row, "array_col": col})
    if not {"array_row", "array_col"} <= set(raw.columns):
        raise ValueError(f"no coordinates in {path}")
    known = [F.expr(f"try_cast(`{c}` as {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in SLIDE_COLUMNS.items() if c in ("array_row", "array_col", "in_tissue", "cell_id")]
    out = raw.select(*known).where("array_row is not null and array_col is not null")
    if not out.groupBy("array_row", "array_col").count().where("count > 1").isEmpty():
        raise ValueError("duplicate spot in the metadata")
    return out


def registered_map(spark: SparkSession, folder: str, platform: str, slide: str) -> DataFrame:
    """Map of a slide in a registry of ``<platform>/<slide>.tsv.gz``."""
    for part in (platform, slide):
        if not part or os.sep in part or part.startswith("."):
            raise ValueError(f"not a name: {part!r}")
    return slide_map(spark, os.path.join(folder, platform, f"{slide}.tsv.gz"))


@dataclass(frozen=True)
class Run:
    """One run of a batch."""

    input: str
    output_prefix: str


def batch(path: str, check_inputs: bool = True) -> list[Run]:
    """Runs of a two-column file with an optional header; all of them are checked before any is started."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = [[c.strip() for c in r] for r in csv.reader(f) if any(c.strip() for c in r)]
    if rows and rows[0][0].lower() in ("input", "fastq", "input_fastq", "fastq_path") and rows[0][-1].lower() in ("output", "prefix", "output_prefix"):
        rows = rows[1:]
    if not rows or any(len(r) != 2 or not all(r) for r in rows):
        raise ValueError("a batch has two filled columns and at least one run")
    base = os.path.dirname(os.path.abspath(path))
    runs = [Run(*(os.path.normpath(os.path.join(base, c)) for c in r)) for r in rows]
    if check_inputs and (missing := [r.input for r in runs if not os.path.isfile(r.input)]):
        raise FileNotFoundError(missing[0])
    guard([r.input for r in runs], [r.output_prefix for r in runs])
    return runs
