"""Rewriting record headers and forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import tag


def collapsed_tags(seq_id: Column, delimiter: str = "_") -> tuple[Column, Column]:
    """Barcode and UMI from the last two fields of a collapsed id; null where it has fewer than three."""
    parts = F.split(seq_id, f"\\Q{delimiter}\\E")
    return tuple(F.when(F.size(parts) >= 3, F.element_at(parts, i)) for i in (-2, -1))


def barcode_and_umi(seq_id: Column, comment: Column, collapsed_input: bool = False, delimiter: str = "_") -> tuple[Column, Column]:
    """Tags ``CB`` and ``UB``; with ``collapsed_input`` the fields of the id where a tag is missing."""
    cb, ub = (F.when(tag(comment, t) != "", tag(comment, t)) for t in ("CB", "UB"))
    if collapsed_input:
        own_cb, own_ub = collapsed_tags(seq_id, delimiter)
        cb, ub = F.coalesce(cb, own_cb), F.coalesce(ub, own_ub)
    return cb, ub


def collapsed_header(seq_id: Column, comment: Column, delimiter: str = "_") -> Column:
    """``id<d>CB<d>UB`` without the comment; missing tags are left out."""
    return F.concat_ws(delimiter, F.coalesce(seq_id, F.lit("")), *barcode_and_umi(seq_id, comment))


def presto_header(seq_id: Column, comment: Column) -> Column:
    """``id|BARCODE=..|UMI=..``: the barcode is ``BC``, else ``CB``; empty and missing tags are left out.

    Fails where a value holds a blank, a vertical bar, an equals sign or a comma.
    """
    value = lambda t: F.when(tag(comment, t) != "", tag(comment, t))
    bc, ub = F.coalesce(value("BC"), value("CB")), value("UB")
    text = F.concat_ws("|", F.coalesce(seq_id, F.lit("")), F.concat(F.lit("BARCODE="), bc), F.concat(F.lit("UMI="), ub))
    bad = F.coalesce(bc.rlike("[\\s|=,]"), F.lit(False)) | F.coalesce(ub.rlike("[\\s|=,]"), F.lit(False)) | F.coalesce(seq_id.rlike("[\\s|]"), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("a value holds a reserved character"))).otherwise(text)


def fasta(seq_id: Column, comment: Column, seq: Column) -> Column:
    """FASTA record: the comment, if any, behind a tab."""
    return F.concat(F.lit(">"), F.concat_ws("\t", F.coalesce(seq_id, F.lit("")), F.when(comment != "", comment)), F.lit("\n"), seq)


def fastq(seq_id: Column, comment: Column, seq: Column, qual: Column, plus: Column | None = None) -> Column:
    """FASTQ record of four lines."""
    head = F.concat_ws(" ", F.coalesce(seq_id, F.lit("")), F.when(comment != "", comment))
    return F.concat(F.lit("@"), head, F.lit("\n"), seq, F.lit("\n+"), F.coalesce(plus if plus is not None else F.lit(None), F.lit("")), F.lit("\n"), qual)


def coordinate_header(reads: DataFrame, seq_id: str, comment: str, axis1: DataFrame, axis2: DataFrame, size: int = 2) -> DataFrame:
    """``header``: ids of mapped pairs get ``_row_col`` and the tags ``BC`` and ``RG`` of their bin; others stay as they are."""
    from readloom.operators.spatial import assigned_by_axes, spot_name

    placed = assigned_by_axes(reads.withColumn("_cb", tag(F.col(comment), "CB")), "_cb", axis1, axis2, 1)
    at = lambda c: F.floor(F.col(c) * 2 / size).cast("int")
    rest = F.trim(F.regexp_replace(F.col(comment), "(?:^|[ \\t])(?:BC|RG):Z:[^ \\t]*", ""))
    mapped = F.concat_ws("\t", F.concat(F.col(seq_id), F.format_string("_%05d_%05d", at("array_row"), at("array_col"))), F.when(rest != "", rest), F.concat(F.lit("BC:Z:"), spot_name(F.col("array_row"), F.col("array_col"), size)), F.lit(f"RG:Z:s{size:03d}um"))
    kept = F.concat_ws(" ", F.coalesce(seq_id, F.lit("")), F.when(F.col(comment) != "", F.col(comment)))
    return placed.withColumn("header", F.when(F.col("status") == "assigned", mapped).otherwise(kept)).drop("_cb", "array_row", "array_col")


def stats(reads: DataFrame, comment: str) -> DataFrame:
    """Records read, with a barcode, without one, and different barcodes."""
    cb = F.when(tag(F.col(comment), "CB") != "", tag(F.col(comment), "CB"))
    rows = reads.select(cb.alias("cb"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("records_read"), n(F.col("cb").isNotNull()).alias("written"), n(F.col("cb").isNull()).alias("skipped_missing_cb"), F.countDistinct("cb").alias("split_barcodes"))


def full_stats(reads: DataFrame, comment: str, seq: str = "seq", header: bool = False, to_fasta: bool = False, split: bool = False, placed: Column | None = None) -> DataFrame:
    """All counters of a reformat: read, written, without a barcode, given a new header, converted, mapped, not mapped, empty, and barcodes.

    Without ``split`` every record is written; ``placed`` tells which records have coordinates.
    """
    cb = F.when(tag(F.col(comment), "CB") != "", tag(F.col(comment), "CB"))
    rows = reads.select(cb.alias("cb"), (F.length(seq) == 0).alias("empty"), (placed if placed is not None else F.lit(None).cast("boolean")).alias("placed"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    written = F.col("cb").isNotNull() if split else F.lit(True)
    none = F.lit(0).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("records_read"),
        n(written).alias("written"),
        (n(~written) if split else none).alias("skipped_missing_cb"),
        (n(written) if header else none).alias("reformatted"),
        (n(written) if to_fasta else none).alias("converted"),
        n(F.col("placed")).alias("coordinates_mapped"),
        n(~F.col("placed")).alias("coordinates_unmapped"),
        n(F.col("empty")).alias("empty_records"),
        (F.countDistinct("cb") if split else none).alias("split_barcodes"),
    )
