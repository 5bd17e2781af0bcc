"""Scanning reads for barcodes: location, capture, counting and calling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import mask_pattern, revcomp
from readloom.operators.align import infix_distance, mask_captures
from readloom.plans.shape import bound, few

#: Adapters used where a slide platform names none.
SLIDE_ADAPTERS = {
    "curio-seeker": "NNNNNNNNTCTTCAGCGTTCCCGAGANNNNNN",
    "visium": "CTACACGACGCTCTTCCGATCT",
    "visium-hd": "CTACACGACGCTCTTCCGATCT",
}


def located(reads: DataFrame, seq: str, adapter: str) -> DataFrame:
    """``strand``, ``oriented`` (the read so that the adapter runs forward) and ``after`` (1-based place after it).

    The forward strand comes first; reads without an exact copy on either strand leave.
    """
    # The reverse strand is only made for reads without a forward copy; on it the adapter is searched as it is.
    up = bound(reads, _f=F.upper(seq)).withColumn("_pf", F.locate(adapter, F.col("_f")))
    one = bound(up, oriented=F.when(F.col("_pf") > 0, F.col("_f")).otherwise(revcomp(F.col("_f"))))
    at = bound(one, _at=F.locate(adapter, F.col("oriented"))).where("_at > 0")
    return at.withColumns({"strand": F.when(F.col("_pf") > 0, "F").otherwise("R"), "after": F.col("_at") + len(adapter)}).drop("_f", "_pf", "_at")


def located_fuzzy(reads: DataFrame, seq: str, adapter: str, max_error: float = 0.3) -> DataFrame:
    """As ``located`` for copies within ``floor(max_error * length)`` edits; the better strand wins, forward on a tie.

    An ``N`` of the adapter matches every canonical base and gives no room for edits.
    """
    wild = "N" if "N" in adapter else ""
    most = int(max_error * sum(c not in wild for c in adapter) + 1e-9)
    both = bound(reads, _f=F.upper(seq))
    both = bound(both, _r=revcomp(F.col("_f")))
    both = both.withColumns({"_df": infix_distance(adapter, F.col("_f"), wild), "_dr": infix_distance(adapter, F.col("_r"), wild)})
    forward = F.col("_df.distance") <= F.col("_dr.distance")
    hit = F.when(forward, F.col("_df")).otherwise(F.col("_dr"))
    found = both.withColumns({"_h": hit, "strand": F.when(forward, "F").otherwise("R"), "oriented": F.when(forward, F.col("_f")).otherwise(F.col("_r"))})
    found = found.where((F.col("_h.distance") <= most) & (F.col("_h.end") >= 0))
    return found.withColumns({"after": F.col("_h.end") + 2, "distance": F.col("_h.distance")}).drop("_f", "_r", "_df", "_dr", "_h")


def oriented_by(reads: DataFrame, seq: str, pattern: str) -> DataFrame:
    """``strand`` and ``oriented`` of reads that hold a regular expression, forward strand first."""
    up = bound(reads, _f=F.upper(seq))
    sided = bound(up, strand=F.when(F.col("_f").rlike(pattern), "F").otherwise("R"))
    text = bound(sided, oriented=F.when(F.col("strand") == "F", F.col("_f")).otherwise(revcomp(F.col("_f"))))
    return text.where((F.col("strand") == "F") | F.col("oriented").rlike(pattern)).drop("_f")


def captured(found: DataFrame, length: int, left: int = 0, right: int = 0, out: str = "barcode") -> DataFrame:
    """Barcode behind the adapter: ``length + right`` bases from ``left`` on; a cut-off window gives none."""
    size = length + right
    return found.withColumn(out, F.substring(F.col("oriented"), F.col("after") + left, F.lit(size))).where(F.length(out) == size)


def masked(reads: DataFrame, seq: str, mask: str, out: str = "barcode") -> DataFrame:
    """Concatenated captures of a mask, forward strand first; only A, C, G and T are captured."""
    pattern, blocks = mask_pattern(mask)
    hit = oriented_by(reads, seq, pattern)
    return hit.withColumn(out, F.concat(*(F.regexp_extract("oriented", pattern, i) for i in range(1, len(blocks) + 1)))).drop("oriented")


def masked_fuzzy(reads: DataFrame, seq: str, mask: str, max_error: float = 0.3, out: str = "barcode") -> DataFrame:
    """As ``masked`` within ``max_error`` edits of the literal letters; the better strand wins, forward on a tie.

    A gap inside or beside a captured block rejects the read on that strand.
    """
    mask_pattern(mask)
    both = bound(reads, _f=F.upper(seq))
    both = bound(both, _r=revcomp(F.col("_f")))
    both = both.withColumns({"_cf": mask_captures(mask, F.col("_f"), max_error), "_cr": mask_captures(mask, F.col("_r"), max_error)})
    df, dr = F.col("_cf.distance"), F.col("_cr.distance")
    sided = both.withColumn("strand", F.when(df.isNotNull() & (dr.isNull() | (df <= dr)), "F").when(dr.isNotNull(), "R")).where("strand is not null")
    return sided.withColumn(out, F.when(F.col("strand") == "F", F.col("_cf.barcode")).otherwise(F.col("_cr.barcode"))).drop("_f", "_r", "_cf", "_cr")


def split_scan(reads: DataFrame, key: str, seq: str, adapter: str, bc1: DataFrame, bc2: DataFrame, bc1_length: int, bc2_length: int, umi_length: int = 9, offset_min: int = 0, offset_max: int = 3, gap: int = 0) -> DataFrame:
    """``key, strand, umi, bc1, bc2, offset``: both barcodes from their catalogs, at the first offset that fits.

    ``bc1`` and ``bc2`` have one column each.  Offsets explode a read into a few candidates, both catalogs are
    equi-joined (Spark broadcasts them while they are small), and one pre-aggregated group keeps the first.
    """
    if offset_min > offset_max:
        raise ValueError("offset_min is greater than offset_max")
    found = located(reads, seq, adapter).select(F.col(key).alias("key"), "strand", "oriented", "after")
    each = found.withColumn("offset", F.explode(F.sequence(F.lit(offset_min), F.lit(offset_max))))
    start = F.col("after") + umi_length + F.col("offset")
    each = each.withColumns({"bc1": F.substring(F.col("oriented"), start, F.lit(bc1_length)), "bc2": F.substring(F.col("oriented"), start + bc1_length + gap, F.lit(bc2_length)), "umi": F.substring(F.col("oriented"), F.col("after"), F.lit(umi_length))})
    each = each.where((F.length("bc1") == bc1_length) & (F.length("bc2") == bc2_length)).drop("oriented", "after")
    known = each.join(bc1.toDF("bc1").distinct(), "bc1", "left_semi").join(bc2.toDF("bc2").distinct(), "bc2", "left_semi")
    first = known.groupBy("key").agg(F.min(F.struct("offset", "strand", "umi", "bc1", "bc2")).alias("_m"))
    return first.select("key", "_m.strand", "_m.umi", "_m.bc1", "_m.bc2", "_m.offset")


def counts(barcodes: DataFrame, *columns: str) -> DataFrame:
    """Reads by barcode or pair; counted in part before the shuffle."""
    return barcodes.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def thresholds(counted: DataFrame, spatial: bool = False) -> DataFrame:
    """``floor, threshold``: our own rule, stated in the README.

    ``floor`` is 1 for spatial data, else a ten-thousandth of the greatest count and at least 1; ``threshold``
    is a tenth of the 99th percentile of the counts and at least ``floor``.
    """
    floor = F.lit(1) if spatial else F.greatest(F.lit(1), F.ceil(F.max("count") / 10000.0))
    top = F.expr("percentile_disc(0.99) within group (order by count)")
    return counted.agg(floor.cast("long").alias("floor"), F.greatest(floor, F.ceil(top / 10.0)).cast("long").alias("threshold"))


def called(counted: DataFrame, selection: str = "high_specificity", spatial: bool = False) -> DataFrame:
    """``counted`` with ``selected``: counts from the floor (``above_floor``) or the threshold (``high_specificity``) on."""
    if selection not in ("above_floor", "high_specificity"):
        raise ValueError("unknown selection")
    limit = thresholds(counted, spatial).select("floor" if selection == "above_floor" else "threshold").scalar()
    return counted.withColumn("selected", F.col("count") >= limit)


def scan_stats(reads: DataFrame, counted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row on a scan: reads, extractions, distinct barcodes, floor, threshold and matches with a whitelist."""
    processed = reads.select(F.count(F.lit(1))).scalar()
    limit = thresholds(counted)
    floor, threshold = limit.select("floor").scalar(), limit.select("threshold").scalar()
    match = F.lit(False)
    if known is not None:
        counted = counted.join(known.toDF("barcode").distinct().withColumn("_known", F.lit(True)), "barcode", "left")
        match = F.coalesce("_known", F.lit(False))
    total = lambda c, v=F.col("count"): F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    yes, one = F.lit(True), F.lit(1)
    return counted.agg(
        F.max(processed).cast("long").alias("reads_processed"),
        total(yes).alias("total_extractions"),
        total(yes, one).alias("unique_sequences"),
        total(match).alias("total_perfect_matches"),
        total(match, one).alias("unique_perfect_matches"),
        F.max(floor).alias("floor"),
        F.max(threshold).alias("threshold"),
        total(F.col("count") >= floor, one).alias("above_floor"),
        total(F.col("count") >= threshold, one).alias("high_specificity"),
    ).withColumn("match_rate_percent", F.when(F.col("total_extractions") > 0, 100.0 * F.col("total_perfect_matches") / F.col("total_extractions")).otherwise(0.0))


def pair_mask(pairs: DataFrame) -> DataFrame:
    """Observed pairs as rows of the first barcode with the sorted list of its partners (a sparse mask)."""
    return pairs.groupBy("bc1").agg(F.array_sort(F.collect_set("bc2")).alias("partners"))


def dense_mask(pairs: DataFrame, axis1: DataFrame, axis2: DataFrame, most: int = 100_000) -> DataFrame:
    """``bc1, cells``: a row for every barcode of the first axis, a 0 or 1 for every one of the second, in their order.

    The second axis is a list of a checked size; the first may be of any.
    """
    order = [r["barcode"] for r in few(axis2.select("barcode").distinct().orderBy("barcode"), most)]
    met = pairs.groupBy("bc1").agg(F.collect_set("bc2").alias("_met"))
    known = F.array(*map(F.lit, order)).cast("array<string>")
    cells = F.array_join(F.transform(known, lambda b: F.when(F.array_contains("_met", b), "1").otherwise("0")), "")
    rows = axis1.select(F.col("barcode").alias("bc1")).distinct().join(met, "bc1", "left").withColumn("_met", F.coalesce("_met", F.array().cast("array<string>")))
    return rows.select("bc1", cells.alias("cells"))
