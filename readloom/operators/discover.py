"""Discovering which catalogs and parts occur in a sample of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import revcomp


def sampled(reads: DataFrame, key: str, seq: str, most_reads: int = 10_000, most_bases: int = 50_000_000) -> DataFrame:
    """The first reads in order of ``key``, all complete and within both limits.

    The limit on reads cuts the input to a bounded sample first (a top-k of keys), so the running sum of
    lengths is over a bounded number of rows.
    """
    first = reads.orderBy(key).limit(most_reads)
    running = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("_sum", F.sum(F.length(seq)).over(running)).where(F.col("_sum") <= most_bases).drop("_sum")


def ranked_catalogs(extracted: DataFrame, barcode: str, catalogs: DataFrame) -> DataFrame:
    """``catalog, catalog_size, extracted_reads, matched_reads, matched_distinct, status`` for ``catalogs(catalog, barcode)``.

    The catalog with most matched reads is ``matched``, several of them ``tie``; without any hit ``no_hits``; others ``other``.
    """
    known = catalogs.select("catalog", F.col("barcode").alias("_b")).distinct()
    counted = extracted.groupBy(F.col(barcode).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    hits = known.join(counted, "_b", "left").groupBy("catalog").agg(
        F.count(F.lit(1)).alias("catalog_size"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matched_reads"), F.count("n").alias("matched_distinct")
    )
    # One row a catalog from here on.
    everything = Window.partitionBy(F.lit(0))
    best = F.max("matched_reads").over(everything)
    winners = F.sum(F.when(F.col("matched_reads") == F.col("best"), 1).otherwise(0)).over(everything)
    status = F.when(F.col("matched_reads") == 0, "no_hits").when(F.col("matched_reads") < F.col("best"), "other").when(F.col("winners") > 1, "tie").otherwise("matched")
    ranked = hits.withColumn("best", best).withColumn("winners", winners).withColumn("status", status)
    return ranked.select("catalog", "catalog_size", F.coalesce(total, F.lit(0)).cast("long").alias("extracted_reads"), "matched_reads", "matched_distinct", "status")


def usable_parts(parts: DataFrame) -> DataFrame:
    """Distinct ``id, seq`` with at least 8 letters A, C, G, T; lower case is accepted."""
    return parts.select("id", F.upper("seq").alias("seq")).where("seq rlike '^[ACGT]{8,}$'").distinct()


def part_support(reads: DataFrame, seq: str, parts: Sequence[tuple[str, str]]) -> DataFrame:
    """``id, forward, reverse``: reads that hold each part on either strand; one pass, two counters a part."""
    read = reads.select(F.upper(seq).alias("_f")).withColumn("_r", revcomp(F.col("_f")))
    n = lambda c: F.sum(c.cast("long"))
    one = read.agg(*(n(F.col(s).contains(p)).alias(f"{s}{i}") for i, (_, p) in enumerate(parts) for s in ("_f", "_r")))
    rows = F.array(*(F.struct(F.lit(name).alias("id"), F.coalesce(f"_f{i}", F.lit(0)).cast("long").alias("forward"), F.coalesce(f"_r{i}", F.lit(0)).cast("long").alias("reverse")) for i, (name, _) in enumerate(parts)))
    return one.select(F.inline(rows))


def spacing(reads: DataFrame, key: str, seq: str, parts: Sequence[tuple[str, str]]) -> DataFrame:
    """``part, next_part, reads, least_gap, most_gap, fixed``: gaps between neighbouring parts of forward reads.

    A gap of one length is ``fixed`` (our rule for barcodes and UMIs), others are variable.
    """
    read = reads.select(F.col(key).alias("k"), F.upper(seq).alias("s"))
    hits = F.array(*(F.struct(F.locate(p, F.col("s")).alias("at"), F.lit(name).alias("part"), F.lit(len(p)).alias("size")) for name, p in parts))
    found = read.select("k", F.array_sort(F.filter(hits, lambda h: h["at"] > 0)).alias("h")).where(F.size("h") > 1)
    pairs = found.select(F.explode(F.arrays_zip(F.slice("h", 1, F.size("h") - 1).alias("a"), F.slice("h", 2, F.size("h") - 1).alias("b"))).alias("p"))
    gaps = pairs.select(F.col("p.a.part").alias("part"), F.col("p.b.part").alias("next_part"), (F.col("p.b.at") - F.col("p.a.at") - F.col("p.a.size")).alias("gap")).where("gap >= 0")
    return gaps.groupBy("part", "next_part").agg(F.count(F.lit(1)).alias("reads"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap")).withColumn("fixed", F.col("least_gap") == F.col("most_gap"))
