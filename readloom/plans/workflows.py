"""Whole workflows: options are checked, operators composed, results handed back as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.dna import revcomp
from readloom.operators import demux as dm
from readloom.operators import discover as dc
from readloom.operators import reformat as rf
from readloom.operators import scan as sc
from readloom.operators import spatial as sp
from readloom.operators import whitelist as wl
from readloom.plans import checks
from readloom.plans.shape import few
from readloom.sources.layouts import Element


@dataclass(frozen=True)
class Result:
    """Tables of a workflow by name, its configuration, and what was found out on the driver."""

    tables: Mapping[str, DataFrame]
    config: Mapping[str, Any]
    notes: Mapping[str, Any] = field(default_factory=dict)


def one_of(**options: Any) -> None:
    """At most one of the options may be set."""
    if len(named := [k for k, v in options.items() if v not in (None, False)]) > 1:
        raise ValueError(f"{' and '.join(named)} exclude each other")


def engine_info(spark: SparkSession) -> dict[str, str]:
    return {"spark": spark.version, "pyspark": pyspark.__version__, "master": spark.sparkContext.master, "time_zone": spark.conf.get("spark.sql.session.timeZone")}


def scan_whitelist(
    reads: DataFrame | None = None,
    adapter: str | None = None,
    barcode_length: int = 16,
    left_margin: int = 0,
    right_margin: int = 0,
    max_error: float = 0.3,
    whitelist: DataFrame | None = None,
    selection: str = "high_specificity",
    counts: DataFrame | None = None,
    capture_mode: str = "after_adapter",
    bc1: DataFrame | None = None,
    bc2: DataFrame | None = None,
    bc1_length: int | None = None,
    bc2_length: int | None = None,
    umi_length: int = 9,
    offset_min: int = 0,
    offset_max: int = 3,
    spatial: bool = False,
    platform: str | None = None,
    slide: DataFrame | None = None,
    spatial_selection: str = "abundance",
) -> Result:
    """Barcodes of reads (one barcode, a mask, or a pair) or of a count table, with the called ones marked.

    Modes: ``counts`` rescans a table; ``bc1`` and ``bc2`` make a split scan; a ``slide`` map keeps its barcodes and
    adds their places, for the platform ``visium-hd`` with occupied regions.  With a slide ``abundance`` calls barcodes by
    the profile for low counts before they are looked up; ``legacy`` calls as usual for ``visium`` and keeps every barcode of the
    map for ``visium-hd``, where the regions decide.
    """
    checks.choice(spatial_selection, "spatial_selection", ("abundance", "legacy"))
    checks.choice(selection, "selection", ("high_specificity", "above_floor"))
    checks.choice(capture_mode, "capture_mode", ("after_adapter", "masked"))
    checks.flag(spatial, "spatial")
    checks.whole(umi_length, "umi_length", 0)
    one_of(reads=None if reads is None else "reads", counts=None if counts is None else "counts")
    if reads is None and counts is None:
        raise ValueError("reads or counts are required")
    if (bc1 is None) != (bc2 is None):
        raise ValueError("both lists of a split scan are required")
    if bc1 is not None and whitelist is not None:
        raise ValueError("a split scan has its own lists")
    if counts is not None and (whitelist is not None or bc1 is not None):
        raise ValueError("a rescan takes counts alone")
    checks.number(max_error, "max_error", 0, 1)
    checks.whole(barcode_length, "barcode_length", 1)
    checks.whole(left_margin, "left_margin", 0)
    checks.whole(right_margin, "right_margin", 0)
    if capture_mode == "masked" and (left_margin or right_margin):
        raise ValueError("a mask takes no margins")
    if platform is not None:
        adapter = adapter or sc.SLIDE_ADAPTERS.get(platform)
    if adapter is None and counts is None:
        raise ValueError("an adapter is required")
    tables: dict[str, DataFrame] = {}
    if bc1 is not None:
        hits = sc.split_scan(reads, "read_key", "seq", adapter, bc1, bc2, bc1_length, bc2_length, umi_length, offset_min, offset_max)
        pairs = sc.counts(hits, "bc1", "bc2").select(F.concat_ws("_", "bc1", "bc2").alias("pair"), "bc1", "bc2", "count")
        tables |= {"valid_pairs": pairs, "spatial_mask": sc.pair_mask(pairs), "dense_mask": sc.dense_mask(pairs, bc1.toDF("barcode"), bc2.toDF("barcode"))}
        counted = pairs.select(F.col("pair").alias("barcode"), "count")
    elif counts is not None:
        if slide is not None and platform == "visium-hd":
            counts = sp.by_native_name(counts, slide)
        counted = counts.groupBy("barcode").agg(F.sum("count").alias("count"))
    else:
        if capture_mode == "masked" or any(c in (adapter or "") for c in "Nn"):
            literal = sum(c not in "Nn" for c in adapter)
            hits = sc.masked(reads, "seq", adapter) if int(max_error * literal) == 0 else sc.masked_fuzzy(reads, "seq", adapter, max_error)
        else:
            found = sc.located(reads, "seq", adapter) if int(max_error * len(adapter)) == 0 else sc.located_fuzzy(reads, "seq", adapter, max_error)
            hits = sc.captured(found, barcode_length, left_margin, right_margin)
        counted = sc.counts(hits, "barcode")
        if whitelist is not None:
            counted = counted.join(whitelist.toDF("barcode").distinct(), "barcode", "left_semi")
    low = spatial or (slide is not None and (spatial_selection == "abundance" or platform != "visium"))
    called = sc.called(counted, selection, low)
    if slide is not None and spatial_selection == "legacy" and platform == "visium-hd":
        called = called.withColumn("selected", F.lit(True))
    if slide is not None:
        called = called.join(slide, "barcode")
        tables["coordinates"] = called.where("selected")
        if platform == "visium-hd":
            tables["regions"] = sp.occupied_regions(called.where("selected"))
    tables |= {"counts": counted, "called": called, "thresholds": sc.thresholds(counted, low)}
    return Result(tables, {"adapter": adapter, "selection": selection, "spatial": low, "capture_mode": capture_mode, "max_error": max_error})


def scan_batch(spark: SparkSession, path: str, **options: Any) -> dict[str, Result]:
    """Scans of all runs of a batch file, by output prefix; the whole batch is checked before the first is planned, each is run when its tables are."""
    from readloom.sources.fastq import read_fastq
    from readloom.sources.tables import batch

    return {run.output_prefix: scan_whitelist(read_fastq(spark, run.input), **options) for run in batch(path)}


def auto_whitelist(reads: DataFrame, layout: Sequence[Element], selection: str = "high_specificity", max_error: float = 0.3) -> DataFrame:
    """Barcodes found in the reads themselves: behind the static part before the layout's one barcode.

    Its length is the last candidate, 16 if there is none.  Finding none is an error.
    """
    places = [i for i, e in enumerate(layout) if e.cls == "barcode"]
    if len(places) != 1:
        raise ValueError("an automatic whitelist needs exactly one barcode")
    anchor = next((e.seq for e in reversed(layout[: places[0]]) if e.seq), None)
    if anchor is None:
        raise ValueError("no static part before the barcode")
    called = scan_whitelist(reads, anchor, layout[places[0]].length or 16, max_error=max_error, selection=selection).tables["called"]
    found = called.where("selected").select("barcode")
    if found.isEmpty():
        raise ValueError("no barcode was found")
    return found


def demultiplex(
    reads: DataFrame,
    layout: Sequence[Element],
    whitelists: Mapping[str, DataFrame] | None = None,
    custom_whitelist: DataFrame | None = None,
    auto: bool = False,
    whitelist_mutation: int = 0,
    min_read_length: int = 0,
    joint_mask: DataFrame | None = None,
    max_reads: int | None = None,
    max_error: float | None = None,
    joins: Sequence[str] = (),
    correction_policy: str = "offensive",
    joint_policy: str = "default",
    pad: int = 0,
    generate: bool = False,
    debug: bool = False,
) -> Result:
    """Records with corrected barcodes and headers, counters by barcode, roles and run statistics.

    With ``max_error`` static parts may have so many errors a letter; without it they are matched exactly.
    With ``joins`` reads are cut there and every unit gives a record; counters tell units of reads that have several.
    ``pad`` looks for barcodes beside their place, ``generate`` suits whitelists too large to be varied, and ``debug`` adds a
    table with what was found out on each read.  ``correction_policy`` is ``offensive`` or ``defensive``, ``joint_policy`` ``default`` or ``strict``.  Where reads have
    qualities and no ``joins``, ``fastq`` has the records with their qualities, for the FASTQ writers.
    """
    one_of(auto=auto, custom_whitelist=None if custom_whitelist is None else True)
    checks.whole(whitelist_mutation, "whitelist_mutation", 0, 2)
    checks.whole(min_read_length, "min_read_length", 0)
    checks.whole(pad, "pad", 0)
    if max_error is not None:
        checks.number(max_error, "max_error", 0, 1)
    if max_reads is not None:
        checks.whole(max_reads, "max_reads", 0)
    checks.choice(correction_policy, "correction_policy", ("offensive", "defensive"))
    checks.choice(joint_policy, "joint_policy", ("default", "strict"))
    if max_reads is not None:
        reads = reads.where(F.col("read_key") <= max_reads)
    lists = dict(whitelists or {})
    if auto or custom_whitelist is not None:
        own = auto_whitelist(reads, layout) if auto else custom_whitelist.toDF("barcode")
        lists = {e.whitelist: own for e in layout if e.cls == "barcode"}
    if missing := [e.whitelist for e in layout if e.cls == "barcode" and e.whitelist not in lists]:
        raise ValueError(f"whitelists missing: {', '.join(missing)}")
    if joins:
        records = dm.demux_units(reads, layout, lists, joins, whitelist_mutation, min_read_length, max_error=max_error)
    else:
        keep = [c for c in ("seq_id",) if c in reads.columns]
        qual = "qual" if "qual" in reads.columns and any(e.cls == "read" for e in layout) else None
        records = dm.demux(reads, layout, lists, whitelist_mutation, min_read_length, max_error=max_error, keep=keep, pad=pad, generate=generate)
    barcodes = [e.id for e in layout if e.cls == "barcode"]
    if joint_mask is not None:
        if len(barcodes) != 2:
            raise ValueError("a mask needs two barcodes")
        records = dm.allowed(records, *barcodes, joint_mask)
    records = dm.with_policy(records, barcodes, correction_policy)
    if joint_policy == "strict":
        records = dm.strict(records, barcodes)
    if not joins and not pad and qual and barcodes:
        cut = dm.demux(reads, layout, lists, whitelist_mutation, min_read_length, max_error=max_error, keep=keep, qual=qual, generate=generate)
        cut = dm.allowed(cut, *barcodes, joint_mask) if joint_mask is not None else cut
        cut = dm.with_policy(cut, barcodes, correction_policy)
        fastq_of = dm.fastq_records(dm.strict(cut, barcodes) if joint_policy == "strict" else cut, barcodes)
    else:
        fastq_of = None
    tables = {"records": records, "stats": dm.run_stats(reads, records)}
    if barcodes:
        cb, raw = F.concat_ws("_", *barcodes), F.concat_ws("_", *(f"{b}_raw" for b in barcodes))
        named = records.where("passing")
        if "seq_id" not in named.columns:
            named = named.join(reads.select("read_key", "seq_id"), "read_key") if "seq_id" in reads.columns else named.withColumn("seq_id", F.lit(None).cast("string"))
        tables["headers"] = named.select("read_key", dm.header(F.col("seq_id"), F.col("strand"), cb, raw, F.col("umi")).alias("header"), "cdna")
        flat = records.where(F.col(barcodes[0]).isNotNull()).select(F.lit(1).alias("class_id"), F.col(barcodes[0]).alias("true_bc"), F.col(f"{barcodes[0]}_kind").alias("kind"), "strand", (F.col("units") if joins else F.lit(1)).alias("units"), F.col("passing").alias("kept"))
        tables["counters"] = wl.trusted(wl.counters(flat))
    if debug and barcodes:
        first = barcodes[0]
        tables["debug"] = records.select("read_key", "strand", *(F.col(c).alias(n) for c, n in ((f"{first}_raw", "observed"), (first, "barcode"), (f"{first}_kind", "kind"))), "umi", F.length("cdna").alias("cdna_length"), "passing")
    if fastq_of is not None:
        tables["fastq"] = fastq_of
    return Result(tables, {"correction_policy": correction_policy, "joint_policy": joint_policy, "whitelist_mutation": whitelist_mutation, "min_read_length": min_read_length, "auto": auto})


def discovered(reads: DataFrame, parts: Sequence[tuple[str, str]], catalogs: DataFrame | None = None, adapter: str | None = None, barcode_length: int = 16, sample_reads: int = 10_000, sample_bases: int = 50_000_000) -> Result:
    """Which parts a sample holds and how far apart, which catalog its barcodes come from, and the layout if it is settled.

    Our rule for the layout: two parts in a row with one fixed gap of 28 are a barcode of 16 and a UMI of 12 between them, of 26
    one of 16 and 10; a gap of several lengths is the read.  Anything else leaves it partial.
    """
    sample = dc.sampled(reads, "read_key", "seq", sample_reads, sample_bases)
    tables = {"parts": dc.part_support(sample, "seq", parts)}
    if catalogs is not None:
        if adapter is None:
            raise ValueError("catalogs need an adapter")
        hits = sc.captured(sc.located(sample, "seq", adapter), barcode_length)
        tables["whitelists"] = dc.ranked_catalogs(hits, "barcode", catalogs)
    forward = sample.withColumn("seq", F.upper("seq"))
    if adapter:
        forward = forward.withColumn("seq", F.when(F.col("seq").contains(adapter), F.col("seq")).otherwise(revcomp(F.col("seq"))))
    tables["spacing"] = dc.spacing(forward, "read_key", "seq", parts)
    layout, complete = infer_layout(few(tables["spacing"].orderBy(F.desc("reads")), 1000), dict(parts))
    return Result(tables, {"sample_reads": sample_reads, "sample_bases": sample_bases}, {"layout": layout, "layout_complete": complete})


def infer_layout(gaps: Sequence, parts: Mapping[str, str]) -> tuple[list[Element], bool]:
    """Elements from the most frequent gap behind each part, and whether all of them are settled."""
    follows: dict[str, Any] = {}
    for g in gaps:
        if g["part"] not in follows:
            follows[g["part"]] = g
    targets = {g["next_part"] for g in follows.values()}
    start = [p for p in follows if p not in targets]
    if len(start) != 1:
        return [], False
    at, layout, complete, seen = start[0], [Element(start[0], "static", "", parts[start[0]])], True, {start[0]}
    read = False
    while at in follows and follows[at]["next_part"] not in seen:
        g = follows[at]
        if not g["fixed"]:
            layout.append(Element("read", "variable", "read"))
            complete, read = complete and not read, True
        elif g["least_gap"] in (26, 28):
            layout += [Element("barcode", "variable", "barcode", lengths=(16,)), Element("umi", "variable", "umi", lengths=(g["least_gap"] - 16,))]
        elif g["least_gap"]:
            complete = False
        at = g["next_part"]
        seen.add(at)
        layout.append(Element(at, "static", "", parts[at]))
    return layout, complete and read and any(e.cls == "barcode" for e in layout)


def reformatted(reads: DataFrame, header: str | None = None, collapsed_input: bool = False, delimiter: str = "_", to_fasta: bool = False, coordinate_axes: tuple[DataFrame, DataFrame] | None = None, bin_size: int = 2) -> Result:
    """Records with rewritten headers (``collapsed`` or ``presto``), coordinates, or as FASTA, and statistics."""
    if header not in (None, "collapsed", "presto"):
        raise ValueError("unknown header format")
    if header is None and not to_fasta and coordinate_axes is None:
        raise ValueError("nothing to do")
    if header == "presto" and collapsed_input:
        raise ValueError("presto headers and collapsed input exclude each other")
    if header is not None and coordinate_axes is not None:
        raise ValueError("coordinates and header formats exclude each other")
    i, c = F.col("seq_id"), F.col("seq_comment")
    if coordinate_axes is not None:
        named = rf.coordinate_header(reads, "seq_id", "seq_comment", *coordinate_axes, bin_size).withColumn("_c", F.lit(None).cast("string"))
    else:
        head = rf.collapsed_header(i, c, delimiter) if header == "collapsed" else rf.presto_header(i, c) if header == "presto" else i
        named = reads.withColumn("header", head).withColumn("_c", F.lit(None).cast("string") if header else c)
    h = F.col("header")
    plus = F.col("plus") if "plus" in reads.columns else None
    qual = F.coalesce(F.col("qual"), F.raise_error(F.lit("a record without quality cannot be FASTQ")).cast("string"))
    record = rf.fasta(h, F.col("_c"), F.col("seq")) if to_fasta else rf.fastq(h, F.col("_c"), F.col("seq"), qual, plus)
    return Result({"records": named.select("read_key", "header", record.alias("record")), "stats": rf.stats(reads, "seq_comment")}, {"header": header, "to_fasta": to_fasta})


def spatial_reformatted(reads: DataFrame, sample: str, slide: DataFrame | None = None, axes: tuple[DataFrame, DataFrame] | None = None, length1: int | None = None, metadata: DataFrame | None = None, unit: str = "bin", bin_size: int = 2, tissue_only: bool = False, strict: bool = False) -> Result:
    """Records whose barcode tag is their place: ``CB`` the unit, ``XB`` the barcode before, ``XS`` the sample, ``XP`` the native spot.

    Unassigned records are kept as they are, or left out if ``strict``; the audit has a row for every read.
    """
    if (slide is None) == (axes is None):
        raise ValueError("either a map or two axes are required")
    if unit not in ("bin", "cell") or bin_size < 2 or bin_size % 2 or unit == "cell" and bin_size != 2:
        raise ValueError("unit is bin with an even bin size, or cell with a bin size of 2")
    checks.name_of_sample(sample)
    if axes is not None:
        cb = reads.select("read_key", rf.tag(F.col("seq_comment"), "CB").alias("barcode")).where("barcode is not null")
        slide = sp.assigned_by_axes(cb.select("barcode").distinct(), "barcode", *axes, length1 or 0).where("status = 'assigned'").select("barcode", "array_row", "array_col", F.lit(1).alias("in_tissue"), F.lit(None).cast("string").alias("cell_id"))
    if metadata is not None:
        slide = sp.overlaid(slide, metadata)
    placed = sp.assigned(reads, "seq_comment", slide, unit, bin_size, tissue_only, ("XB", "XS", "XP"))
    native = slide.select(F.col("barcode").alias("_b"), sp.spot_name(F.col("array_row"), F.col("array_col"), 2).alias("_spot"))
    placed = placed.join(native, F.col("cb") == F.col("_b"), "left")
    rest = F.trim(F.regexp_replace("seq_comment", "(?:^|[ \\t])(?:CB|XB|XS|XP):Z:[^ \\t]*", ""))
    text = lambda t, v: F.concat(F.lit(f"{t}:Z:"), v)
    moved = F.concat_ws(" ", text("CB", F.col("unit")), F.when(rest != "", rest), text("XB", F.col("cb")), text("XS", F.lit(sample)), text("XP", F.col("_spot")))
    out = placed.withColumn("seq_comment", F.when(F.col("status") == "assigned", moved).otherwise(F.col("seq_comment")))
    records = out.where("status = 'assigned'") if strict else out
    audit = placed.select("read_key", "cb", "status", "unit")
    return Result({"records": records.drop("_b", "_spot"), "assignments": audit, "summary": audit.groupBy("status").agg(F.count(F.lit(1)).alias("n"))}, {"sample": sample, "unit": unit, "bin_size": bin_size, "strict": strict})
