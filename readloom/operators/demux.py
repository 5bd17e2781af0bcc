"""Demultiplexing: reads and a layout become records with corrected barcodes.

One lazily evaluated plan: both strands are matched against one regular
expression of the layout, captures become columns, barcodes are corrected by
equality joins with the aliases of their whitelist, and headers are projected.
Reads are shuffled only where Spark does not broadcast the aliases.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import revcomp
from readloom.operators.align import infix_hits
from readloom.operators.concat import segments_both
from readloom.operators.scan import oriented_by
from readloom.operators.whitelist import aliases, corrected, corrected_by_generation, relocated
from readloom.plans.shape import bound
from readloom.sources.layouts import Element, read_pattern


def parsed(reads: DataFrame, layout: Sequence[Element], key: str = "read_key", seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """``key, strand`` and one column for each captured element of the reads that follow the layout exactly; ``_kept`` carries other columns."""
    pattern, names = read_pattern(list(layout))
    hit = oriented_by(reads.select(F.col(key).alias("read_key"), F.col(seq).alias("_s"), *_carried(keep)), "_s", pattern)
    return bound(hit, **{n: F.regexp_extract("oriented", pattern, i) for i, n in enumerate(names, 1)}).drop("_s", "oriented")


def _carried(keep: Sequence[str]) -> list[Column]:
    return [F.struct(*keep).alias("_kept")] if keep else []


def _filled(text: str, at: int, end: int | None, parts: Sequence[Element], into: dict[str, str]) -> int | None:
    """Place behind variable parts that begin at ``at``: of all their lengths those that come nearest to ``end``, the longest ones without it."""
    choices = [e.lengths for e in parts]
    sizes = max(itertools.product(*choices), key=lambda x: (-abs(at + sum(x) - end) if end is not None else 0, sum(x)))
    for e, n in zip(parts, sizes):
        into[e.id] = text[at : at + n]
        into["", e.id] = at
        if len(into[e.id]) < n:
            return None
        at += n
    return at


def _placed(text: str, layout: Sequence[Element], hits: dict[int, list[tuple[int, int, int]]], pad: int = 3) -> tuple[int, dict[str, str]] | None:
    """Edits of the static parts and the captured parts of a forward read; none if a static part before the read is missing."""
    first = min(hits)
    if not hits[first]:
        return None
    _, at, cost = min(hits[first], key=lambda h: (h[2], h[0]))
    out: dict[str, str] = {}
    open_parts: list[Element] = []
    free = None  # start of a read part whose end is not known yet
    for i, e in enumerate(layout[first + 1 :], first + 1):
        if e.seq:
            lo, hi = sum(x.lengths[0] for x in open_parts), sum(x.lengths[-1] for x in open_parts)
            near = [h for h in hits[i] if h[0] >= at + lo - pad and (free is not None or h[0] <= at + hi + pad)]
            if not near:
                return None
            start, end, d = min(near, key=lambda h: h[0] if free is not None else (h[2], h[0]))
            if free is not None:
                out[free], out["", free], free = text[at:start], at, None
            elif open_parts and _filled(text, at, start, open_parts, out) is None:
                return None
            at, cost, open_parts = end, cost + d, []
        elif e.cls in ("poly_t", "poly_a", "read"):
            if open_parts and (at := _filled(text, at, None, open_parts, out)) is None:
                return None
            open_parts = []
            letter = {"poly_t": "T", "poly_a": "A"}.get(e.cls)
            while letter and free is None and text[at : at + 1] == letter:
                at += 1
            if not letter:
                free, rest = e.id, layout[i + 1 :]
                if not any(x.kind == "variable" for x in rest):
                    ends = [h[0] for k, x in enumerate(rest, i + 1) if x.seq for h in hits[k] if h[0] >= at]
                    out[free] = text[at : min(ends)] if ends else text[at:]
                    out["", free] = at
                    poly = "".join({"poly_t": "T", "poly_a": "A"}.get(x.cls, "") for x in rest)
                    if ends and poly:
                        out[free] = out[free].rstrip(poly)
                    return cost, out
        else:
            open_parts.append(e)
    if free is not None:
        out[free] = text[at:]
        out["", free] = at
    elif open_parts and _filled(text, at, None, open_parts, out) is None:
        return None
    return cost, out


def parsed_fuzzy(reads: DataFrame, layout: Sequence[Element], max_error: float, key: str = "read_key", seq: str = "seq", keep: Sequence[str] = (), oriented: bool = False) -> DataFrame:
    """As ``parsed`` with static parts found within ``floor(max_error * length)`` edits; the strand with fewer edits wins, forward on a tie.

    Variable parts lie between the static parts that were found, with any of their lengths.  ``_read_at`` and ``_barcode_at`` are the 0-based
    places of the read part and the first barcode in forward orientation; ``_kept`` carries other columns, ``_oriented`` the read.
    """
    layout = list(layout)
    names = [e.id for e in layout if not e.seq and e.cls not in ("poly_t", "poly_a")]
    static = [(i, e.seq) for i, e in enumerate(layout) if e.seq]
    read, barcode = (next((e.id for e in layout if e.cls == c), None) for c in ("read", "barcode"))
    if not static:
        raise ValueError("a layout without static parts cannot be found")
    if missing := [e.id for e in layout if not e.seq and e.cls not in ("poly_t", "poly_a", "read") and not e.lengths]:
        raise ValueError(f"elements without length: {', '.join(missing)}")

    def run(f, r):
        sides = []
        for texts in (f.to_pylist(), r.to_pylist()):
            texts = [t or "" for t in texts]
            found = {i: infix_hits(part, texts, int(max_error * sum(c != "N" for c in part) + 1e-9), "N") for i, part in static}
            sides.append([_placed(t, layout, {i: found[i][k] for i, _ in static}) for k, t in enumerate(texts)])
        rows = []
        for a, b in zip(*sides):
            side, best = ("F", a) if a is not None and (b is None or a[0] <= b[0]) else ("R", b)
            rows.append(None if best is None else {"strand": side, "at": best[1].get(("", read)), "bc": best[1].get(("", barcode)), **{f"p{k}": best[1].get(n, "") for k, n in enumerate(names)}})
        return pa.array(rows, pa.struct([("strand", pa.string()), ("at", pa.int32()), ("bc", pa.int32()), *((f"p{k}", pa.string()) for k in range(len(names)))]))

    run.__annotations__ = {"f": pa.Array, "r": pa.Array, "return": pa.Array}
    parts = F.arrow_udf(run, f"struct<{', '.join(['strand: string', 'at: int', 'bc: int', *(f'p{k}: string' for k in range(len(names)))])}>")
    both = bound(reads.select(F.col(key).alias("read_key"), F.col(seq).alias("_s"), *_carried(keep)), _f=F.upper("_s"))
    hit = bound(both, _p=parts(F.col("_f"), revcomp(F.col("_f")))).where("_p is not null")
    if oriented:
        hit = hit.withColumn("_oriented", F.when(F.col("_p.strand") == "F", F.col("_f")).otherwise(revcomp(F.col("_f"))))
    return hit.select("read_key", F.col("_p.strand").alias("strand"), F.col("_p.at").alias("_read_at"), F.col("_p.bc").alias("_barcode_at"), *(["_oriented"] if oriented else []), *(["_kept"] if keep else []), *(F.col(f"_p.p{k}").alias(n) for k, n in enumerate(names)))


def without_gaps(text: Column) -> Column:
    """N blocks cut out."""
    return F.regexp_replace(text, "[Nn]+", "")


def cut_together(seq: Column, qual: Column) -> tuple[Column, Column]:
    """Sequence and quality without the places where the sequence has an N."""
    letters = lambda t: F.split(t, "")
    kept = F.filter(F.arrays_zip(letters(seq).alias("s"), letters(qual).alias("q")), lambda x: (x["s"] != "") & ~x["s"].isin("N", "n"))
    together = qual.isNotNull() & (F.length(qual) == F.length(seq)) & seq.rlike("[Nn]")
    return without_gaps(seq), F.when(together, F.array_join(F.transform(kept, lambda x: x["q"]), "")).otherwise(qual)


def demux(reads: DataFrame, layout: Sequence[Element], whitelists: dict[str, DataFrame], mutation: int = 0, min_read_length: int = 0, key: str = "read_key", seq: str = "seq", rc_umi: bool = True, max_error: float | None = None, keep: Sequence[str] = (), qual: str | None = None, pad: int = 0, generate: bool = False) -> DataFrame:
    """``read_key, strand``, and for each barcode element ``<id>_raw, <id>, <id>_kind``, then ``umi`` and ``cdna``.

    Rows whose barcodes are all exact or uniquely corrected are ``passing``; cDNA has its N blocks cut out and
    must have ``min_read_length`` bases.  It stays in the orientation in which the read was sequenced; the UMI is
    given in forward orientation, unless ``rc_umi`` is false.  With ``max_error`` static parts may have errors.  Columns
    named in ``keep`` go along; with ``qual`` the quality of the cDNA is cut in step as ``cdna_qual``, null where the
    quality is missing or of another length than the read.

    With ``pad`` a barcode that is neither known nor uniquely corrected is looked for, letter for letter, in a window of
    ``pad`` bases around its place; where it is found (kind ``located``) the UMI and the read behind it move along.  With ``generate``
    the observed barcodes are varied and looked up, instead of varying the whitelist, which may then be of any size.
    """
    if pad and (qual is not None or sum(e.cls == "barcode" for e in layout) != 1):
        raise ValueError("a window needs a layout with one barcode, and records without quality")
    if pad and max_error is None:
        max_error = 0.0
    keep = list(dict.fromkeys([*keep, *([qual] if qual else [])]))
    if qual is not None and max_error is None:
        max_error = 0.0  # places come from alignment
    rows = parsed(reads, layout, key, seq, keep) if max_error is None else parsed_fuzzy(reads, layout, max_error, key, seq, [*keep, seq] if qual else keep, oriented=pad > 0)
    barcodes = [e for e in layout if e.cls == "barcode"]
    for e in barcodes:
        rows = rows.withColumnRenamed(e.id, f"{e.id}_raw")
        if generate:
            rows = corrected_by_generation(rows, f"{e.id}_raw", whitelists[e.whitelist], mutation)
        else:
            rows = corrected(rows, f"{e.id}_raw", aliases(whitelists[e.whitelist], mutation, e.lengths or None))
        rows = rows.withColumnsRenamed({"true_bc": e.id, "kind": f"{e.id}_kind"})
    if pad:
        rows = _moved(rows, layout, barcodes[0], whitelists[barcodes[0].whitelist], pad)
    umi = next((e.id for e in layout if e.cls == "umi"), None)
    read = next((e.id for e in layout if e.cls == "read"), None)
    back = lambda c: F.when(F.col("strand") == "R", revcomp(c)).otherwise(c)
    cdna = back(without_gaps(F.col(read))) if read else F.lit("")
    extra = [F.col(f"_kept.{c}").alias(c) for c in keep if c != qual]
    if qual is not None:
        whole, n, size = F.col(f"_kept.{qual}"), F.length(f"_kept.{seq}"), F.length(read)
        # Qualities stay in the orientation of the sequencer, as the cDNA does.
        start = F.when(F.col("strand") == "F", F.col("_read_at")).otherwise(n - F.col("_read_at") - size)
        part = F.when(F.length(whole) == n, F.substring(whole, start + 1, size))
        both = cut_together(back(F.col(read)), part)
        cdna, extra = both[0], [*extra, both[1].alias("cdna_qual")]
    of_umi = F.lit(None).cast("string") if not umi else F.col(umi) if rc_umi else back(F.col(umi))
    passing = F.lit(True)
    for e in barcodes:
        passing = passing & F.col(e.id).isNotNull()
    columns = [c for e in barcodes for c in (f"{e.id}_raw", e.id, f"{e.id}_kind")]
    out = rows.select("read_key", "strand", *columns, of_umi.alias("umi"), cdna.alias("cdna"), *extra)
    return out.withColumn("passing", passing & (F.length("cdna") >= min_read_length))


def _moved(rows: DataFrame, layout: Sequence[Element], barcode: Element, whitelist: DataFrame, pad: int) -> DataFrame:
    """``rows`` with barcodes found beside their place; parts chained to the barcode begin behind it."""
    kind, size = f"{barcode.id}_kind", barcode.length
    open_ = rows.where(F.col(kind).isin("none", "ambiguous")).select("read_key", "_oriented", (F.col("_barcode_at") + 1).alias("_start"))
    found = relocated(open_, "read_key", "_oriented", "_start", size, whitelist, pad).select(F.col("key").alias("_k"), F.col("barcode").alias("_b"), F.col("end_at").alias("_e"))
    joined = rows.join(found, F.col("read_key") == F.col("_k"), "left")
    here = F.col("_b").isNotNull()
    new: dict[str, Column] = {barcode.id: F.coalesce("_b", barcode.id), f"{barcode.id}_raw": F.coalesce("_b", f"{barcode.id}_raw"), kind: F.when(here, "located").otherwise(F.col(kind))}
    at, poly = F.col("_e"), False  # 1-based place behind the barcode
    for e in layout[[x.id for x in layout].index(barcode.id) + 1 :]:
        if e.cls == "umi" and not poly:
            new[e.id] = F.when(here, F.substring(F.col("_oriented"), at, F.lit(e.length))).otherwise(F.col(e.id))
            at = at + e.length
        elif e.cls == "poly_t":
            poly = True
        elif e.cls == "read":
            part = F.substring(F.col("_oriented"), at, F.greatest(F.col("_read_at") + F.length(e.id) + 1 - at, F.lit(0)))
            new[e.id] = F.when(here, F.ltrim(part, F.lit("T")) if poly else part).otherwise(F.col(e.id))
            break
        else:
            break
    return joined.withColumns(new).drop("_k", "_b", "_e")


def demux_units(reads: DataFrame, layout: Sequence[Element], whitelists: dict[str, DataFrame], joins: Sequence[str], mutation: int = 0, min_read_length: int = 0, key: str = "read_key", seq: str = "seq", rc_umi: bool = True, max_error: float | None = None) -> DataFrame:
    """As ``demux`` for every unit of reads that are cut at the joins on both strands; adds ``unit`` and ``units``, the number on the read."""
    cut = segments_both(reads, key, seq, joins).select(F.struct("key", "segment", "units").alias("_u"), "part")
    out = demux(cut, layout, whitelists, mutation, min_read_length, "_u", "part", rc_umi, max_error)
    return out.select(F.col("read_key.key").alias("read_key"), F.col("read_key.segment").alias("unit"), F.col("read_key.units").alias("units"), *(c for c in out.columns if c != "read_key"))


def with_policy(records: DataFrame, barcodes: Sequence[str], policy: str = "offensive") -> DataFrame:
    """Passing records under a correction policy; our own rule.

    ``offensive`` lets every unique correction pass.  ``defensive`` also asks that each barcode of a record be trusted,
    as counters are: 2 exact copies, or corrections that are no more than four in five of its records.
    """
    if policy not in ("offensive", "defensive"):
        raise ValueError("a correction policy is offensive or defensive")
    if policy == "offensive":
        return records
    for b in barcodes:
        kind = F.col(f"{b}_kind")
        n = lambda c: F.count_if(c)
        known = records.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("_b")).agg(n(kind == "exact").alias("_e"), n(kind == "corrected").alias("_c"), F.count(F.lit(1)).alias("_n"))
        trusted = known.select("_b", ((F.col("_e") >= 2) | (F.col("_c") / F.col("_n") <= 0.8)).alias("_t"))
        records = records.join(trusted, F.col(b) == F.col("_b"), "left").withColumn("passing", F.col("passing") & F.coalesce("_t", F.lit(False))).drop("_b", "_t")
    return records


def strict(records: DataFrame, barcodes: Sequence[str]) -> DataFrame:
    """Joint barcodes under the strict rule, our own: every part was seen letter for letter, and none was corrected."""
    ok = F.lit(True)
    for b in barcodes:
        ok = ok & (F.col(f"{b}_kind") == "exact")
    return records.withColumn("passing", F.col("passing") & ok)


def fastq_records(records: DataFrame, barcodes: Sequence[str], seq_id: str = "seq_id") -> DataFrame:
    """``read_key, seq_id, seq_comment, seq, qual`` of passing records with a quality, for the FASTQ writers: the header's tags are the comment."""
    cb, raw = F.concat_ws("_", *barcodes), F.concat_ws("_", *(f"{b}_raw" for b in barcodes))
    head = header(F.col(seq_id), F.col("strand"), cb, raw, F.col("umi"))
    rows = records.where("passing and cdna_qual is not null")
    return rows.select("read_key", F.substring_index(head, " TS:A:", 1).alias("seq_id"), F.concat(F.lit("TS:A:"), F.substring_index(head, " TS:A:", -1)).alias("seq_comment"), F.col("cdna").alias("seq"), F.col("cdna_qual").alias("qual"))


def allowed(records: DataFrame, bc1: str, bc2: str, mask: DataFrame) -> DataFrame:
    """Records whose pair of barcodes is a cell of the mask (``bc1, bc2``); others are dropped."""
    pairs = mask.toDF("_m1", "_m2").distinct()
    return records.join(pairs, (records[bc1] == pairs["_m1"]) & (records[bc2] == pairs["_m2"]), "left_semi")


def header(seq_id: Column, strand: Column, cb: Column, raw: Column, umi: Column) -> Column:
    """``<id>-F`` or ``-R`` with tags for strand, barcode, raw barcode and UMI; missing tags are left out."""
    sign = F.when(strand == "F", "+").otherwise("-")
    return F.concat_ws(" ", F.concat(F.coalesce(seq_id, F.lit("")), F.lit("-"), strand), F.concat(F.lit("TS:A:"), sign), F.concat(F.lit("CB:Z:"), cb), F.concat(F.lit("CR:Z:"), raw), F.concat(F.lit("UB:Z:"), umi))


def run_stats(reads: DataFrame, records: DataFrame) -> DataFrame:
    """Total, parsed and passing reads, and the rate of passing reads in percent (0 if there are none)."""
    total = reads.select(F.count(F.lit(1))).scalar()
    one = records.agg(F.max(total).cast("long").alias("total_reads"), F.count(F.lit(1)).alias("parsed_reads"), F.coalesce(F.sum(F.col("passing").cast("long")), F.lit(0)).cast("long").alias("demultiplexed_reads"))
    return one.withColumn("rate_percent", F.when(F.col("total_reads") > 0, 100.0 * F.col("demultiplexed_reads") / F.col("total_reads")).otherwise(0.0))
