"""Reads made of several units: segmentation and the decision on where two units meet."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import BASES

LEFT_BOUNDED, RIGHT_BOUNDED, LEFT_INSERT, RIGHT_INSERT, UNRESOLVED = 1, 2, 4, 8, 16


class Edge(NamedTuple):
    """Bases between an anchor and the end of its unit: a range, or none where the read itself lies there."""

    lo: int | None = None
    hi: int | None = None

    @property
    def bounded(self) -> bool:
        return self.lo is not None


class Junction(NamedTuple):
    cut: int
    lo: int
    hi: int
    kind: str
    flags: int


def junction(left_end: int, right_start: int, left: Edge, right: Edge, slack: int = 2, overlap: int = 5) -> Junction:
    """Where to cut between an anchor that ends at ``left_end`` and the next that starts at ``right_start``.

    Both sides bounded: the middle between the two, unresolved if the anchors
    overlap by more than ``overlap`` bases.  One side bounded: its distance from
    its anchor, give or take ``slack``.  Neither: the middle of everything, unresolved.
    """
    middle = lambda a, b: (a + b) // 2
    if left.bounded and right.bounded:
        flags = LEFT_BOUNDED | RIGHT_BOUNDED
        kind = "both_adapters" if not (left.hi or right.hi) else "geometry"
        if left_end - right_start > overlap:
            flags |= UNRESOLVED
        cut = middle(left_end, right_start)
        if right_start < left_end:
            return Junction(cut, right_start, left_end, kind, flags)
        return Junction(cut, cut, cut, kind, flags)
    if left.bounded:
        nominal = left_end + left.hi
        return Junction(min(nominal, right_start), max(left_end, left_end + left.lo - slack), min(right_start, nominal + slack), "geometry", LEFT_BOUNDED | RIGHT_INSERT)
    if right.bounded:
        nominal = right_start - right.hi
        return Junction(max(nominal, left_end), max(left_end, nominal - slack), min(right_start, right_start - right.lo + slack), "geometry", LEFT_INSERT | RIGHT_BOUNDED)
    return Junction(middle(left_end, right_start), left_end, right_start, "midpoint", LEFT_INSERT | RIGHT_INSERT | UNRESOLVED)


def junction_table(events: DataFrame, left_kind: str = "left_kind", right_kind: str = "right_kind", left_end: str = "left_end", right_start: str = "right_start", fixed: int = 8, slack: int = 2) -> DataFrame:
    """The decision of ``junction`` as columns ``cut, lo, hi, kind``; kinds are ``bounded`` or ``insert``, bounded edges hold ``fixed`` bases."""
    lb, rb = F.col(left_kind) == "bounded", F.col(right_kind) == "bounded"
    le, rs = F.col(left_end), F.col(right_start)
    mid = F.floor((le + rs) / 2).cast("long")
    pick = lambda both, one, other, none: F.when(lb & rb, both).when(lb, one).when(rb, other).otherwise(none).cast("long")
    return events.withColumns(
        {
            "cut": pick(mid, F.least(le + fixed, rs), F.greatest(rs - fixed, le), mid),
            "lo": pick(mid, F.greatest(le, le + fixed - slack), F.greatest(le, rs - fixed - slack), le),
            "hi": pick(mid, F.least(rs, le + fixed + slack), F.least(rs, rs - fixed + slack), rs),
            "kind": F.when(lb | rb, "geometry").otherwise("midpoint"),
        }
    )


def segments(reads: DataFrame, key: str, seq: str, joins: Sequence[str]) -> DataFrame:
    """``key, segment, units, part``: a read cut at every exact copy of the join sequences, which are left out.

    Segments keep their order; empty ones are dropped and not counted.
    """
    pattern = "|".join(sorted({j.upper() for j in joins}, key=lambda j: (-len(j), j)))
    parts = F.filter(F.split(F.upper(seq), pattern), lambda p: p != "")
    each = reads.select(F.col(key).alias("key"), parts.alias("p"))
    return each.select("key", F.size("p").cast("long").alias("units"), F.posexplode("p").alias("_i", "part")).select("key", (F.col("_i") + 1).cast("long").alias("segment"), "units", "part")


_RC = str.maketrans(BASES, "TGCA")


def segments_both(reads: DataFrame, key: str, seq: str, joins: Sequence[str]) -> DataFrame:
    """As ``segments``, cut at exact copies of the joins on either strand.

    ``left_strand`` and ``right_strand`` tell the strand of the cuts beside a segment, null at the ends of the read.
    Where copies overlap the cut goes to the first one, the longest of those that start there.
    """
    own = {j.upper(): "F" for j in joins}
    both = {j.translate(_RC)[::-1]: "R" for j in own} | own
    pattern = "|".join(sorted(both, key=lambda j: (-len(j), j)))
    text = F.upper(seq)
    side = F.create_map(*(F.lit(x) for kv in both.items() for x in kv))
    cuts = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda j: side[j])
    # One cut fewer than parts: part i lies between cuts i - 1 and i.
    parts = F.transform(F.split(text, pattern, -1), lambda p, i: F.struct(p.alias("part"), F.get("c", i - 1).alias("left_strand"), F.get("c", i).alias("right_strand")))
    each = reads.select(F.col(key).alias("key"), cuts.alias("c"), F.col(seq)).select("key", F.filter(parts, lambda p: p["part"] != "").alias("p"))
    return each.select("key", F.size("p").cast("long").alias("units"), F.posexplode("p").alias("_i", "p")).select("key", (F.col("_i") + 1).cast("long").alias("segment"), "units", "p.part", "p.left_strand", "p.right_strand")


class ChanceHits(NamedTuple):
    n_all: int
    n_low: int
    n_chance: int
    split: int
    mode: int
    lower: int
    share_at_lower: float
    share_above_lower: float


def chance_hits(histogram: Sequence[int], accepted: float = 0.05) -> ChanceHits:
    """Splits a histogram of edit distances into true copies and chance hits.

    The true copies are the peak at the left; the valley behind it is ``split``, the greatest count to its right
    ``mode``.  ``lower`` is the greatest distance whose cumulative share of the chance hits is within ``accepted``.
    """
    h = list(histogram)
    total = sum(h)
    if not total:
        return ChanceHits(0, 0, 0, -1, -1, -1, 0.0, 0.0)
    peak = 0
    while peak + 1 < len(h) and h[peak + 1] > h[peak]:
        peak += 1
    split = peak
    while split + 1 < len(h) and h[split + 1] <= h[split]:
        split += 1
    if split == len(h) - 1:
        # No second peak: nothing is told from chance.
        return ChanceHits(total, total, 0, split, -1, -1, 0.0, 0.0)
    low, chance = sum(h[: split + 1]), sum(h[split + 1 :])
    mode = max(range(split + 1, len(h)), key=lambda d: (h[d], -d))
    lower, share, upto = split, 0.0, 0
    for d in range(split + 1, len(h)):
        upto += h[d]
        if upto / chance > accepted:
            return ChanceHits(total, low, chance, split, mode, lower, share, upto / chance)
        lower, share = d, upto / chance
    return ChanceHits(total, low, chance, split, mode, lower, share, share)


def strand_counter(strand: Column, units: Column) -> Column:
    """Counter that a record belongs to: forward or reverse, alone or on a read with several units."""
    side = F.when(strand == "F", "forw").otherwise("rev")
    return F.when(units > 1, F.concat(side, F.lit("_concat_count"))).otherwise(F.concat(side, F.lit("_count")))
