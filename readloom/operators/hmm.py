"""Units of concatenated reads by a hidden Markov model over anchors.

A unit is a forward or a reverse molecule with an opening and a closing anchor.
Anchors found in a read are the observations; the hidden state of each is an
edge of a unit or noise.  Transition probabilities are fitted by hard EM: every
round decodes all reads on the executors and adds up the transitions of the
best paths, a table of 36 numbers.  With too few reads that hold several
anchors nothing is fitted and every read is one ordinary unit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import BASES
from readloom.operators.align import infix_hits, infix_many
from readloom.operators.concat import UNRESOLVED, Edge, chance_hits, junction
from readloom.plans.scratch import written

#: Edges of units in the order they are met: forward and reverse, opening and closing; then noise.
STATES = ("FO", "FC", "RO", "RC", "X")
START, END = len(STATES), len(STATES) + 1
#: Chance that an exact copy of an anchor is met where another edge lies.
_EPS = 1e-4
#: Share of a letter's error in the chance of an anchor.
_ERROR = 0.5
#: Edits allowed where no chance hits are met to calibrate by, as a share of the anchor.
_UNCALIBRATED = 0.15
#: Share of chance hits that may pass as anchors, and reads that are looked at for it.
_CHANCE, _SAMPLE = 0.001, 10_000
_RC = str.maketrans(BASES, "TGCA")

Parameters = list[list[float]]


def initial() -> Parameters:
    """Probabilities before any fit: units are whole more often than not, and noise is rare."""
    opens, closes = {0: 1, 2: 3}, (1, 3)
    rows = []
    for s in (*range(len(STATES)), START):
        row = [0.0] * (END + 1)
        if s in opens:
            row[opens[s]], rest = 0.8, 0.2
        else:
            rest = 1.0
        row[0] += rest * 0.3
        row[2] += rest * 0.3
        for c in closes:
            row[c] += rest * 0.05
        row[4] += rest * 0.05
        row[END] += rest * 0.25
        rows.append(row)
    return rows


def _kinds(opening: str, closing: str) -> list[str]:
    """Anchors by state; on the reverse strand the closing anchor comes first."""
    return [opening, closing, closing.translate(_RC)[::-1], opening.translate(_RC)[::-1]]


def anchors(texts: list[str], opening: str, closing: str, most: tuple[int, int]) -> list[list[tuple[int, int, int, int]]]:
    """``start, end, kind, distance`` of anchors on both strands within so many edits (opening, closing), from left to right; kinds are states."""
    opened, closed = most
    each = [infix_hits(part, texts, d) for part, d in zip(_kinds(opening, closing), (opened, closed, closed, opened))]
    return [sorted((a, b, kind, d) for kind, hits in enumerate(of) for a, b, d in hits) for of in zip(*each)]


def accepted(rows: DataFrame, opening: str, closing: str) -> tuple[int, int]:
    """Edits up to which copies of the opening and the closing anchor are told from chance hits (A17), from a sample of texts ``t``."""

    def counted(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            d = [infix_many(part, texts)[0] for part in _kinds(opening, closing)]
            for i, best in enumerate((np.minimum(d[0], d[3]), np.minimum(d[1], d[2]))):
                at, n = np.unique(best, return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array([i] * len(at), pa.int32()), "d": pa.array(at, pa.int32()), "n": pa.array(n, pa.int64())})

    found = rows.select("t").where(F.length("t") >= max(len(opening), len(closing))).limit(_SAMPLE).mapInArrow(counted, "anchor int, d int, n long").groupBy("anchor", "d").agg(F.sum("n").alias("n")).collect()
    out = []
    for i, part in enumerate((opening, closing)):
        h = [0] * (len(part) + 1)
        for r in found:
            if r["anchor"] == i:
                h[r["d"]] += r["n"]
        least = int(_UNCALIBRATED * len(part))
        calibrated = chance_hits(h, _CHANCE).lower if h[0] else -1
        out.append(min(calibrated, 2 * least) if calibrated >= 0 else least)
    return out[0], out[1]


def decode(kinds: Sequence[int], p: Parameters, distances: Sequence[int] | None = None) -> list[int]:
    """Most probable states (Viterbi); every edit of an anchor makes it less certain against noise."""
    log = lambda x: math.log(x) if x > 0 else -1e9
    states = range(len(STATES))
    emit = lambda s, k, d: log(0.25 if s == 4 else (1 - 3 * _EPS if s == k else _EPS) * _ERROR**d)
    distances = distances or [0] * len(kinds)
    score = [log(p[START][s]) + emit(s, kinds[0], distances[0]) for s in states]
    back = []
    for k, d in zip(kinds[1:], distances[1:]):
        best = [max(states, key=lambda a, s=s: score[a] + log(p[a][s])) for s in states]
        score = [score[best[s]] + log(p[best[s]][s]) + emit(s, k, d) for s in states]
        back.append(best)
    at = max(states, key=lambda s: score[s] + log(p[s][END]))
    path = [at]
    for best in reversed(back):
        at = best[at]
        path.append(at)
    return path[::-1]


def transitions(path: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip([START, *path], [*path, END]))


def units(events: Sequence[tuple[int, int, int]], path: Sequence[int], length: int) -> list[tuple[str, int, int, bool]]:
    """``strand, start, end, resolved`` of the units of a decoded read; cuts follow the decision on junctions."""
    spans: list[list] = []  # strand, opening event, closing event
    for e, s in zip(events, path):
        if s == 4:
            continue
        strand, closes = "FR"[s // 2], s % 2
        if closes and spans and spans[-1][0] == strand and spans[-1][2] is None:
            spans[-1][2] = e
        elif closes:
            spans.append([strand, None, e])
        else:
            spans.append([strand, e, None])
    if not spans:
        return [("", 0, length, True)]
    out, start, resolved = [], 0, True
    for (strand, o, c), following in zip(spans, [*spans[1:], None]):
        if following is None:
            out.append((strand, start, length, resolved))
            break
        left = (c or o)[1]
        right = (following[1] or following[2])[0]
        j = junction(left, right, Edge(0, 0) if c else Edge(), Edge(0, 0) if following[1] else Edge())
        unsure = bool(j.flags & UNRESOLVED)
        out.append((strand, start, j.cut, resolved and not unsure))
        start, resolved = j.cut, not unsure
    return out


def fitted(events: DataFrame, rounds: int = 5, least_reads: int = 50) -> Parameters | None:
    """Parameters by hard EM over ``kinds`` and ``distances`` (arrays of anchors), or None where fewer than ``least_reads`` reads hold two or more."""
    several = events.where(F.size("kinds") > 1)
    if several.limit(least_reads).count() < least_reads:
        return None
    p = initial()
    for _ in range(rounds):

        def counted(batches, p=p):
            total: dict[tuple[int, int], int] = {}
            for b in batches:
                for kinds, distances in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for t in transitions(decode(kinds, p, distances)):
                        total[t] = total.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.int32()), pa.array([b for _, b in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["a", "b", "n"])

        n = {(r["a"], r["b"]): r["n"] for r in several.select("kinds", "distances").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
        new = []
        for a in (*range(len(STATES)), START):
            row = [n.get((a, b), 0) + (0.5 if b != START else 0.0) for b in range(END + 1)]
            new.append([x / sum(row) for x in row])
        if max(abs(x - y) for r, s in zip(p, new) for x, y in zip(r, s)) < 1e-6:
            break
        p = new
    return p


def segmented(reads: DataFrame, key: str, seq: str, opening: str, closing: str, abstain: str = "keep", rounds: int = 5, least_reads: int = 50) -> DataFrame:
    """``key, unit, strand, start_at, end_at, resolved`` of every read.

    Where two units meet without an anchor on either side their cut is unresolved; ``abstain="drop"`` leaves such
    units out.  Anchors may have as many edits as ``accepted`` tells from chance.  Without enough reads to fit, every read is one unit of the strand of its first anchor.

    Defined cases: null and empty reads give no row; a read without anchors is one unit without strand; repeated
    rows are cut each; an empty table gives no rows; other columns are ignored.
    """
    if abstain not in ("keep", "drop"):
        raise ValueError("abstain is keep or drop")
    opening, closing = opening.upper(), closing.upper()
    rows = reads.select(F.col(key).alias("key"), F.upper(seq).alias("t")).where("t <> ''")
    kind = dict(rows.dtypes)["key"]
    most = accepted(rows, opening, closing)

    def found(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            each = anchors(texts, opening, closing, most)
            lists = [pa.array([[e[i] for e in x] for x in each], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int32()), *lists], ["key", "n", "starts", "ends", "kinds", "distances"])

    events = written(rows.mapInArrow(found, f"key {kind}, n int, starts array<int>, ends array<int>, kinds array<int>, distances array<int>"), "anchors")
    p = fitted(events, rounds, least_reads)

    def cut(batches):
        for b in batches:
            index, out = [], []
            for i, (n, starts, ends, kinds, distances) in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 6)))):
                if p is None or not kinds:
                    of = [("" if not kinds else "FR"[kinds[0] // 2], 0, n, True)]
                else:
                    of = units(list(zip(starts, ends, kinds)), decode(kinds, p, distances), n)
                for k, u in enumerate(of, 1):
                    if u[3] or abstain == "keep":
                        index.append(i)
                        out.append((k, *u))
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["key", "unit", "strand", "start_at", "end_at", "resolved"])

    return events.mapInArrow(cut, f"key {kind}, unit long, strand string, start_at long, end_at long, resolved boolean")
