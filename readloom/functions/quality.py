"""Functions on Phred qualities, kept as text with an offset of 33.

Null quality is missing and differs from empty; both have null summaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 33
SUMMARY = "struct<mean_q: double, min_q: int, frac_q20: double>"


def _summaries(t: pa.Array) -> pa.Array:
    t = t.cast(pa.large_string())
    bounds = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    # A slot after the last byte keeps reduceat in range for empty texts at the end.
    data = np.frombuffer(t.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if t.buffers()[2] is not None else np.empty(0, np.uint8)
    score = np.append(data.astype(np.int64) - OFFSET, 0)
    start, n = (bounds - bounds[0])[:-1], np.diff(bounds)
    empty = (n == 0) | t.is_null().to_numpy(zero_copy_only=False)
    size = np.maximum(n, 1)
    if len(t):
        total = np.add.reduceat(score, start)
        least = np.minimum.reduceat(score[:-1] if len(score) > 1 else score, np.minimum(start, max(len(score) - 2, 0)))
        good = np.add.reduceat((score >= 20).astype(np.int64), start)
    else:
        total = least = good = np.empty(0, np.int64)
    columns = [pa.array(total / size, mask=empty), pa.array(least.astype(np.int32), mask=empty), pa.array(good / size, mask=empty)]
    return pa.StructArray.from_arrays(columns, ["mean_q", "min_q", "frac_q20"])


_summaries.__annotations__ = {"t": pa.Array, "return": pa.Array}


def summary(qual: Column) -> Column:
    """Mean, least score and share of scores of 20 or more, in one pass over the batch's bytes."""
    return F.arrow_udf(_summaries, SUMMARY)(qual)


def values(qual: Column, offset: int = OFFSET) -> Column:
    """Array of scores; null for missing, empty for empty quality."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def fraction(qual: Column, threshold: int = 20) -> Column:
    """Share of scores of at least ``threshold`` (0 to 93); null for missing and empty quality."""
    if not 0 <= threshold <= 93:
        raise ValueError("a score lies between 0 and 93")
    if threshold == 0:
        return F.when(F.length(qual) > 0, F.lit(1.0))
    below = f"[{''.join(chr(92) + chr(c) if chr(c) in '[]^-&' + chr(92) else chr(c) for c in range(OFFSET, OFFSET + threshold))}]"
    return F.when(F.length(qual) > 0, F.length(F.regexp_replace(qual, below, "")) / F.length(qual))


def recoded(qual: Column, offset: int) -> Column:
    """Quality text with another offset; fails where a score would leave the printable range."""
    moved = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.char(F.ascii(c) - OFFSET + offset))
    highest = F.array_max(values(qual)) + offset
    return F.when(highest > 126, F.raise_error(F.lit("a score is too high for this offset"))).otherwise(F.array_join(moved, ""))


def from_offset(qual: Column, offset: int) -> Column:
    """Quality text of another offset as text with offset 33; fails where a letter lies below the offset."""
    if not 33 <= offset <= 64:
        raise ValueError("a Phred offset lies between 33 and 64")
    if offset == OFFSET:
        return qual
    letters = "".join(map(chr, range(offset, 127)))
    moved = F.translate(qual, letters, "".join(map(chr, range(OFFSET, OFFSET + len(letters)))))
    return F.when(qual.rlike(f"[^\\x{offset:02x}-\\x7e]"), F.raise_error(F.lit("a letter lies below the Phred offset"))).otherwise(moved)


def shown(qual: Column) -> Column:
    """``<Q:n; mean=x.x>``, or ``<no quality>`` where it is missing."""
    text = F.format_string("<Q:%d; mean=%.1f>", F.length(qual), F.aggregate(values(qual), F.lit(0), lambda a, x: a + x) / F.length(qual))
    return F.when(qual.isNull(), "<no quality>").when(F.length(qual) == 0, "<Q:0; mean=NA>").otherwise(text)


def shortened(seq: Column, width: int) -> Column:
    """Text cut to ``width`` letters (at least 4), the last three of them dots."""
    width = max(width, 4)
    return F.when(F.length(seq) > width, F.concat(F.substring(seq, 1, width - 3), F.lit("..."))).otherwise(seq)
