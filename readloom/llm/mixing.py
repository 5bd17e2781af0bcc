"""Mixing sources to target shares by pivotal dependent rounding (problem 8).

Every document of a source is wanted the same number of times, its source's
allotment over the source's size.  Allotments are filled like vessels: the mix
has a wanted size (all tokens of its sources, unless one is given), sources too
small for their share stop at their repeats and fall short, which the report
says, and the rest goes to the others in proportion to their shares.  With
``keep_shares`` the mix is instead the largest in which every source has its
share.  Whole copies are given at once, and the
fractions are rounded by pivotal sampling: two documents meet, mass moves
between them at random until one fraction is 0 or 1, the other goes on to meet
the next.  Each document keeps its expected number of copies, and the number of
copies of a source is fixed to within one.  Documents meet in order of size,
so mass moves between documents of nearly equal size and the tokens of a source
are met closely, too.

Scale: tokens are counted in one pass and written.  A range partitioning by
source and size spreads a source of any size over many tasks; each task leaves
at most one open fraction a source, and open fractions meet in a tree of groups
of 64 until one is left.  Random numbers come from hashes of the two that meet.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.plans.scratch import written

_FAN_IN = 64
_MOST_SOURCES = 100_000
_KEPT = 500_000


def _token_counter(path: str, pattern: str):
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    pieces, known = regex.compile(pattern), {}

    def count(text: str) -> int:
        """Merges never cross a piece, so pieces are counted once and remembered."""
        total = 0
        for piece in pieces.findall(text):
            n = known.get(piece)
            if n is None:
                n = len(encoding.encode_ordinary(piece))
                if len(known) < _KEPT and len(piece) < 64:
                    known[piece] = n
            total += n
        return total

    return count


def _uniform(seed: int, a, b) -> float:
    return (xxhash.xxh3_64_intdigest(f"{seed}\x1f{a}\x1f{b}".encode()) + 0.5) / 2.0**64


class Pivot:
    """One open fraction that meets the next ones in turn."""

    def __init__(self, seed: int):
        self.seed = seed
        self.open: tuple | None = None  # (row, fraction)

    def meet(self, row, key, fraction: float) -> Iterator[tuple]:
        """Rows decided by this meeting, with 0 or 1."""
        if fraction <= 0.0 or fraction >= 1.0:
            yield row, int(fraction >= 1.0)
            return
        if self.open is None:
            self.open = (row, key, fraction)
            return
        other, other_key, p = self.open
        u, total = _uniform(self.seed, other_key, key), p + fraction
        total = 1.0 if abs(total - 1.0) < 1e-9 else total
        if total < 1.0:
            # One of them gets all the mass and stays open, the other gets nothing.
            first = u * total < p
            yield (row, 0) if first else (other, 0)
            self.open = (other, other_key, total) if first else (row, key, total)
        else:
            # One of them is taken, the other keeps what is left.
            first = u * (2.0 - total) < 1.0 - fraction
            yield (other, 1) if first else (row, 1)
            left = total - 1.0
            if left < 1e-12:
                yield (row, 0) if first else (other, 0)
                self.open = None
            else:
                self.open = (row, key, left) if first else (other, other_key, left)


class Mix(NamedTuple):
    """``rows``: ``key, source, tokens, copies`` of every document of a target source; ``shares``: the report by source."""

    rows: DataFrame
    shares: DataFrame


def token_sizes(docs: DataFrame, key: str, source: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """``key, source, tokens`` of all rows with text and source."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("t")).where("t is not null and source is not null")

    def counted(batches):
        count = _token_counter(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count(t) for t in b.column(2).to_pylist()], pa.int64())], ["key", "source", "tokens"])

    return rows.mapInArrow(counted, f"key {dict(rows.dtypes)['key']}, source string, tokens long")


def allotments(share: dict[str, float], tokens: dict[str, int], most: dict[str, int], total: float | None = None, keep_shares: bool = False) -> dict[str, float]:
    """Tokens wanted of each source: its share of ``total``, within ``most`` times its tokens."""
    room = {x: float(most[x] * tokens[x]) for x in share}
    left, weight = sum(tokens[x] for x in share) if total is None else total, sum(share.values())
    if keep_shares:
        largest = min((room[x] * weight / share[x] for x in share), default=0.0)
        return {x: share[x] / weight * min(largest, left if total is not None else largest) for x in share}
    out = {}
    for x in sorted(share, key=lambda x: room[x] / share[x]):
        out[x] = min(room[x], left * share[x] / weight)
        left, weight = left - out[x], weight - share[x]
    return out


def mix(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, vocabulary: str, pattern: str, seed: int = 20, total_tokens: int | None = None, keep_shares: bool = False) -> Mix:
    """Copies of each document so that sources have their target shares of all tokens.

    ``targets`` has ``source, target_share, max_repeats``, one row a source.  The
    mix has ``total_tokens``, by default as many as its sources have, fewer where
    all repeats do not give them; a source that its repeats do not let reach its
    share is used as often as they allow and reported as ``capped``, with the
    tokens it is short by.  With ``keep_shares`` every source has its share, and
    the scarcest one sets the size.

    Defined cases: documents without text or source, and of sources without a
    target, are left out; targets without a share, repeats or tokens are
    reported with no tokens and the shares of the others are taken in
    proportion; documents without tokens take part like others; repeated rows
    are documents of their own; no document is used more than ``max_repeats``
    times; empty tables give no rows.
    """
    wanted = targets.select(F.col("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).where("source is not null")
    rows = wanted.limit(_MOST_SOURCES + 1).collect()
    if len(rows) > _MOST_SOURCES:
        raise ValueError(f"more than {_MOST_SOURCES} target sources")
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source has two targets")
    spark = docs.sparkSession
    names = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    sizes = written(token_sizes(docs.join(F.broadcast(names.withColumnRenamed("source", source)), source, "left_semi"), key, source, text, vocabulary, pattern), "sizes")
    tokens = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    live = [r for r in rows if (r["share"] or 0) > 0 and (r["most"] or 0) > 0 and tokens.get(r["source"], 0) > 0]
    of = {r["source"]: r for r in live}
    given = allotments({x: r["share"] for x, r in of.items()}, tokens, {x: r["most"] for x, r in of.items()}, total_tokens, keep_shares)
    rate = {x: min(float(of[x]["most"]), n / tokens[x]) for x, n in given.items()}
    size, weight = sum(given.values()), sum(r["share"] for r in live)
    aims = spark.createDataFrame([(x, of[x]["share"] / weight * size, given[x], given[x] >= of[x]["most"] * tokens[x] * (1 - 1e-9)) for x in given], "source string, wanted double, allotted double, capped boolean")
    rates = spark.createDataFrame(list(rate.items()), "source string, rate double")
    each = sizes.join(F.broadcast(rates), "source").select("key", "source", "tokens", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    kind = dict(each.dtypes)["key"]
    fields = f"key {kind}, source string, tokens long, copies long, fraction double, block long"

    def pivoted(batches, whole):
        """Pivots in the order of rows; an open fraction is handed on with its block."""
        import pyspark

        own = pyspark.TaskContext.get().partitionId()
        current, pivot, block = None, None, own

        def batch(out):
            return pa.RecordBatch.from_pylist(out, schema)

        def left():
            return [dict(pivot.open[0], fraction=pivot.open[2], block=block)] if pivot and pivot.open else []

        schema = None
        for b in batches:
            if schema is None:
                schema = pa.schema([("key", b.schema.field("key").type), ("source", pa.string()), ("tokens", pa.int64()), ("copies", pa.int64()), ("fraction", pa.float64()), ("block", pa.int64())])
            out = []
            for r in b.to_pylist():
                at = (r["source"], None if whole else r["block"] // _FAN_IN)
                if at != current:
                    out += left()
                    current, pivot = at, Pivot(seed)
                    block = own if whole else at[1]
                row = {"key": r["key"], "source": r["source"], "tokens": r["tokens"], "copies": r["copies"], "fraction": None, "block": None}
                out += [dict(d, copies=d["copies"] + n) for d, n in pivot.meet(row, r["key"], r["fraction"])]
            yield batch(out)
        if schema is not None:
            yield batch(left())

    first = each.select("key", "source", "tokens", F.col("base").cast("long").alias("copies"), "fraction").repartitionByRange("source", "tokens", "key").sortWithinPartitions("source", "tokens", "key")
    levels = [written(first.mapInArrow(lambda it: pivoted(it, True), fields), "mix")]
    while (last := levels[-1].where("fraction is not null").agg(F.max("block")).collect()[0][0]) is not None and last >= 1:
        rest = levels[-1].where("fraction is not null")
        grouped = rest.repartition("source", F.floor(F.col("block") / _FAN_IN)).sortWithinPartitions("source", "block", "key")
        levels.append(written(grouped.mapInArrow(lambda it: pivoted(it, False), fields), "mix"))
    done = levels[0].where("fraction is null")
    for level in levels[1:]:
        done = done.unionAll(level.where("fraction is null"))
    chance = (F.xxhash64(F.lit(seed), F.col("source"), F.col("key")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < F.col("fraction")
    # At most one fraction a source is open at the end; it is drawn.
    last_open = levels[-1].where("fraction is not null").withColumn("copies", F.col("copies") + F.when(chance, 1).otherwise(0))
    result = done.unionAll(last_open).select("key", "source", "tokens", "copies")
    used = result.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    sum_used = result.select(F.sum(F.col("tokens") * F.col("copies"))).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shares = wanted.join(used, "source", "left").join(aims, "source", "left").select(
        "source", F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), zero("documents"), zero("most_copies"), zero("tokens_used"), F.coalesce(F.col("tokens_used") / sum_used, F.lit(0.0)).alias("actual_share"),
        F.coalesce("allotted", F.lit(0.0)).alias("tokens_allotted"), F.coalesce("capped", F.lit(False)).alias("capped"), F.greatest(F.lit(0.0), F.coalesce(F.col("wanted") - F.col("allotted"), F.lit(0.0))).alias("short_by"),
    )
    return Mix(result, shares)
