"""Mergeable percentiles with a deterministic rank error: q-digests (problem 2).

Values are quantised to the ordered universe of 2^32 cells given by the leading
32 bits of a double (sign, exponent and 20 bits of fraction), so a cell is
never wider than one part in a million of its value.  A digest is a set of
nodes of the dyadic tree over these cells with counts; node 1 is the root, node
``i`` has the children ``2i`` and ``2i + 1``, leaves are ``2^32 + cell``.
Compression moves siblings and their parent together while they hold at most
``n / k`` values.  Digests merge by adding up the counts of equal nodes, whatever
run, day or file they come from.

Rank error: a value is counted at most once on each of the 32 levels above its
leaf, and no node above a leaf holds more than ``n / k``, so a rank is off by
less than ``32 n / k`` in any merge of digests with the same ``k``.  The bounds
given with each percentile are usually far closer.

Scale: tasks compress their own rows while they read them and hand on at most
some ``3 k`` nodes a group; only nodes are shuffled.  Digests of 512 tasks at a
time are added up and compressed again, then those, so a task holds the nodes
of some 512 digests of one group at most, for up to 250 000 tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.plans.scratch import written

LEVELS = 32
#: Tasks whose digests are merged first; the outcomes of that meet in a second step.
FAN_IN = 512
_SIGN = np.uint64(1 << 63)


def cells(values: np.ndarray) -> np.ndarray:
    """Cell of each double; larger values never have smaller cells."""
    bits = (values + 0.0).view(np.uint64)
    ordered = np.where(bits >> np.uint64(63) == 1, ~bits, bits | _SIGN)
    return (ordered >> np.uint64(32)).astype(np.int64)


def cell_bounds(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest double of each cell."""
    out = []
    for low in (0, 0xFFFFFFFF):
        ordered = (cell.astype(np.uint64) << np.uint64(32)) | np.uint64(low)
        out.append(np.where(ordered & _SIGN, ordered ^ _SIGN, ~ordered).view(np.float64))
    return np.where(np.isnan(out[0]), -np.inf, out[0]), np.where(np.isnan(out[1]), np.inf, out[1])


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest of nodes sorted by (group, node), all groups at once, from the leaves up."""
    if not len(group):
        return group, node, count
    most = np.zeros(int(group.max()) + 1, np.int64)
    np.add.at(most, group, count)
    most //= k
    level = np.frexp(node.astype(np.float64))[1] - 1
    kept: list[tuple[np.ndarray, ...]] = []
    cg, cn, cc = (x[level == LEVELS] for x in (group, node, count))
    for depth in range(LEVELS, 0, -1):
        pg, pn, pc = (x[level == depth - 1] for x in (group, node, count))
        if len(cg):
            key = (cg << LEVELS + 1) | (cn >> 1)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            total, parent = np.add.reduceat(cc, first), key[first]
            own = (pg << LEVELS + 1) | pn
            at = np.searchsorted(own, parent)
            has = np.zeros(len(parent), bool)
            if len(own):
                has = own[np.minimum(at, len(own) - 1)] == parent
                total = total + np.where(has, pc[np.minimum(at, len(own) - 1)], 0)
            up = total <= most[cg[first]]
            stay = ~np.repeat(up, size)
            kept.append((cg[stay], cn[stay], cc[stay]))
            gone = np.zeros(len(own), bool)
            gone[at[up & has]] = True
            pg = np.r_[pg[~gone], cg[first][up]]
            pn = np.r_[pn[~gone], cn[first][up] >> 1]
            pc = np.r_[pc[~gone], total[up]]
            order = np.lexsort((pn, pg))
            pg, pn, pc = pg[order], pn[order], pc[order]
        cg, cn, cc = pg, pn, pc
    kept.append((cg, cn, cc))
    g, n, c = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((n, g))
    return g[order], n[order], c[order]


def _added(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((node, group))
    g, n, c = group[order], node[order], count[order]
    if not len(g):
        return g, n, c
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (n[1:] != n[:-1])])
    return g[first], n[first], np.add.reduceat(c, first)


def digests(df: DataFrame, group: str, metrics: Sequence[str], k: int = 1_024, hold: int = 400_000) -> DataFrame:
    """``grp, metric, node, n``: a q-digest of each metric in each group.

    Defined cases: nulls and NaN are left out, infinities count; the null group
    is a group; a group without values has no nodes; repeated rows count each;
    an empty table gives no rows; other columns are ignored.

    ``hold`` bounds the nodes a task keeps; beyond it a task compresses, and if
    that is not enough (very many groups) hands its nodes on early.
    """
    if k < 1 or not metrics:
        raise ValueError("k must be positive and metrics must be given")
    rows = df.select(F.col(group).alias("grp"), *(F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)))
    names = list(metrics)

    def build(batches):
        import pyspark

        own = pyspark.TaskContext.get().partitionId() // FAN_IN
        groups: dict = {}
        held = (np.empty(0, np.int64),) * 3

        def out():
            g, node, n = held
            values = list(groups)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(values, kind).take(pa.array(g // len(names))),
                    pa.array(names).take(pa.array(g % len(names))),
                    pa.array(node),
                    pa.array(n),
                    pa.array(np.full(len(n), own)),
                ],
                ["grp", "metric", "node", "n", "part"],
            )

        kind = None
        for b in batches:
            kind = b.column(0).type
            coded = b.column(0).dictionary_encode("encode")
            seen = np.array([groups.setdefault(x, len(groups)) for x in coded.dictionary.to_pylist()], np.int64)
            g = seen[coded.indices.to_numpy(zero_copy_only=False)] if b.num_rows else np.empty(0, np.int64)
            parts = [held]
            for i in range(len(names)):
                v = b.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64)
                ok = ~np.isnan(v)
                node = cells(v[ok]) + (1 << LEVELS)
                parts.append(_added(g[ok] * len(names) + i, node, np.ones(len(node), np.int64)))
            held = _added(*(np.concatenate(x) for x in zip(*parts)))
            if len(held[0]) > hold:
                held = compress(*held, k)
                if len(held[0]) > hold // 2:
                    yield out()
                    groups, held = {}, (np.empty(0, np.int64),) * 3
        if len(held[0]):
            held = compress(*held, k)
            yield out()

    kind_of = dict(rows.dtypes)["grp"]
    some = _compacted(rows.mapInArrow(build, f"grp {kind_of}, metric string, node long, n long, part long"), k)
    return _compacted(some.withColumn("part", F.lit(0).cast("long")), k).drop("part")


def _compacted(nodes: DataFrame, k: int) -> DataFrame:
    """Nodes of equal ``grp, metric, part`` added up and compressed, a digest at a time."""
    kind = dict(nodes.dtypes)["grp"]

    def compact(batches):
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table):
            """Digests of whole groups in rows sorted by group."""
            keys = [rows.column(i).combine_chunks().dictionary_encode("encode").indices.to_numpy() for i in (0, 1, 4)]
            new = np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])]
            first, g = np.flatnonzero(new), np.cumsum(new) - 1
            g, node, n = compress(*_added(g, rows.column(2).to_numpy(), rows.column(3).to_numpy()), k)
            at = pa.array(first[g])
            return pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().take(at), rows.column(1).combine_chunks().take(at), pa.array(node), pa.array(n), rows.column(4).combine_chunks().take(at)], ["grp", "metric", "node", "n", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            last = [b.column(i)[-1] for i in (0, 1, 4)]
            same = np.ones(b.num_rows, bool)
            for i, v in zip((0, 1, 4), last):
                x = b.column(i)
                same &= (pc.is_null(x) if not v.is_valid else pc.fill_null(pc.equal(x, v), False)).to_numpy(zero_copy_only=False)
            cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut == 0 and held and all((held[-1].column(i)[-1] == v) or (not held[-1].column(i)[-1].is_valid and not v.is_valid) for i, v in zip((0, 1, 4), last)):
                held.append(b)
                continue
            if cut or held:
                yield done(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield done(pa.Table.from_batches(held))

    sorted_ = nodes.repartition("grp", "metric", "part").sortWithinPartitions("grp", "metric", "part")
    return sorted_.mapInArrow(compact, f"grp {kind}, metric string, node long, n long, part long")


def merged(nodes: DataFrame, k: int = 1_024) -> DataFrame:
    """Digest of the union of digests with the same ``k``: equal nodes added up, then compressed again."""
    added = nodes.groupBy("grp", "metric", "node").agg(F.sum("n").alias("n")).withColumn("part", F.lit(0).cast("long"))
    return _compacted(added, k).drop("part")


def percentiles(digest: DataFrame, percents: Sequence[int]) -> DataFrame:
    """``grp, metric, percent, n, rank, low, high`` for each percent p.

    The value of rank ``ceil(p * n / 100)`` lies in ``[low, high]`` for certain:
    no value below ``low`` and every value from ``high`` on has enough values
    that are certainly, or possibly, not greater.
    """
    lev = F.length(F.bin("node")) - 1
    spans = digest.withColumn("lev", lev).withColumn("first", F.expr(f"shiftleft(node, {LEVELS} - lev) - shiftleft(1L, {LEVELS})"))
    spans = spans.withColumn("last", F.expr(f"first + shiftleft(1L, {LEVELS} - lev) - 1"))
    own = Window.partitionBy("grp", "metric")
    span = Window.unboundedPreceding, Window.currentRow
    sums = spans.withColumns(
        {
            "total": F.sum("n").over(own),
            "surely": F.sum("n").over(own.orderBy("last").rangeBetween(*span)),
            "maybe": F.sum("n").over(own.orderBy("first").rangeBetween(*span)),
        }
    )
    rank = {p: F.expr(f"(total * {int(p)} + 99) div 100") for p in percents}
    found = sums.groupBy("grp", "metric").agg(
        F.first("total").alias("total"),
        *(F.min(F.when(F.col("maybe") >= rank[p], F.col("first"))).alias(f"lo{p}") for p in percents),
        *(F.min(F.when(F.col("surely") >= rank[p], F.col("last"))).alias(f"hi{p}") for p in percents),
    )
    each = F.explode(F.array(*(F.struct(F.lit(int(p)).alias("percent"), rank[p].alias("rank"), F.col(f"lo{p}").alias("lo"), F.col(f"hi{p}").alias("hi")) for p in percents)))
    cells_of = found.select("grp", "metric", F.col("total").alias("n"), each.alias("e")).select("grp", "metric", "e.percent", "n", "e.rank", "e.lo", "e.hi")

    def decode(batches):
        for b in batches:
            low, high = cell_bounds(b.column(5).to_numpy())[0], cell_bounds(b.column(6).to_numpy())[1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(low), pa.array(high)], ["grp", "metric", "percent", "n", "rank", "low", "high"])

    kind = dict(cells_of.dtypes)["grp"]
    return cells_of.mapInArrow(decode, f"grp {kind}, metric string, percent int, n long, rank long, low double, high double")


def exact_values(df: DataFrame, group: str, metrics: Sequence[str], bounds: DataFrame) -> DataFrame:
    """``grp, metric, percent, value``: exact percentiles, given bounds from ``percentiles``.

    Values below a bound are only counted; those within it, a share of the group
    set by the digest's error, are counted by value and ranked.
    """
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))
    rows = df.select(F.col(group).alias("grp"), one.alias("e")).select("grp", "e.metric", "e.v").where("v is not null and not isnan(v)")
    b = bounds.select(F.col("grp").alias("g"), F.col("metric").alias("m"), "percent", "rank", "low", "high")
    near = rows.join(b, F.col("grp").eqNullSafe(F.col("g")) & (F.col("metric") == F.col("m"))).where("v <= high")
    # -0.0 equals 0.0 and is added to it, as in the digest.
    value = F.when(F.col("v") >= F.col("low"), F.col("v") + F.lit(0.0))
    counted = near.groupBy("grp", "metric", "percent", "rank", value.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("grp", "metric", "percent").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("upto", F.sum("c").over(order)).where("upto >= rank").groupBy("grp", "metric", "percent").agg(F.min("value").alias("value"))


def checked_percentiles(df: DataFrame, group: str, metrics: Sequence[str], percents: Sequence[int], k: int = 1_024) -> DataFrame:
    """``grp, metric, percent, n, rank, low, high, value, within_bounds, within_error``: bounds, and the exact value found within them.

    ``within_error``: no more than twice the stated rank error lies between the value and either bound.
    """
    bounds = written(percentiles(digests(df, group, metrics, k), percents), "percentiles")
    keys = ["grp", "metric", "percent"]
    exact = exact_values(df, group, metrics, bounds).select(F.col("grp").alias("g"), F.col("metric").alias("m"), F.col("percent").alias("p"), "value")
    found = bounds.join(exact, F.col("grp").eqNullSafe(F.col("g")) & (F.col("metric") == F.col("m")) & (F.col("percent") == F.col("p"))).drop("g", "m", "p")
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.col(m).cast("double") + F.lit(0.0)).alias("v")) for m in metrics)))
    values = df.select(F.col(group).alias("g"), one.alias("e")).select("g", "e.m", "e.v").where("v is not null and not isnan(v)")
    near = values.join(found, F.col("g").eqNullSafe(F.col("grp")) & (F.col("m") == F.col("metric")))
    apart = near.groupBy(*keys).agg(F.count_if((F.col("v") >= F.col("low")) & (F.col("v") < F.col("value"))).alias("under"), F.count_if((F.col("v") > F.col("value")) & (F.col("v") <= F.col("high"))).alias("over"))
    apart = apart.select(F.col("grp").alias("g"), F.col("metric").alias("m"), F.col("percent").alias("p"), "under", "over")
    most = 2 * F.lit(rank_error(k)) * F.col("n") + 1
    return found.join(apart, F.col("grp").eqNullSafe(F.col("g")) & (F.col("metric") == F.col("m")) & (F.col("percent") == F.col("p"))).select(
        *keys, "n", "rank", "low", "high", "value", ((F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high"))).alias("within_bounds"), (F.greatest("under", "over") <= most).alias("within_error")
    )


def rank_error(k: int) -> float:
    """Largest error of a rank as a share of all values."""
    return LEVELS / k


def skewed_groups(df: DataFrame, group: str, metrics: Sequence[str], upper: int = 90, lower: int = 50, times: float = 2.0, k: int = 1_024) -> DataFrame:
    """``grp, metric`` where percentile ``upper`` is at least ``times`` percentile ``lower``.

    Bounds from the digests decide most groups; exact values of those left
    over are ranked within their bounds.
    """
    if not (times > 0 and math.isfinite(times)):
        raise ValueError("times must be positive")
    bounds = written(percentiles(digests(df, group, metrics, k), [lower, upper]), "percentiles")
    side = lambda p, c: F.max(F.when(F.col("percent") == p, F.col(c)))
    sides = bounds.groupBy("grp", "metric").agg(side(lower, "low").alias("l0"), side(lower, "high").alias("l1"), side(upper, "low").alias("u0"), side(upper, "high").alias("u1"))
    sure = sides.where(F.col("u0") >= times * F.col("l1")).select("grp", "metric")
    open_ = sides.where((F.col("u0") < times * F.col("l1")) & (F.col("u1") >= times * F.col("l0"))).select(F.col("grp").alias("g"), F.col("metric").alias("m"))
    undecided = bounds.join(open_, F.col("grp").eqNullSafe(F.col("g")) & (F.col("metric") == F.col("m")), "left_semi")
    exact = exact_values(df, group, metrics, undecided).groupBy("grp", "metric").agg(F.max(F.when(F.col("percent") == upper, F.col("value"))).alias("u"), F.max(F.when(F.col("percent") == lower, F.col("value"))).alias("l"))
    return sure.unionAll(exact.where(F.col("u") >= times * F.col("l")).select("grp", "metric"))
