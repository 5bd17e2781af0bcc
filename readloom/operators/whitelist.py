"""Whitelists: loading, roles, exact and error-tolerant correction, counters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import neighbourhood, unpack_wide
from readloom.operators.align import infix_pairs


def cleaned(lines: DataFrame, column: str = "barcode", packed_length: int | None = None) -> DataFrame:
    """Distinct ``barcode`` of whitelist lines: trimmed, upper case, headers and other text dropped.

    With ``packed_length`` lines are decimal codes; codes out of range are dropped.
    """
    text = F.trim(F.regexp_replace(column, "[\\r\\n\\t]", " "))
    if packed_length is None:
        return lines.select(F.upper(text).alias("barcode")).where("barcode rlike '^[ACGT]{1,64}$'").distinct()
    import pyarrow as pa

    def decode(t):
        return pa.array([None if x is None else unpack_wide(x, packed_length) for x in t.to_pylist()], pa.string())

    decode.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return lines.select(F.arrow_udf(decode, "string")(text).alias("barcode")).where("barcode is not null").distinct()


def roles(selected: DataFrame, reference: DataFrame) -> DataFrame:
    """``barcode, role``: selected barcodes are ``true``, the rest of the reference ``global``."""
    true = selected.select("barcode").distinct()
    rest = reference.select("barcode").distinct().join(true, "barcode", "left_anti")
    return true.withColumn("role", F.lit("true")).unionAll(rest.withColumn("role", F.lit("global")))


def aliases(whitelist: DataFrame, mutation: int, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """``alias, true_bc, is_identity``: every string within ``mutation`` edits of a barcode; one alias may have many."""
    own = whitelist.select(F.col("barcode").alias("alias"), F.col("barcode").alias("true_bc"), F.lit(True).alias("is_identity"))
    if mutation < 1:
        return own
    more = neighbourhood(whitelist.select(F.col("barcode").alias("true_bc")), "true_bc", mutation, "alias", lengths)
    return own.unionByName(more.select("alias", "true_bc", F.lit(False).alias("is_identity")))


def corrected(observed: DataFrame, barcode: str, alias: DataFrame) -> DataFrame:
    """``observed`` with ``true_bc`` and ``kind``: exact, unique alias, ambiguous (null barcode) or none.

    Aliases are resolved once for each string, then joined by equality; Spark broadcasts them while they are small.
    """
    one = alias.groupBy("alias").agg(
        F.max(F.when(F.col("is_identity"), F.col("true_bc"))).alias("_own"),
        F.count(F.lit(1)).alias("_n"),
        F.min("true_bc").alias("_any"),
    )
    joined = observed.join(one, observed[barcode] == one["alias"], "left")
    true = F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_n") == 1, F.col("_any"))
    kind = F.when(F.col("_own").isNotNull(), "exact").when(F.col("_n") == 1, "corrected").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return joined.withColumns({"true_bc": true, "kind": kind}).drop("alias", "_own", "_n", "_any")


def generated(observed: DataFrame, barcode: str, whitelist: DataFrame, mutation: int) -> DataFrame:
    """``observed barcode, true_bc``: all barcodes of a large whitelist within ``mutation`` edits.

    The distinct observed barcodes are expanded and probe the whitelist by equality, so the whitelist is never
    expanded; it is shuffled only where Spark cannot broadcast it.
    """
    seen = observed.select(F.col(barcode).alias(barcode)).where(F.col(barcode).isNotNull()).distinct()
    tries = seen.withColumn("true_bc", F.col(barcode)).unionByName(neighbourhood(seen, barcode, mutation, "true_bc").select(barcode, "true_bc")) if mutation else seen.withColumn("true_bc", F.col(barcode))
    return tries.join(whitelist.select(F.col("barcode").alias("true_bc")).distinct(), "true_bc", "left_semi").select(barcode, "true_bc").distinct()


def corrected_by_generation(observed: DataFrame, barcode: str, whitelist: DataFrame, mutation: int) -> DataFrame:
    """As ``corrected``, by ``generated``: for whitelists too large to be varied."""
    found = generated(observed, barcode, whitelist, mutation)
    one = found.groupBy(F.col(barcode).alias("_bc")).agg(F.max(F.when(F.col(barcode) == F.col("true_bc"), F.col("true_bc"))).alias("_own"), F.count(F.lit(1)).alias("_n"), F.min("true_bc").alias("_any"))
    joined = observed.join(one, F.col(barcode) == F.col("_bc"), "left")
    true = F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_n") == 1, F.col("_any"))
    kind = F.when(F.col("_own").isNotNull(), "exact").when(F.col("_n") == 1, "corrected").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return joined.withColumns({"true_bc": true, "kind": kind}).drop("_bc", "_own", "_n", "_any")


def relocated(reads: DataFrame, key: str, text: str, start: str, length: int, whitelist: DataFrame, pad: int = 4) -> DataFrame:
    """``key, barcode, shift, end_at``: an exact barcode in the window of ``pad`` bases around its expected place.

    ``start`` is the expected 1-based place; the smallest shift wins, to the right on a tie.  ``end_at`` is the place
    behind the barcode, where the parts chained to it begin.
    """
    each = reads.select(F.col(key).alias("key"), F.col(text).alias("t"), F.col(start).alias("s")).withColumn("shift", F.explode(F.sequence(F.lit(-pad), F.lit(pad))))
    windows = each.where(F.col("s") + F.col("shift") >= 1).withColumn("barcode", F.substring(F.col("t"), F.col("s") + F.col("shift"), F.lit(length))).where(F.length("barcode") == length)
    known = windows.join(whitelist.select("barcode").distinct(), "barcode", "left_semi")
    best = known.groupBy("key").agg(F.min(F.struct(F.abs("shift").alias("d"), (-F.col("shift")).alias("r"), "barcode", "shift", "s")).alias("b"))
    return best.select("key", "b.barcode", "b.shift", (F.col("b.s") + F.col("b.shift") + length).alias("end_at"))


def similar(left: DataFrame, a: str, right: DataFrame, b: str, cap: int) -> DataFrame:
    """``a, b, distance``: pairs of distinct strings within ``cap`` edits (0 to 2).

    Pigeonhole seeds: of ``cap + 1`` parts of ``b`` one is in ``a`` unchanged, shifted by at most ``cap``.
    Parts and windows are joined by equality, the pairs verified; strings shorter than the seeds are empty parts and match.
    """
    if not 0 <= cap <= 2:
        raise ValueError("cap must be 0, 1 or 2")
    x, y = left.select(F.col(a).alias("a")).where("a is not null").distinct(), right.select(F.col(b).alias("b")).where("b is not null").distinct()
    n, parts = F.length("b"), cap + 1
    start = lambda i: F.floor(n * i / parts).cast("int")
    seeds = y.select("b", n.alias("n"), F.explode(F.array(*(F.struct(F.lit(i).alias("part"), start(i).alias("at"), (start(i + 1) - start(i)).alias("size"), F.substring(F.col("b"), start(i) + 1, start(i + 1) - start(i)).alias("seed")) for i in range(parts)))).alias("s")).select("b", "n", "s.*")
    # Lengths of b that can match, then every window that a seed may lie at.
    shapes = seeds.select("n", "part", "at", "size").distinct().withColumn("shift", F.explode(F.array(*map(F.lit, range(-cap, cap + 1)))))
    lengths = x.select("a", F.explode(F.array(*(F.length("a") + d for d in range(-cap, cap + 1)))).alias("n"))
    windows = lengths.join(shapes, "n").where("at + shift >= 0").withColumn("seed", F.expr("substring(a, at + shift + 1, size)")).where(F.length("seed") == F.col("size"))
    pairs = windows.select("a", "n", "part", "seed").distinct().join(seeds.select("b", "n", "part", "seed"), ["n", "part", "seed"]).select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", cap)).where("distance >= 0")


def similar_infix(left: DataFrame, a: str, right: DataFrame, b: str, cap: int) -> DataFrame:
    """``a, b, distance``: pairs of distinct strings with an infix edit distance within ``cap`` (0 to 2); the shorter one is the pattern.

    Of ``cap + 1`` parts of the shorter string one lies in the longer one unchanged, at any place.  Parts and windows
    are joined by equality; a string of up to ``cap`` letters has an empty part and is compared with all that are no shorter.
    """
    if not 0 <= cap <= 2:
        raise ValueError("cap must be 0, 1 or 2")
    x, y = left.select(F.col(a).alias("a")).where("a is not null").distinct(), right.select(F.col(b).alias("b")).where("b is not null").distinct()
    parts = cap + 1

    def one_way(short: DataFrame, p: str, long: DataFrame, t: str) -> DataFrame:
        n = F.length(p)
        start = lambda i: F.floor(n * i / parts).cast("int")
        seeds = short.select(p, F.explode(F.array_distinct(F.array(*(F.substring(F.col(p), start(i) + 1, start(i + 1) - start(i)) for i in range(parts))))).alias("seed"))
        # The few lengths of seeds, at most as many as the longest pattern has letters.
        sizes = seeds.agg(F.collect_set(F.length("seed")).alias("sizes")).scalar()
        windows = long.withColumn("_sizes", sizes).select(t, F.explode("_sizes").alias("size")).where(F.length(t) >= F.col("size"))
        windows = windows.select(t, F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - F.col("size") + 1, F.lit(1))), lambda i: F.substring(F.col(t), i, F.col("size")))))).alias("seed"))
        return seeds.join(windows, "seed").where(F.length(p) <= F.length(t)).select("a", "b")

    def distance(p, t):
        return pa.array(infix_pairs(p.to_pylist(), t.to_pylist()), pa.int32())

    distance.__annotations__ = {"p": pa.Array, "t": pa.Array, "return": pa.Array}
    # Few of the pairs that share a part are near, so repeated ones leave behind the comparison, not before it.
    pairs = one_way(x, "a", y, "b").unionByName(one_way(y, "b", x, "a"))
    return pairs.withColumn("distance", F.arrow_udf(distance, "int")(F.col("a"), F.col("b"))).where(F.col("distance") <= cap).distinct()


def counters(records: DataFrame, class_id: str = "class_id", true_bc: str = "true_bc") -> DataFrame:
    """Counts of each barcode: raw (exact), corrected, total, by strand and on reads with several units."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    exact, fixed, forward = F.col("kind") == "exact", F.col("kind") == "corrected", F.col("strand") == "F"
    concat, kept = F.col("units") > 1, F.coalesce(F.col("kept"), F.lit(False))
    return records.groupBy(class_id, true_bc).agg(
        n(exact).alias("raw_count"),
        n(exact | fixed).alias("total_count"),
        n(fixed).alias("corrected_count"),
        n(forward).alias("forw_count"),
        n(~forward).alias("rev_count"),
        n(forward & concat).alias("forw_concat_count"),
        n(~forward & concat).alias("rev_concat_count"),
        n(~kept).alias("filtered_count"),
    )


def trusted(counter: DataFrame, most_corrected: float = 0.8) -> DataFrame:
    """Counters whose barcode is not almost only known from corrections: 2 exact copies or a corrected share up to ``most_corrected``."""
    share = F.col("corrected_count") / F.greatest(F.col("total_count"), F.lit(1))
    return counter.withColumn("trusted", (F.col("raw_count") >= 2) | (share <= most_corrected))
