"""The read table: building, checking, combining and describing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import quality
from readloom.plans.scratch import written

READS = T.StructType(
    [
        T.StructField("read_key", T.LongType(), False),
        T.StructField("seq_id", T.StringType()),
        T.StructField("seq_comment", T.StringType()),
        T.StructField("seq", T.StringType(), False),
        T.StructField("qual", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("mean_q", T.DoubleType()),
        T.StructField("min_q", T.IntegerType()),
        T.StructField("frac_q20", T.DoubleType()),
    ]
)
CORE = tuple(READS.fieldNames())


def with_summaries(df: DataFrame) -> DataFrame:
    """``length`` and the quality summaries computed from ``seq`` and ``qual``."""
    s = df.withColumn("_s", quality.summary(F.col("qual")))
    return s.withColumns({"length": F.length("seq"), "mean_q": F.col("_s.mean_q"), "min_q": F.col("_s.min_q"), "frac_q20": F.col("_s.frac_q20")}).drop("_s")


def pack_reads(spark: SparkSession, seq_id: Sequence, seq: Sequence, qual: Sequence | None = None, seq_comment: Sequence | None = None, phred_offset: int = 33) -> DataFrame:
    """Read table of equally long sequences of values, keys from 1 in their order."""
    n = len(seq)
    qual, seq_comment = qual or [None] * n, seq_comment or [None] * n
    if not len(seq_id) == len(qual) == len(seq_comment) == n:
        raise ValueError("all columns need the same length")
    for i, (s, q) in enumerate(zip(seq, qual), 1):
        if s is None:
            raise ValueError(f"row {i}: a sequence is required")
        if q is not None and len(q) != len(s):
            raise ValueError(f"row {i}: quality and sequence differ in length")
    rows = [(i, *r) for i, r in enumerate(zip(seq_id, seq_comment, seq, qual), 1)]
    made = spark.createDataFrame(rows, "read_key long, seq_id string, seq_comment string, seq string, qual string")
    return with_summaries(made.withColumn("qual", quality.from_offset(F.col("qual"), phred_offset))).select(*CORE)


def as_reads(df: DataFrame, id_col: str | None = None, seq_col: str = "seq", qual_col: str | None = "qual", comment_col: str | None = None, key_col: str | None = None, phred_offset: int = 33) -> DataFrame:
    """Read table of any table; only the columns named are kept.  Without ``key_col`` keys rise with the rows but leave gaps; ``compact`` closes them."""
    id_col = id_col or ("seq_id" if "seq_id" in df.columns else "id")
    text = lambda c: F.col(c).cast("string") if c and c in df.columns else F.lit(None).cast("string")
    key = F.col(key_col).cast("long") if key_col else F.monotonically_increasing_id() + 1
    reads = df.select(key.alias("read_key"), text(id_col).alias("seq_id"), text(comment_col).alias("seq_comment"), F.col(seq_col).cast("string").alias("seq"), quality.from_offset(text(qual_col), phred_offset).alias("qual"))
    return with_summaries(reads).select(*CORE)


def annotate(reads: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces annotation columns; core columns cannot be assigned."""
    if core := sorted(set(columns) & set(CORE)):
        raise ValueError(f"core columns cannot be assigned: {', '.join(core)}")
    return reads.withColumns(columns)


def at_positions(reads: DataFrame, key: str, positions: Sequence[int | None]) -> DataFrame:
    """Rows of given keys in the given order, repeated as often as named; unknown keys give null rows."""
    wanted = reads.sparkSession.createDataFrame([(i, p) for i, p in enumerate(positions, 1)], "ordinal int, wanted long")
    return wanted.join(reads, wanted["wanted"] == reads[key], "left").drop("wanted")


def bind(*tables: DataFrame, key: str = "read_key", fill: bool = True) -> DataFrame:
    """Union by name with new keys from 1, table by table in order of the old keys.

    Keys come from the row counts of range partitions, not from a sort in one task.
    """
    if not tables:
        raise ValueError("no tables")
    parts = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=fill)
    return numbered(out, ["_table", key], key).drop("_table")


def numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Numbers from 1 in the given order: positions within range partitions plus the rows before each.

    Only one row for each partition is collected into the offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(*df.columns).alias("_r"), F.monotonically_increasing_id().alias("_m"))
    # Places are written once: planned twice, or run again, a range partitioning may cut elsewhere.
    split = written(ranged.select("_r", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "numbered")
    sizes = split.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    kept = [c for c in df.columns if c != out]
    return split.join(F.broadcast(before), "_p").select((F.col("_i") + F.coalesce("_b", F.lit(0)) + 1).alias(out), *(F.col(f"_r.{c}").alias(c) for c in kept))


def duplicated(reads: DataFrame, column: str = "seq_id", key: str = "read_key", from_last: bool = False) -> DataFrame:
    """``duplicated``: whether an earlier (or later) row has the same value; nulls and empty texts are values.

    The first key of each repeated value is found by a pre-aggregated group.  Rows with null or empty values, which may be
    very many, are compared with two scalars and spread by key, so only other repeated values meet in the join.
    """
    first = F.max if from_last else F.min
    v, none = F.col(column), F.lit("\u0000")
    hot = v.isNull() | (v.cast("string") == "")
    firsts = reads.where(~hot).groupBy(v.cast("string").alias("_v")).agg(first(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    of = lambda c: reads.where(c).select(first(key)).scalar()
    keyed = reads.withColumn("_v", F.when(hot, F.concat(none, F.col(key).cast("string"))).otherwise(v.cast("string")))
    joined = keyed.join(firsts, "_v", "left").withColumn("_first", F.when(v.isNull(), of(v.isNull())).when(hot, of(~v.isNull() & hot)).otherwise(F.col("_first")))
    return joined.withColumn("duplicated", F.coalesce(F.col(key) != F.col("_first"), F.lit(False))).drop("_v", "_first")


def compact(reads: DataFrame, key: str = "read_key") -> DataFrame:
    """The rows that are left, written anew with keys from 1 in their order; what they were filtered from is not needed any more."""
    return numbered(reads, [key], key).select(*reads.columns)


def repeated(reads: DataFrame, times: int = 1, each: int = 1, key: str = "read_key") -> DataFrame:
    """All rows ``times`` over, every row ``each`` times in a row; ``ordinal`` gives the order: run, key, copy."""
    if times < 0 or each < 0:
        raise ValueError("rows cannot be repeated a negative number of times")
    copies = lambda n: F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    out = reads.withColumn("_run", F.explode(copies(times))).withColumn("_copy", F.explode(copies(each)))
    return numbered(out, ["_run", key, "_copy"], "ordinal").drop("_run", "_copy")


def id_is(column: str, operator: str, value: str | None) -> Column:
    """Comparison of identifiers as exact text, ``== != < <= > >=``; null where either side is null."""
    known = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    if operator not in known:
        raise ValueError(f"identifiers are only compared, not {operator}")
    return getattr(F.col(column), f"__{known[operator]}__")(F.lit(value).cast("string"))


def sorted_by_id(reads: DataFrame, decreasing: bool = False, na_last: bool | None = True, column: str = "seq_id", key: str = "read_key") -> DataFrame:
    """``place`` in the order of identifiers, equal ones by key; nulls last, first, or (``None``) left out."""
    c = F.col(column)
    if na_last is None:
        reads = reads.where(c.isNotNull())
    order = (c.desc_nulls_last() if na_last is not False else c.desc_nulls_first()) if decreasing else (c.asc_nulls_last() if na_last is not False else c.asc_nulls_first())
    return numbered(reads, [order, F.col(key)], "place")


def ordered_join(left: DataFrame, right: DataFrame, on: str, order: str) -> DataFrame:
    """Inner join in the order of ``right``: ``place`` counts by ``order`` of the right rows, then by key of the left ones."""
    wanted = right.select(F.col(on).alias("_on"), F.col(order).alias("_order"))
    both = left.join(wanted, F.col(on) == F.col("_on")).drop("_on")
    return numbered(both, ["_order", "read_key"], "place").drop("_order")


def problems(reads: DataFrame, deep: bool = False) -> DataFrame:
    """One row of violation counts: keys, sequences, lengths, and with ``deep`` recomputed summaries."""
    bad = {
        "null_keys": F.col("read_key").isNull(),
        "null_seqs": F.col("seq").isNull(),
        "stale_lengths": ~F.col("length").eqNullSafe(F.length("seq")),
        "qual_lengths": F.length("qual") != F.length("seq"),
    }
    if deep:
        reads = reads.withColumn("_s", quality.summary(F.col("qual")))
        near = lambda c: ~F.coalesce(F.abs(F.col(c) - F.col(f"_s.{c}")) <= 1.5e-8, F.col(c).isNull() & F.col(f"_s.{c}").isNull())
        bad |= {"wrong_mean_q": near("mean_q"), "wrong_min_q": ~F.col("min_q").eqNullSafe(F.col("_s.min_q")), "wrong_frac_q20": near("frac_q20")}
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return reads.agg(F.count(F.lit(1)).alias("reads"), *(count(c).alias(n) for n, c in bad.items()))


def validate(reads: DataFrame, deep: bool = False) -> bool:
    """True, or an error that names what is wrong."""
    if missing := [c for c in CORE if c not in reads.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    row = problems(reads, deep).first().asDict()
    if wrong := {k: v for k, v in row.items() if k != "reads" and v}:
        raise ValueError(f"invalid reads: {wrong}")
    return True


def storage_stats(reads: DataFrame) -> DataFrame:
    """Bytes of the fields as text, and packed with 2 bits a base and 7 bits a score."""
    total = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long")
    bits = lambda n, b: F.floor((n * b + 7) / 8).cast("long")
    s = reads.agg(F.count(F.lit(1)).alias("reads"), total("seq").alias("seq_bytes"), total("qual").alias("qual_bytes"), total("seq_id").alias("id_bytes"))
    return s.withColumns({"seq_packed_bytes": bits(F.col("seq_bytes"), 2), "qual_packed_bytes": bits(F.col("qual_bytes"), 7)})
