"""Column functions on DNA strings; all but the wide integer codes stay in the JVM."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: Digits of bases in packed integers.
PACKED_ORDER = "ACTG"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than A, C, G, T (either case) stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def is_uuid(seq_id: Column) -> Column:
    """36 characters with hyphens in the places of a UUID, lower-case hexadecimal; null for null."""
    return seq_id.rlike(UUID)


def pack(seq: Column) -> Column:
    """Integer of up to 31 bases, first base most significant; null for other letters, empty or longer text."""
    digits = F.translate(seq, PACKED_ORDER, "0123")
    return F.when(seq.rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("long"))


def unpack(code: Column, length: int) -> Column:
    """DNA of ``length`` bases (up to 31); null where the code needs more."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 4), length, "0")
    fits = (code >= 0) & (code < F.lit(4**length if length < 31 else 1 << 62))
    return F.when(fits, F.translate(digits, "0123", PACKED_ORDER))


def _pack_text(t: str | None) -> str | None:
    if t is None or not re.fullmatch("[ACGT]{1,64}", t):
        return None
    n = 0
    for c in t:
        n = n * 4 + PACKED_ORDER.index(c)
    return str(n)


def pack_wide(seq: Column) -> Column:
    """Decimal text of up to 64 bases: their codes exceed every SQL integer."""

    def codes(t):
        return pa.array([_pack_text(x) for x in t.to_pylist()], pa.string())

    codes.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return F.arrow_udf(codes, "string")(seq)


def unpack_wide(code: str, length: int) -> str | None:
    """DNA of ``length`` bases for a decimal code; null where it does not fit."""
    if not re.fullmatch("[0-9]+", code) or int(code) >= 4**length:
        return None
    n, out = int(code), []
    for _ in range(length):
        out.append(PACKED_ORDER[n & 3])
        n >>= 2
    return "".join(reversed(out))


def tag(text: Column, name: str) -> Column:
    """Value of a complete blank- or tab-delimited field ``NAME:Z:value``; null where there is none."""
    if not re.fullmatch("[A-Za-z][A-Za-z0-9]", name):
        raise ValueError("a tag has two characters")
    pattern = f"(?:^|[ \\t]){name}:Z:([^ \\t]*)"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _with_variants(df: DataFrame, seq: str, variants: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(variants)).where(F.col(out) != F.col(seq))


def point_mutations(df: DataFrame, seq: str, out: str = "variant") -> DataFrame:
    """One row for each of the ``3 L`` substitutions of ``seq``; none for null or empty text."""
    at = F.sequence(F.lit(1), F.length(seq))
    one = lambda i: F.transform(F.array(*map(F.lit, BASES)), lambda b: F.concat(F.substring(seq, 1, i - 1), b, F.substring(seq, i + 1, F.length(seq))))
    # A substring of length 0 at the first base is empty, as wanted.
    variants = F.when(F.length(seq) > 0, F.flatten(F.transform(at, one)))
    return _with_variants(df, seq, variants, out)


def edits(df: DataFrame, seq: str, out: str = "variant") -> DataFrame:
    """Distinct one-edit neighbours: substitutions, deletions (from 2 bases on) and insertions (below 64 bases)."""
    n, whole = F.length(seq), F.col(seq)
    at = F.sequence(F.lit(1), n)
    letters = F.array(*map(F.lit, BASES))
    head, tail = (lambda i: F.substring(whole, 1, i - 1)), (lambda i: F.substring(whole, i, n))
    sub = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda b: F.concat(head(i), b, tail(i + 1)))))
    dele = F.when(n > 1, F.transform(at, lambda i: F.concat(head(i), tail(i + 1)))).otherwise(F.array())
    ins = F.when(n < 64, F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(letters, lambda b: F.concat(head(i), b, tail(i)))))).otherwise(F.array())
    return _with_variants(df, seq, F.when(n > 0, F.array_distinct(F.concat(sub, dele, ins))), out)


def neighbourhood(df: DataFrame, seq: str, k: int, out: str = "variant", lengths: tuple[int, ...] | None = None) -> DataFrame:
    """Distinct strings within ``k`` edits of ``seq``, itself left out; ``lengths`` keeps those of given lengths.

    The number of variants grows as a power ``k`` of the length: expand the smaller side of a join.
    """
    keys = [c for c in df.columns if c != out]
    reach = edits(df, seq, out)
    for _ in range(k - 1):
        further = edits(reach.withColumnRenamed(out, "_from"), "_from", out).select(*keys, out)
        reach = reach.unionByName(further).distinct()
    reach = reach.where(F.col(out) != F.col(seq))
    return reach if lengths is None else reach.where(F.length(out).isin(*lengths))


def shifted(df: DataFrame, seq: str, out: str = "variant") -> DataFrame:
    """``b + core`` and ``core + b`` for each base, core being all but the last base; itself left out."""
    core = F.substring(F.col(seq), 1, F.length(seq) - 1)
    both = [x for b in BASES for x in (F.concat(F.lit(b), core), F.concat(core, F.lit(b)))]
    return _with_variants(df, seq, F.when(F.length(seq) > 0, F.array_distinct(F.array(*both))), out)


def hamming_shell(df: DataFrame, seq: str, out: str = "variant") -> DataFrame:
    """Distinct strings that differ in one or two places."""
    keys = [c for c in df.columns if c != out]
    one = point_mutations(df, seq, out)
    two = point_mutations(one.withColumnRenamed(out, "_from"), "_from", out).select(*keys, out)
    return one.select(*keys, out).unionByName(two).where(F.col(out) != F.col(seq)).distinct()


def mask_pattern(mask: str) -> tuple[str, list[int]]:
    """Regular expression of a capture mask, and the lengths of its captured blocks.

    ``N`` captures a base, ``n`` skips one, all other letters stand for themselves;
    at least one literal and 1 to 64 captures are required.
    """
    if not re.fullmatch("[ACGTNn]+", mask):
        raise ValueError("a mask holds A, C, G, T, N and n")
    if not re.search("[ACGT]", mask) or not 1 <= mask.count("N") <= 64:
        raise ValueError("a mask needs a literal base and 1 to 64 captures")
    blocks = [m.group() for m in re.finditer("N+|n+|[ACGT]+", mask)]
    parts = [f"([ACGT]{{{len(b)}}})" if b[0] == "N" else f"[ACGT]{{{len(b)}}}" if b[0] == "n" else b for b in blocks]
    return "".join(parts), [len(b) for b in blocks if b[0] == "N"]
