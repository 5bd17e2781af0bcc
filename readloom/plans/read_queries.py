"""Queries of the operators on reads, layouts, whitelists and slides, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import dna, quality
from readloom.operators import concat, discover, hmm, reformat, scan, spatial, whitelist
from readloom.operators import demux as dm
from readloom.operators import reads as rd
from readloom.operators.align import infix_distance
from readloom.plans.core_queries import table
from readloom.plans.shape import few, spread
from readloom.sources.layouts import Element, from_rows
from readloom.streaming.counts import barcode_counts, run_to_end

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def reads_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rad_reads")


def layout_of(spark: SparkSession, sf: str, name: str) -> list[Element]:
    """A layout has a handful of rows and is needed on the driver to build the plan."""
    rows = few(table(spark, sf, "read_layout").where(F.col("layout") == name).orderBy("element_no"), 1000)
    return from_rows(r.asDict() for r in rows)


def part_of(spark: SparkSession, sf: str, layout: str, part: str) -> str:
    return next(e.seq for e in layout_of(spark, sf, layout) if e.id == part)


def barcodes_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    lines = table(spark, sf, "whitelist_barcodes").where(F.col("whitelist") == name)
    return whitelist.cleaned(lines)


def in_layout(spark: SparkSession, sf: str, layout: str) -> DataFrame:
    """Reads of the runs of a layout."""
    runs = table(spark, sf, "run_batches").where(F.col("layout") == layout).select("run_id").distinct()
    return spread(reads_of(spark, sf)).join(runs, "run_id", "left_semi")


def sql_part(layout: str, part: str) -> str:
    return f"(SELECT upper(seq) FROM read_layout WHERE layout = '{layout}' AND id = '{part}')"


_RC = "reverse(translate({}, 'ACGTacgt', 'TGCAtgca'))"
_WL = "(SELECT DISTINCT upper(trim(barcode)) AS barcode FROM whitelist_barcodes WHERE whitelist = '{}' AND regexp_full_match(upper(trim(barcode)), '[ACGT]{{1,64}}'))"


# Read table -------------------------------------------------------------------


@query("""
SELECT read_key, CAST(length(seq) AS INT) AS length, round(list_avg(v), 6) AS mean_q, CAST(list_min(v) AS INT) AS min_q, round(len(list_filter(v, lambda x: x >= 20)) / nullif(len(v), 0), 6) AS frac_q20
FROM (SELECT read_key, seq, CASE WHEN qual <> '' THEN list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) END AS v FROM rad_reads)""")
def reads_qc_summary(spark, sf):
    r = rd.with_summaries(spread(reads_of(spark, sf).select("read_key", "seq", "qual")))
    return r.select("read_key", "length", F.round("mean_q", 6).alias("mean_q"), "min_q", F.round("frac_q20", 6).alias("frac_q20"))


@query("SELECT read_key, seq_id, min_q FROM rad_reads WHERE mean_q >= 30 AND min_q >= 10")
def reads_filter_mean_q(spark, sf):
    return reads_of(spark, sf).where("mean_q >= 30 and min_q >= 10").select("read_key", "seq_id", "min_q")


@query("SELECT read_key, round(length(regexp_replace(qual, '[!->]', '', 'g')) / nullif(length(qual), 0), 6) AS fraction FROM rad_reads")
def reads_qfraction(spark, sf):
    return reads_of(spark, sf).select("read_key", F.round(quality.fraction(F.col("qual"), 30), 6).alias("fraction"))


@query("SELECT read_key, CASE WHEN qual = '' THEN '' ELSE array_to_string(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33), ',') END AS scores FROM rad_reads WHERE qual IS NOT NULL")
def reads_phred_values(spark, sf):
    return reads_of(spark, sf).where("qual is not null").select("read_key", F.array_join(quality.values(F.col("qual")), ",").alias("scores"))


@query("SELECT seq_id, count(*) AS n FROM rad_reads GROUP BY seq_id")
def reads_group_ids(spark, sf):
    return reads_of(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT read_key, row_number() OVER (PARTITION BY seq_id ORDER BY read_key) > 1 AS duplicated FROM rad_reads")
def reads_duplicated_ids(spark, sf):
    return rd.duplicated(reads_of(spark, sf).select("seq_id", "read_key")).select("read_key", "duplicated")


@query("SELECT read_key, row_number() OVER (PARTITION BY seq_id ORDER BY read_key DESC) > 1 AS duplicated FROM rad_reads")
def reads_duplicated_from_last(spark, sf):
    return rd.duplicated(reads_of(spark, sf).select("seq_id", "read_key"), from_last=True).select("read_key", "duplicated")


@query("SELECT seq_id, min(read_key) AS read_key FROM rad_reads GROUP BY seq_id")
def reads_unique_ids(spark, sf):
    return reads_of(spark, sf).groupBy("seq_id").agg(F.min("read_key").alias("read_key"))


@query("SELECT read_key, seq_id, row_number() OVER (ORDER BY seq_id NULLS FIRST, read_key) AS place FROM rad_reads")
def reads_sort_ids(spark, sf):
    return rd.numbered(reads_of(spark, sf).select("seq_id", "read_key"), ["seq_id", "read_key"], "place")


@query("SELECT r.read_key, r.seq_id, b.layout FROM rad_reads r JOIN (SELECT DISTINCT run_id, layout FROM run_batches) b ON r.run_id = b.run_id")
def reads_index_join(spark, sf):
    runs = table(spark, sf, "run_batches").select("run_id", "layout").distinct()
    return reads_of(spark, sf).join(runs, "run_id").select("read_key", "seq_id", "layout")


@query("""
SELECT row_number() OVER (ORDER BY t, k) AS read_key, seq_id, sample_id, run_id FROM (
  SELECT 0 AS t, read_key AS k, seq_id, sample_id, NULL AS run_id FROM rad_reads UNION ALL SELECT 1, read_key, seq_id, NULL, run_id FROM rad_reads)""")
def reads_bind_fill(spark, sf):
    r = reads_of(spark, sf)
    return rd.bind(r.select("read_key", "seq_id", "sample_id"), r.select("read_key", "seq_id", "run_id"))


@query("""
WITH w(ordinal, wanted) AS (VALUES (1, 6), (2, 2), (3, 2), (4, 4), (5, 1), (6, NULL), (7, -5))
SELECT CAST(w.ordinal AS INT) AS ordinal, r.read_key, r.seq_id FROM w LEFT JOIN rad_reads r ON r.read_key = w.wanted""")
def reads_at_positions(spark, sf):
    return rd.at_positions(reads_of(spark, sf).select("read_key", "seq_id"), "read_key", [6, 2, 2, 4, 1, None, -5])


@query("""
WITH s AS (SELECT *, list_avg(v) AS m, list_min(v) AS lo, len(list_filter(v, lambda x: x >= 20)) / nullif(len(v), 0) AS fr
  FROM (SELECT *, CASE WHEN qual <> '' THEN list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) END AS v FROM rad_reads))
SELECT count(*) AS reads, CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (seq IS NULL) AS null_seqs,
  count(*) FILTER (length IS DISTINCT FROM length(seq)) AS stale_lengths, count(*) FILTER (length(qual) <> length(seq)) AS qual_lengths,
  count(*) FILTER (NOT coalesce(abs(mean_q - m) <= 1.5e-8, mean_q IS NULL AND m IS NULL)) AS wrong_mean_q,
  count(*) FILTER (min_q IS DISTINCT FROM lo) AS wrong_min_q,
  count(*) FILTER (NOT coalesce(abs(frac_q20 - fr) <= 1.5e-8, frac_q20 IS NULL AND fr IS NULL)) AS wrong_frac_q20 FROM s""")
def reads_validate(spark, sf):
    return rd.problems(reads_of(spark, sf), deep=True)


@query("""
SELECT *, (2 * seq_bytes + 7) // 8 AS seq_packed_bytes, (7 * qual_bytes + 7) // 8 AS qual_packed_bytes FROM (
  SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS seq_bytes, CAST(sum(length(qual)) AS BIGINT) AS qual_bytes, CAST(sum(length(seq_id)) AS BIGINT) AS id_bytes FROM rad_reads)""")
def storage_stats(spark, sf):
    return rd.storage_stats(reads_of(spark, sf))


@query("""
SELECT read_key, CASE WHEN length(seq) > 20 THEN seq[1:17] || '...' ELSE seq END AS seq_shown,
  CASE WHEN qual IS NULL THEN '<no quality>' WHEN qual = '' THEN '<Q:0; mean=NA>' ELSE '<Q:' || length(qual) || '>' END AS qual_shown FROM rad_reads""")
def reads_format(spark, sf):
    # The mean is left out of the comparison: engines round halves differently.
    q = F.regexp_replace(quality.shown(F.col("qual")), "; mean=[0-9.]+", "")
    return reads_of(spark, sf).select("read_key", quality.shortened(F.col("seq"), 20).alias("seq_shown"), q.alias("qual_shown"))


# DNA ---------------------------------------------------------------------------


@query(f"SELECT read_key, {_RC.format('seq')} AS rc FROM rad_reads")
def revcomp(spark, sf):
    return reads_of(spark, sf).select("read_key", dna.revcomp(F.col("seq")).alias("rc"))


@query(f"SELECT count(*) AS ids, count(*) FILTER (regexp_full_match(seq_id, '{dna.UUID}')) AS uuids FROM rad_reads WHERE seq_id IS NOT NULL")
def uuid_ids(spark, sf):
    r = reads_of(spark, sf).where("seq_id is not null")
    return r.agg(F.count(F.lit(1)).alias("ids"), F.count(F.when(dna.is_uuid(F.col("seq_id")), 1)).alias("uuids"))


@query(f"""
SELECT barcode, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(barcode, ''), lambda c: CAST(strpos('ACTG', c) - 1 AS BIGINT))), lambda a, d: a * 4 + d) AS BIGINT) AS code, barcode AS back
FROM {_WL.format('cell16')}""")
def pack_unpack_dna(spark, sf):
    b = barcodes_of(spark, sf, "cell16").withColumn("code", dna.pack(F.col("barcode")))
    return b.withColumn("back", dna.unpack(F.col("code"), 16))


_POINT = "SELECT barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i + 1) AS variant FROM (SELECT barcode, CAST(unnest(range(1, length(barcode) + 1)) AS INT) AS i FROM {0}), (VALUES ('A'), ('C'), ('G'), ('T')) l(b)"


@query(f"SELECT * FROM ({_POINT.format(_WL.format('cell16'))}) WHERE variant <> barcode")
def point_mutations(spark, sf):
    return dna.point_mutations(barcodes_of(spark, sf, "cell16"), "barcode")


@query(f"""
WITH w AS {_WL.format('well8')}, p AS (SELECT barcode, CAST(unnest(range(1, length(barcode) + 2)) AS INT) AS i FROM w), l(b) AS (VALUES ('A'), ('C'), ('G'), ('T'))
SELECT DISTINCT barcode, variant FROM (
  SELECT barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i + 1) AS variant FROM p, l WHERE i <= length(barcode)
  UNION ALL SELECT barcode, substr(barcode, 1, i - 1) || substr(barcode, i + 1) FROM p WHERE i <= length(barcode)
  UNION ALL SELECT barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i) FROM p, l) WHERE variant <> barcode""")
def edit_neighbourhood(spark, sf):
    return dna.neighbourhood(barcodes_of(spark, sf, "well8"), "barcode", 1)


@query(f"""
WITH w AS {_WL.format('well8')}, one AS ({_POINT.format('w')}), two AS (SELECT o.barcode, m.variant FROM (SELECT DISTINCT barcode, variant FROM one) o, LATERAL (
  SELECT substr(o.variant, 1, i - 1) || b || substr(o.variant, i + 1) AS variant FROM range(1, 9) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) l(b)) m)
SELECT DISTINCT barcode, variant FROM two WHERE variant <> barcode""")
def hamming_shell(spark, sf):
    return dna.hamming_shell(barcodes_of(spark, sf, "well8"), "barcode")


@query(f"""
SELECT DISTINCT barcode, variant FROM (SELECT barcode, unnest([b || substr(barcode, 1, length(barcode) - 1), substr(barcode, 1, length(barcode) - 1) || b]) AS variant
  FROM {_WL.format('cell16')}, (VALUES ('A'), ('C'), ('G'), ('T')) l(b)) WHERE variant <> barcode""")
def shifted_candidates(spark, sf):
    return dna.shifted(barcodes_of(spark, sf, "cell16"), "barcode")


@query(f"SELECT w AS whitelist, barcode FROM (SELECT 'cell16' AS w, barcode FROM {_WL.format('cell16')} UNION ALL SELECT 'well8', barcode FROM {_WL.format('well8')})")
def whitelist_clean(spark, sf):
    parts = [barcodes_of(spark, sf, w).select(F.lit(w).alias("whitelist"), "barcode") for w in ("cell16", "well8")]
    return parts[0].unionAll(parts[1])


_TAG = "CASE WHEN regexp_matches(seq_comment, '(?:^|[ \\t]){0}:Z:([^ \\t]*)') THEN regexp_extract(seq_comment, '(?:^|[ \\t]){0}:Z:([^ \\t]*)', 1) END"


@query(f"SELECT read_key, {_TAG.format('CB')} AS cb, {_TAG.format('UB')} AS ub FROM rad_reads")
def tag_parse(spark, sf):
    return reads_of(spark, sf).select("read_key", dna.tag(F.col("seq_comment"), "CB").alias("cb"), dna.tag(F.col("seq_comment"), "UB").alias("ub"))


# Scanning ----------------------------------------------------------------------

_LOCATED = f"""
WITH a AS (SELECT {sql_part('tagline_three', 'forw_primer')} AS p), o AS (SELECT read_key, upper(seq) AS f, {_RC.format('upper(seq)')} AS r FROM rad_reads),
h AS (SELECT read_key, CASE WHEN strpos(f, p) > 0 THEN 'F' ELSE 'R' END AS strand, CASE WHEN strpos(f, p) > 0 THEN f ELSE r END AS s,
  CASE WHEN strpos(f, p) > 0 THEN strpos(f, p) ELSE strpos(r, p) END + length(p) AS pl FROM o, a WHERE strpos(f, p) > 0 OR strpos(r, p) > 0)"""


def _located(spark, sf):
    return scan.located(spread(reads_of(spark, sf).select("read_key", "seq")), "seq", part_of(spark, sf, "tagline_three", "forw_primer"))


@query(_LOCATED + "SELECT read_key, strand, substr(s, pl, 16) AS barcode FROM h WHERE length(substr(s, pl, 16)) = 16")
def scan_exact(spark, sf):
    return scan.captured(_located(spark, sf), 16).select("read_key", "strand", "barcode")


@query(_LOCATED + "SELECT read_key, strand, substr(s, pl + 2, 18) AS barcode FROM h WHERE length(substr(s, pl + 2, 18)) = 18")
def scan_margins(spark, sf):
    return scan.captured(_located(spark, sf), 16, 2, 2).select("read_key", "strand", "barcode")


_COUNTED = _LOCATED + ", c AS (SELECT substr(s, pl, 16) AS barcode, count(*) AS count FROM h WHERE length(substr(s, pl, 16)) = 16 GROUP BY 1)"
_LIMITS = """, t AS (SELECT greatest(1, CAST(ceil(max(count) / 10000) AS BIGINT)) AS floor, quantile_disc(count, 0.99) AS q FROM c),
l AS (SELECT floor, greatest(floor, CAST(ceil(q / 10) AS BIGINT)) AS threshold FROM t)"""


def _counted(spark, sf):
    return scan.counts(scan.captured(_located(spark, sf), 16), "barcode")


@query(_COUNTED + _LIMITS + "SELECT barcode, count, count >= threshold AS selected FROM c, l")
def scan_called(spark, sf):
    return scan.called(_counted(spark, sf))


@query(_COUNTED + _LIMITS + "SELECT barcode, count, count >= floor AS selected FROM c, l")
def scan_above_floor(spark, sf):
    return scan.called(_counted(spark, sf), "above_floor")


@query(_COUNTED + "SELECT barcode, count, count >= 1 AS selected FROM c")
def scan_low_count_profile(spark, sf):
    return scan.called(_counted(spark, sf), "above_floor", spatial=True)


@query(_COUNTED + _LIMITS + "SELECT CAST(floor AS BIGINT) AS floor, CAST(threshold AS BIGINT) AS threshold FROM l")
def scan_thresholds(spark, sf):
    return scan.thresholds(_counted(spark, sf))


@query(
    _COUNTED
    + _LIMITS
    + f""", m AS (SELECT c.*, w.barcode IS NOT NULL AS known FROM c LEFT JOIN {_WL.format('cell16')} w ON c.barcode = w.barcode)
SELECT (SELECT count(*) FROM rad_reads) AS reads_processed, CAST(sum(count) AS BIGINT) AS total_extractions, count(*) AS unique_sequences,
  CAST(coalesce(sum(count) FILTER (known), 0) AS BIGINT) AS total_perfect_matches, count(*) FILTER (known) AS unique_perfect_matches,
  CAST(max(floor) AS BIGINT) AS floor, CAST(max(threshold) AS BIGINT) AS threshold, count(*) FILTER (count >= floor) AS above_floor, count(*) FILTER (count >= threshold) AS high_specificity,
  round(100.0 * coalesce(sum(count) FILTER (known), 0) / sum(count), 6) AS match_rate_percent FROM m, l"""
)
def scan_stats(spark, sf):
    s = scan.scan_stats(reads_of(spark, sf), _counted(spark, sf), barcodes_of(spark, sf, "cell16"))
    return s.withColumn("match_rate_percent", F.round("match_rate_percent", 6))


_MASKED = f"""
WITH m AS (SELECT {sql_part('splitwell', 'linker_1')} || '([ACGT]{{8}})' || {sql_part('splitwell', 'linker_2')} AS p),
o AS (SELECT read_key, upper(seq) AS f, {_RC.format('upper(seq)')} AS r FROM rad_reads)
SELECT read_key, CASE WHEN regexp_matches(f, p) THEN 'F' ELSE 'R' END AS strand, CASE WHEN regexp_matches(f, p) THEN regexp_extract(f, p, 1) ELSE regexp_extract(r, p, 1) END AS barcode
FROM o, m WHERE regexp_matches(f, p) OR regexp_matches(r, p)"""


@query(_MASKED)
def scan_masked(spark, sf):
    mask = part_of(spark, sf, "splitwell", "linker_1") + "N" * 8 + part_of(spark, sf, "splitwell", "linker_2")
    return scan.masked(spread(reads_of(spark, sf).select("read_key", "seq")), "seq", mask).select("read_key", "strand", "barcode")


_SPLIT = f"""
WITH a AS (SELECT {sql_part('splitwell', 'forw_primer')} AS p, length({sql_part('splitwell', 'linker_1')}) AS gap), w AS {_WL.format('well8')},
o AS (SELECT read_key, upper(seq) AS f, {_RC.format('upper(seq)')} AS r FROM rad_reads),
h AS (SELECT read_key, gap, CASE WHEN strpos(f, p) > 0 THEN 'F' ELSE 'R' END AS strand, CASE WHEN strpos(f, p) > 0 THEN f ELSE r END AS s,
  CASE WHEN strpos(f, p) > 0 THEN strpos(f, p) ELSE strpos(r, p) END + length(p) AS pl FROM o, a WHERE strpos(f, p) > 0 OR strpos(r, p) > 0),
e AS (SELECT read_key, strand, k AS "offset", substr(s, pl + k, 8) AS bc1, substr(s, pl + k + 8 + gap, 8) AS bc2 FROM h, range(0, 4) t(k)),
k AS (SELECT *, row_number() OVER (PARTITION BY read_key ORDER BY "offset") AS n FROM e WHERE bc1 IN (SELECT barcode FROM w) AND bc2 IN (SELECT barcode FROM w))"""


def _split(spark, sf):
    wells = barcodes_of(spark, sf, "well8")
    gap = len(part_of(spark, sf, "splitwell", "linker_1"))
    return scan.split_scan(spread(reads_of(spark, sf).select("read_key", "seq")), "read_key", "seq", part_of(spark, sf, "splitwell", "forw_primer"), wells, wells, 8, 8, umi_length=0, gap=gap)


@query(_SPLIT + 'SELECT read_key, strand, bc1, bc2, CAST("offset" AS INT) AS "offset" FROM k WHERE n = 1')
def scan_split(spark, sf):
    return _split(spark, sf).select(F.col("key").alias("read_key"), "strand", "bc1", "bc2", "offset")


@query(_SPLIT + "SELECT bc1, bc2, count(*) AS count FROM k WHERE n = 1 GROUP BY bc1, bc2")
def scan_split_pairs(spark, sf):
    return scan.counts(_split(spark, sf), "bc1", "bc2")


@query(_SPLIT + "SELECT bc1, array_to_string(list_sort(list(DISTINCT bc2)), ',') AS partners FROM k WHERE n = 1 GROUP BY bc1")
def scan_pair_mask(spark, sf):
    return scan.pair_mask(scan.counts(_split(spark, sf), "bc1", "bc2")).select("bc1", F.array_join("partners", ",").alias("partners"))


@query()
def infix_distances(spark, sf):
    d = infix_distance(part_of(spark, sf, "longchain", "forw_primer"), F.upper("seq"))
    return spread(reads_of(spark, sf).select("read_key", "seq")).select("read_key", d.alias("d")).select("read_key", "d.*")


@query()
def scan_fuzzy(spark, sf):
    found = scan.located_fuzzy(spread(reads_of(spark, sf).select("read_key", "seq")), "seq", part_of(spark, sf, "longchain", "forw_primer"), 0.15)
    return scan.captured(found, 16).select("read_key", "strand", "distance", "barcode")


@query()
def scan_masked_fuzzy(spark, sf):
    mask = part_of(spark, sf, "splitwell", "linker_1") + "N" * 8 + part_of(spark, sf, "splitwell", "linker_2")
    reads = in_layout(spark, sf, "splitwell").select("read_key", "seq")
    return scan.masked_fuzzy(reads, "seq", mask, 0.1).select("read_key", "strand", "barcode")


# Correction --------------------------------------------------------------------


@query(
    _COUNTED
    + f""", w AS {_WL.format('cell16')}, al AS (SELECT variant AS alias, barcode AS true_bc, false AS own FROM (
    SELECT DISTINCT barcode, variant FROM (
      SELECT barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i + 1) AS variant FROM (SELECT barcode, CAST(unnest(range(1, length(barcode) + 1)) AS INT) AS i FROM w), (VALUES ('A'), ('C'), ('G'), ('T')) l(b)
      UNION ALL SELECT barcode, substr(barcode, 1, i - 1) || substr(barcode, i + 1) FROM (SELECT barcode, CAST(unnest(range(1, length(barcode) + 1)) AS INT) AS i FROM w)
      UNION ALL SELECT barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i) FROM (SELECT barcode, CAST(unnest(range(1, length(barcode) + 2)) AS INT) AS i FROM w), (VALUES ('A'), ('C'), ('G'), ('T')) l(b)) WHERE variant <> barcode)
  UNION ALL SELECT barcode, barcode, true FROM w),
g AS (SELECT alias, max(CASE WHEN own THEN true_bc END) AS own_bc, count(*) AS n, min(true_bc) AS any_bc FROM al GROUP BY alias)
SELECT c.barcode, c.count, CASE WHEN own_bc IS NOT NULL THEN own_bc WHEN n = 1 THEN any_bc END AS true_bc,
  CASE WHEN own_bc IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'corrected' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS kind FROM c LEFT JOIN g ON c.barcode = g.alias"""
)
def alias_correct(spark, sf):
    return whitelist.corrected(_counted(spark, sf), "barcode", whitelist.aliases(barcodes_of(spark, sf, "cell16"), 1))


@query(_COUNTED + f"SELECT c.barcode, w.barcode AS true_bc FROM c, {_WL.format('cell16')} w WHERE levenshtein(c.barcode, w.barcode) <= 1")
def alias_generated(spark, sf):
    return whitelist.generated(_counted(spark, sf), "barcode", barcodes_of(spark, sf, "cell16"), 1)


@query(
    _LOCATED
    + f""", e AS (SELECT read_key, pl, k, substr(s, CAST(pl + k AS BIGINT), 16) AS barcode FROM h, range(-4, 5) t(k) WHERE pl + k >= 1),
g AS (SELECT *, row_number() OVER (PARTITION BY read_key ORDER BY abs(k), -k) AS i FROM e WHERE barcode IN (SELECT barcode FROM {_WL.format('cell16')}))
SELECT read_key, barcode, CAST(k AS INT) AS shift, CAST(pl + k + 16 AS INT) AS end_at FROM g WHERE i = 1"""
)
def scan_relocated(spark, sf):
    found = whitelist.relocated(_located(spark, sf), "read_key", "oriented", "after", 16, barcodes_of(spark, sf, "cell16"))
    return found.withColumnRenamed("key", "read_key")


@query(_COUNTED + f"SELECT c.barcode AS a, w.barcode AS b, CAST(levenshtein(c.barcode, w.barcode) AS INT) AS distance FROM c, {_WL.format('cell16')} w WHERE levenshtein(c.barcode, w.barcode) <= 2")
def similarity_join(spark, sf):
    return whitelist.similar(_counted(spark, sf), "barcode", barcodes_of(spark, sf, "cell16"), "barcode", 2)


@query()
def similarity_infix(spark, sf):
    # Windows of the barcode with 4 bases on both sides, as a scan with margins gives them.
    seen = scan.captured(scan.captured(_located(spark, sf), 16), 16, -4, 8, "window").select("window")
    return whitelist.similar_infix(seen, "window", barcodes_of(spark, sf, "cell16"), "barcode", 2)


@query(_COUNTED + _LIMITS + f", s AS (SELECT barcode FROM c, l WHERE count >= threshold) SELECT barcode, 'true' AS role FROM s UNION ALL SELECT barcode, 'global' FROM {_WL.format('cell16')} WHERE barcode NOT IN (SELECT barcode FROM s)")
def demux_roles(spark, sf):
    return whitelist.roles(scan.called(_counted(spark, sf)).where("selected"), barcodes_of(spark, sf, "cell16"))


# Discovery ---------------------------------------------------------------------


@query("""
WITH f AS (SELECT read_key, seq FROM rad_reads ORDER BY read_key LIMIT 10000)
SELECT read_key FROM (SELECT read_key, sum(length(seq)) OVER (ORDER BY read_key) AS s FROM f) WHERE s <= 200000""")
def discover_sample(spark, sf):
    return discover.sampled(reads_of(spark, sf).select("read_key", "seq"), "read_key", "seq", 10_000, 200_000).select("read_key")


@query(
    _COUNTED
    + """, k AS (SELECT DISTINCT whitelist AS catalog, upper(trim(barcode)) AS b FROM whitelist_barcodes),
hits AS (SELECT catalog, count(*) AS catalog_size, CAST(coalesce(sum(c.count), 0) AS BIGINT) AS matched_reads, count(c.barcode) AS matched_distinct FROM k LEFT JOIN c ON c.barcode = k.b GROUP BY catalog)
SELECT catalog, catalog_size, (SELECT CAST(sum(count) AS BIGINT) FROM c) AS extracted_reads, matched_reads, matched_distinct,
  CASE WHEN matched_reads = 0 THEN 'no_hits' WHEN matched_reads < max(matched_reads) OVER () THEN 'other' WHEN count(*) OVER (PARTITION BY matched_reads) > 1 THEN 'tie' ELSE 'matched' END AS status FROM hits"""
)
def discover_catalog_rank(spark, sf):
    lines = table(spark, sf, "whitelist_barcodes").select(F.col("whitelist").alias("catalog"), F.upper(F.trim("barcode")).alias("barcode"))
    return discover.ranked_catalogs(scan.captured(_located(spark, sf), 16), "barcode", lines)


_PARTS = "(SELECT layout || '/' || id AS id, upper(seq) AS seq FROM read_layout WHERE regexp_full_match(upper(seq), '[ACGT]{8,}'))"


def _parts(spark, sf) -> list[tuple[str, str]]:
    rows = discover.usable_parts(table(spark, sf, "read_layout").where("seq is not null").select(F.concat_ws("/", "layout", "id").alias("id"), F.upper("seq").alias("seq")))
    return [(r["id"], r["seq"]) for r in few(rows.orderBy("id"), 10_000)]


@query(f"SELECT p.id, count(*) FILTER (contains(f, p.seq)) AS forward, count(*) FILTER (contains(r, p.seq)) AS reverse FROM (SELECT upper(seq) AS f, {_RC.format('upper(seq)')} AS r FROM rad_reads), {_PARTS} p GROUP BY p.id")
def discover_part_support(spark, sf):
    return discover.part_support(spread(reads_of(spark, sf).select("seq")), "seq", _parts(spark, sf))


@query(f"""
WITH p AS (SELECT id, seq FROM {_PARTS} WHERE starts_with(id, 'splitwell/')),
h AS (SELECT r.read_key, p.id, length(p.seq) AS n, strpos(upper(r.seq), p.seq) AS pl FROM rad_reads r, p WHERE strpos(upper(r.seq), p.seq) > 0),
g AS (SELECT id, lead(id) OVER w AS nid, lead(pl) OVER w - pl - n AS gap FROM h WINDOW w AS (PARTITION BY read_key ORDER BY pl, id, n))
SELECT id AS part, nid AS next_part, count(*) AS reads, CAST(min(gap) AS INT) AS least_gap, CAST(max(gap) AS INT) AS most_gap, min(gap) = max(gap) AS fixed FROM g WHERE gap >= 0 GROUP BY id, nid""")
def discover_spacing(spark, sf):
    return discover.spacing(spread(reads_of(spark, sf).select("read_key", "seq")), "read_key", "seq", [p for p in _parts(spark, sf) if p[0].startswith("splitwell/")])


# Demultiplexing -----------------------------------------------------------------


def _demux(spark, sf, layout: str, mutation: int = 0, least: int = 0, max_error: float | None = None, keep: tuple[str, ...] = ()):
    elements = layout_of(spark, sf, layout)
    lists = {e.whitelist: barcodes_of(spark, sf, e.whitelist) for e in elements if e.cls == "barcode"}
    reads = in_layout(spark, sf, layout).select("read_key", "seq", *keep)
    return dm.demux(reads, elements, lists, mutation, least, max_error=max_error, keep=keep)


_LONG = f"""
WITH a AS (SELECT {sql_part('longchain', 'forw_primer')} || '([ACGTN]{{16}})([ACGTN]{{12}})T*(.*?)(?:(?:' || {sql_part('longchain', 'join_a')} || '|' || {sql_part('longchain', 'join_b')} || '|' || {sql_part('longchain', 'rev_primer')} || ').*)?$' AS p), w AS {_WL.format('cell16')},
o AS (SELECT read_key, upper(seq) AS f, {_RC.format('upper(seq)')} AS r FROM rad_reads WHERE run_id IN (SELECT run_id FROM run_batches WHERE layout = 'longchain')),
h AS (SELECT read_key, p, CASE WHEN regexp_matches(f, p) THEN 'F' ELSE 'R' END AS strand, CASE WHEN regexp_matches(f, p) THEN f ELSE r END AS s FROM o, a WHERE regexp_matches(f, p) OR regexp_matches(r, p)),
d AS (SELECT read_key, strand, regexp_extract(s, p, 1) AS barcode_raw, regexp_extract(s, p, 2) AS umi, CASE strand WHEN 'R' THEN reverse(translate(regexp_replace(regexp_extract(s, p, 3), '[Nn]+', '', 'g'), 'ACGTacgt', 'TGCAtgca')) ELSE regexp_replace(regexp_extract(s, p, 3), '[Nn]+', '', 'g') END AS cdna FROM h)"""


@query(_LONG + "SELECT read_key, strand, barcode_raw, w.barcode, CASE WHEN w.barcode IS NULL THEN 'none' ELSE 'exact' END AS barcode_kind, umi, cdna, w.barcode IS NOT NULL AND length(cdna) >= 30 AS passing FROM d LEFT JOIN w ON w.barcode = barcode_raw")
def demux_exact(spark, sf):
    return _demux(spark, sf, "longchain", 0, 30)


_ONE = f"""
SELECT DISTINCT barcode AS true_bc, variant AS alias FROM ({_POINT.format('w')})
UNION SELECT barcode, substr(barcode, 1, i - 1) || substr(barcode, i + 1) FROM (SELECT barcode, CAST(unnest(range(1, length(barcode) + 1)) AS INT) AS i FROM w)
UNION SELECT barcode, substr(barcode, 1, i - 1) || b || substr(barcode, i) FROM (SELECT barcode, CAST(unnest(range(1, length(barcode) + 2)) AS INT) AS i FROM w), (VALUES ('A'), ('C'), ('G'), ('T')) l(b)"""
_FIXED = (
    _LONG
    + f""", x AS (SELECT * FROM ({_ONE}) WHERE length(alias) = 16), g AS (SELECT alias, max(CASE WHEN alias = true_bc THEN true_bc END) AS own_bc, count(*) AS n, min(true_bc) AS any_bc FROM x GROUP BY alias),
c AS (SELECT read_key, strand, barcode_raw, CASE WHEN own_bc IS NOT NULL THEN own_bc WHEN n = 1 THEN any_bc END AS barcode,
  CASE WHEN own_bc IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'corrected' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS barcode_kind, umi, cdna FROM d LEFT JOIN g ON g.alias = barcode_raw)"""
)


@query(_FIXED + "SELECT *, barcode IS NOT NULL AND length(cdna) >= 30 AS passing FROM c")
def demux_corrected(spark, sf):
    return _demux(spark, sf, "longchain", 1, 30)


@query()
def demux_fuzzy(spark, sf):
    return _demux(spark, sf, "longchain", 1, 30, 0.15)


@query(
    _FIXED
    + """SELECT 1 AS class_id, barcode AS true_bc, count(*) FILTER (barcode_kind = 'exact') AS raw_count, count(*) FILTER (barcode_kind IN ('exact', 'corrected')) AS total_count, count(*) FILTER (barcode_kind = 'corrected') AS corrected_count,
  count(*) FILTER (strand = 'F') AS forw_count, count(*) FILTER (strand = 'R') AS rev_count, CAST(0 AS BIGINT) AS forw_concat_count, CAST(0 AS BIGINT) AS rev_concat_count, count(*) FILTER (length(cdna) < 30) AS filtered_count,
  count(*) FILTER (barcode_kind = 'exact') >= 2 OR count(*) FILTER (barcode_kind = 'corrected') / greatest(count(*), 1) <= 0.8 AS trusted FROM c WHERE barcode IS NOT NULL GROUP BY barcode"""
)
def demux_counters(spark, sf):
    d = _demux(spark, sf, "longchain", 1, 30).where("barcode is not null")
    d = d.select(F.lit(1).alias("class_id"), F.col("barcode").alias("true_bc"), F.col("barcode_kind").alias("kind"), "strand", F.lit(1).alias("units"), F.col("passing").alias("kept"))
    return whitelist.trusted(whitelist.counters(d))


@query()
def demux_unit_counters(spark, sf):
    elements = layout_of(spark, sf, "longchain")
    joins = [e.seq for e in elements if e.cls == "linker"]
    lists = {e.whitelist: barcodes_of(spark, sf, e.whitelist) for e in elements if e.cls == "barcode"}
    d = dm.demux_units(in_layout(spark, sf, "longchain").select("read_key", "seq"), elements, lists, joins, 1, 30, max_error=0.15).where("barcode is not null")
    d = d.select(F.lit(1).alias("class_id"), F.col("barcode").alias("true_bc"), F.col("barcode_kind").alias("kind"), "strand", "units", F.col("passing").alias("kept"))
    return whitelist.trusted(whitelist.counters(d))


@query(_FIXED + "SELECT (SELECT count(*) FROM o) AS total_reads, count(*) AS parsed_reads, count(*) FILTER (barcode IS NOT NULL AND length(cdna) >= 30) AS demultiplexed_reads, round(100.0 * count(*) FILTER (barcode IS NOT NULL AND length(cdna) >= 30) / (SELECT count(*) FROM o), 6) AS rate_percent FROM c")
def demux_stats(spark, sf):
    s = dm.run_stats(in_layout(spark, sf, "longchain"), _demux(spark, sf, "longchain", 1, 30))
    return s.withColumn("rate_percent", F.round("rate_percent", 6))


@query(_FIXED + "SELECT c.read_key, coalesce(seq_id, '') || '-' || strand || ' TS:A:' || CASE strand WHEN 'F' THEN '+' ELSE '-' END || ' CB:Z:' || barcode || ' CR:Z:' || barcode_raw || ' UB:Z:' || umi AS header FROM c JOIN rad_reads r ON r.read_key = c.read_key WHERE barcode IS NOT NULL")
def demux_headers(spark, sf):
    d = _demux(spark, sf, "longchain", 1, keep=("seq_id",)).where("barcode is not null")
    return d.select("read_key", dm.header(F.col("seq_id"), F.col("strand"), F.col("barcode"), F.col("barcode_raw"), F.col("umi")).alias("header"))


_JOINT = f"""
WITH a AS (SELECT {sql_part('splitwell', 'forw_primer')} || '([ACGTN]{{8}})' || {sql_part('splitwell', 'linker_1')} || '([ACGTN]{{8}})' || {sql_part('splitwell', 'linker_2')} || '([ACGTN]{{10}})T*' AS p), w AS {_WL.format('well8')},
o AS (SELECT read_key, upper(seq) AS f, {_RC.format('upper(seq)')} AS r FROM rad_reads WHERE run_id IN (SELECT run_id FROM run_batches WHERE layout = 'splitwell')),
h AS (SELECT read_key, p, CASE WHEN regexp_matches(f, p) THEN f ELSE r END AS s FROM o, a WHERE regexp_matches(f, p) OR regexp_matches(r, p)),
d AS (SELECT read_key, regexp_extract(s, p, 1) AS barcode, regexp_extract(s, p, 2) AS barcode_2, regexp_extract(s, p, 3) AS umi FROM h)
SELECT read_key, barcode, barcode_2, umi FROM d WHERE barcode IN (SELECT barcode FROM w) AND barcode_2 IN (SELECT barcode FROM w)"""


@query(f"SELECT j.* FROM ({_JOINT}) j SEMI JOIN ({_SPLIT} SELECT bc1, bc2 FROM k WHERE n = 1 GROUP BY bc1, bc2 HAVING count(*) >= 2) p ON p.bc1 = j.barcode AND p.bc2 = j.barcode_2")
def demux_joint_mask(spark, sf):
    # The allowed cells are the pairs that a scan has met twice or more.
    mask = scan.counts(_split(spark, sf), "bc1", "bc2").where(F.col("count") >= 2).select("bc1", "bc2")
    return dm.allowed(_demux(spark, sf, "splitwell").where("barcode is not null and barcode_2 is not null"), "barcode", "barcode_2", mask).select("read_key", "barcode", "barcode_2", "umi")


# Slides --------------------------------------------------------------------------

_UNIQUE_MAP = "(SELECT * FROM slide_map WHERE barcode IN (SELECT barcode FROM slide_map GROUP BY barcode HAVING count(*) = 1))"
_PLACED = f"""
WITH m AS {_UNIQUE_MAP}, t AS (SELECT read_key, seq_comment, {_TAG.format('CB')} AS cb, len(regexp_extract_all(seq_comment, '(?:^|[ \\t])(CB:Z:)')) > 1 AS twice FROM rad_reads),
j AS (SELECT t.*, m.barcode AS b, array_row AS r, array_col AS c, in_tissue, cell_id FROM t LEFT JOIN m ON m.barcode = t.cb),
s AS (SELECT *, CASE WHEN cb IS NULL OR cb = '' THEN 'missing_barcode' WHEN twice THEN 'invalid_tags' WHEN b IS NULL THEN 'unknown_barcode' WHEN r IS NULL OR c IS NULL THEN 'missing_coordinates' {{}}ELSE 'assigned' END AS status FROM j)"""


def _slide(spark, sf):
    """Spots whose barcode occurs once; the others could not be told apart."""
    m = table(spark, sf, "slide_map")
    once = m.groupBy("barcode").count().where("count = 1").select("barcode")
    return m.join(once, "barcode", "left_semi")


@query(_PLACED.format("") + "SELECT read_key, cb, status, CASE WHEN status = 'assigned' THEN printf('s_004um_%05d_%05d-1', CAST(floor(r * 2 / 4) AS INT), CAST(floor(c * 2 / 4) AS INT)) END AS unit FROM s")
def spatial_assign_map(spark, sf):
    return spatial.assigned(reads_of(spark, sf).select("read_key", "seq_comment"), "seq_comment", _slide(spark, sf), size=4).select("read_key", "cb", "status", "unit")


@query(_PLACED.format("WHEN coalesce(in_tissue, 0) <> 1 THEN 'outside_tissue' WHEN cell_id IS NULL THEN 'missing_cell' ") + "SELECT status, count(*) AS n FROM s GROUP BY status")
def spatial_status_counts(spark, sf):
    placed = spatial.assigned(reads_of(spark, sf).select("read_key", "seq_comment"), "seq_comment", _slide(spark, sf), unit="cell", tissue_only=True)
    return placed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH w AS {_WL.format('well8')}, x AS (SELECT barcode, CAST(row_number() OVER (ORDER BY barcode) - 1 AS INT) AS i FROM w), p AS ({_JOINT})
SELECT read_key, x.i AS array_col, y.i AS array_row, 'assigned' AS status FROM p JOIN x ON x.barcode = p.barcode JOIN x y ON y.barcode = p.barcode_2""")
def spatial_assign_axes(spark, sf):
    places = rd.numbered(barcodes_of(spark, sf, "well8"), ["barcode"], "place").withColumn("place", (F.col("place") - 1).cast("int"))
    d = _demux(spark, sf, "splitwell").where("barcode is not null and barcode_2 is not null").withColumn("cb", F.concat_ws("-", "barcode", "barcode_2"))
    axis = lambda c: places.select("barcode", F.col("place").alias(c))
    return spatial.assigned_by_axes(d.select("read_key", "cb"), "cb", axis("array_col"), axis("array_row"), 8).select("read_key", "array_col", "array_row", "status")


@query("SELECT array_row // 8 AS region_row, array_col // 8 AS region_col, count(*) AS occupied_2um_spots, count(*) >= 32 AS selected FROM (SELECT DISTINCT CAST(array_row AS BIGINT) AS array_row, CAST(array_col AS BIGINT) AS array_col FROM slide_map WHERE array_row IS NOT NULL AND array_col IS NOT NULL) GROUP BY 1, 2")
def hd_occupancy(spark, sf):
    return spatial.occupied_regions(table(spark, sf, "slide_map"))


@query("SELECT barcode, array_row, array_col, printf('s_008um_%05d_%05d-1', CAST(floor(array_row * 2 / 8) AS INT), CAST(floor(array_col * 2 / 8) AS INT)) AS spot FROM slide_map WHERE array_row IS NOT NULL AND array_col IS NOT NULL")
def bin_coordinates(spark, sf):
    m = table(spark, sf, "slide_map").where("array_row is not null and array_col is not null")
    return m.select("barcode", "array_row", "array_col", spatial.spot_name(F.col("array_row"), F.col("array_col"), 8).alias("spot"))


@query("""
WITH meta AS (SELECT array_row, array_col, max(1 - in_tissue) AS in_tissue, CAST(NULL AS VARCHAR) AS cell_id, 1 AS there FROM slide_map WHERE in_tissue = 0 AND array_row IS NOT NULL AND array_col IS NOT NULL GROUP BY 1, 2)
SELECT m.barcode, m.array_row, m.array_col, CAST(CASE WHEN there = 1 THEN meta.in_tissue ELSE m.in_tissue END AS INT) AS in_tissue, CASE WHEN there = 1 THEN meta.cell_id ELSE m.cell_id END AS cell_id
FROM slide_map m LEFT JOIN meta ON meta.array_row = m.array_row AND meta.array_col = m.array_col""")
def spatial_overlay(spark, sf):
    m = table(spark, sf, "slide_map").select("barcode", "array_row", "array_col", "in_tissue", "cell_id")
    meta = m.where("in_tissue = 0 and array_row is not null and array_col is not null").groupBy("array_row", "array_col").agg(F.max(1 - F.col("in_tissue")).cast("int").alias("in_tissue")).withColumn("cell_id", F.lit(None).cast("string"))
    return spatial.overlaid(m, meta)


# Reformatting -----------------------------------------------------------------------

_TAGS = f"(SELECT read_key, coalesce(seq_id, '') AS id, seq_id, seq_comment, seq, nullif({_TAG.format('CB')}, '') AS cb, nullif({_TAG.format('UB')}, '') AS ub, nullif({_TAG.format('BC')}, '') AS bc FROM rad_reads)"


@query(f"SELECT read_key, concat_ws('_', id, cb, ub) AS header FROM {_TAGS}")
def reformat_collapsed(spark, sf):
    return reads_of(spark, sf).select("read_key", reformat.collapsed_header(F.col("seq_id"), F.col("seq_comment")).alias("header"))


_PLAIN = "NOT regexp_matches(coalesce(coalesce(bc, cb), '') || coalesce(ub, ''), '[\\s|=,]') AND NOT regexp_matches(id, '[\\s|]')"


@query(f"SELECT read_key, concat_ws('|', id, 'BARCODE=' || coalesce(bc, cb), 'UMI=' || ub) AS header FROM {_TAGS} WHERE {_PLAIN}")
def reformat_presto(spark, sf):
    r = reads_of(spark, sf)
    tags = [F.coalesce(dna.tag(F.col("seq_comment"), t), F.lit("")) for t in ("CB", "UB", "BC")]
    # Packed comments hold reserved characters, which the header refuses; such reads are set aside first.
    plain = r.where(~F.when(tags[2] != "", tags[2]).otherwise(tags[0]).rlike("[\\s|=,]") & ~tags[1].rlike("[\\s|=,]") & ~F.coalesce("seq_id", F.lit("")).rlike("[\\s|]"))
    return plain.select("read_key", reformat.presto_header(F.col("seq_id"), F.col("seq_comment")).alias("header"))


@query(f"SELECT read_key, '>' || concat_ws(chr(9), id, nullif(seq_comment, '')) || chr(10) || seq AS record FROM {_TAGS}")
def reformat_fasta(spark, sf):
    return reads_of(spark, sf).select("read_key", reformat.fasta(F.col("seq_id"), F.col("seq_comment"), F.col("seq")).alias("record"))


@query(f"SELECT cb, count(*) AS n FROM {_TAGS} WHERE cb IS NOT NULL GROUP BY cb")
def split_counts(spark, sf):
    cb = dna.tag(F.col("seq_comment"), "CB")
    return reads_of(spark, sf).select(F.when(cb != "", cb).alias("cb")).where("cb is not null").groupBy("cb").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS records_read, count(cb) AS written, count(*) - count(cb) AS skipped_missing_cb, count(DISTINCT cb) AS split_barcodes FROM {_TAGS}")
def reformat_stats(spark, sf):
    return reformat.stats(reads_of(spark, sf), "seq_comment")


# Reads of several units ---------------------------------------------------------------


@query(f"""
WITH j AS (SELECT string_agg(upper(seq), '|' ORDER BY length(seq) DESC, upper(seq)) AS p FROM read_layout WHERE layout = 'longchain' AND class = 'linker'),
s AS (SELECT read_key, list_filter(regexp_split_to_array(upper(seq), p), lambda x: x <> '') AS xs FROM rad_reads, j)
SELECT read_key, CAST(generate_subscripts(xs, 1) AS BIGINT) AS segment, CAST(len(xs) AS BIGINT) AS units, unnest(xs) AS part FROM s""")
def concat_segments(spark, sf):
    joins = [e.seq for e in layout_of(spark, sf, "longchain") if e.cls == "linker"]
    return concat.segments(spread(reads_of(spark, sf).select("read_key", "seq")), "read_key", "seq", joins).withColumnRenamed("key", "read_key")


@query()
def concat_segments_both(spark, sf):
    joins = [e.seq for e in layout_of(spark, sf, "longchain") if e.cls == "linker"]
    return concat.segments_both(spread(reads_of(spark, sf).select("read_key", "seq")), "read_key", "seq", joins).withColumnRenamed("key", "read_key")


@query(f"""
WITH j AS (SELECT {sql_part('longchain', 'forw_primer')} AS p, {sql_part('longchain', 'rev_primer')} AS q),
o AS (SELECT read_key, upper(seq) AS s, p, q FROM rad_reads, j WHERE strpos(upper(seq), p) > 0),
e AS (SELECT read_key, CAST(strpos(s, p) + length(p) - 1 AS INT) AS left_end, substr(s, strpos(s, p) + length(p)) AS tail, q FROM o),
f AS (SELECT read_key, left_end, CAST(CASE WHEN strpos(tail, q) > 0 THEN left_end + strpos(tail, q) - 1 ELSE left_end + length(tail) END AS INT) AS right_start, CASE WHEN regexp_matches(tail, 'T{{8}}') THEN 'bounded' ELSE 'insert' END AS left_kind, CASE WHEN strpos(tail, q) > 0 THEN 'bounded' ELSE 'insert' END AS right_kind FROM e)
SELECT *, CAST(CASE WHEN left_kind = right_kind THEN (left_end + right_start) // 2 WHEN left_kind = 'bounded' THEN least(left_end + 8, right_start) ELSE greatest(right_start - 8, left_end) END AS BIGINT) AS cut,
  CAST(CASE WHEN left_kind || right_kind = 'insertinsert' THEN left_end WHEN left_kind = right_kind THEN (left_end + right_start) // 2 WHEN left_kind = 'bounded' THEN left_end + 6 ELSE greatest(left_end, right_start - 10) END AS BIGINT) AS lo,
  CAST(CASE WHEN left_kind || right_kind = 'insertinsert' THEN right_start WHEN left_kind = right_kind THEN (left_end + right_start) // 2 WHEN left_kind = 'bounded' THEN least(right_start, left_end + 10) ELSE least(right_start, right_start - 6) END AS BIGINT) AS hi,
  CASE WHEN left_kind || right_kind = 'insertinsert' THEN 'midpoint' ELSE 'geometry' END AS kind FROM f""")
def concat_boundary_table(spark, sf):
    """Where units meet, by what lies beside the first primer of each read and the closing primer behind it."""
    p, q = (part_of(spark, sf, "longchain", x) for x in ("forw_primer", "rev_primer"))
    s = spread(reads_of(spark, sf).select("read_key", F.upper("seq").alias("s"))).where(F.locate(p, F.col("s")) > 0)
    e = s.select("read_key", (F.locate(p, F.col("s")) + len(p) - 1).alias("left_end"), F.expr(f"substring(s, locate('{p}', s) + {len(p)})").alias("tail"))
    closed = F.locate(q, F.col("tail"))
    edges = e.select(
        "read_key", "left_end", F.when(closed > 0, F.col("left_end") + closed - 1).otherwise(F.col("left_end") + F.length("tail")).alias("right_start"),
        F.when(F.col("tail").rlike("T{8}"), "bounded").otherwise("insert").alias("left_kind"), F.when(closed > 0, "bounded").otherwise("insert").alias("right_kind"),
    )
    return concat.junction_table(edges)


@query()
def concat_units(spark, sf):
    reads = spread(reads_of(spark, sf).select("read_key", "seq"))
    units = hmm.segmented(reads, "read_key", "seq", part_of(spark, sf, "longchain", "forw_primer"), part_of(spark, sf, "longchain", "rev_primer"))
    return units.withColumnRenamed("key", "read_key")


# Streaming -----------------------------------------------------------------------------


@query("SELECT run_id, count(*) AS count FROM rad_reads GROUP BY run_id")
def stream_counts(spark, sf):
    # Any table of reads will do as a stream; its folder is the source and its file the first micro-batch.
    schema = reads_of(spark, sf).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/rad_reads.parquet*")
    return run_to_end(barcode_counts(stream, "run_id"), "runs")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
