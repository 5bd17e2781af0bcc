"""Queries of sources, sinks, whole-table operations and error-tolerant alignment, with their SQL equivalents.

Queries of sinks write whole tables into the scratch folder and read them again.
"""

from __future__ import annotations

import functools
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import dna, quality
from readloom.functions import sql as sql_functions
from readloom.operators import concat, reformat, scan, spatial, whitelist
from readloom.operators import demux as dm
from readloom.operators import reads as rd
from readloom.operators.align import infix_distance
from readloom.plans import read_queries as rq
from readloom.plans import sinks
from readloom.plans.core_queries import table
from readloom.plans.scratch import scratch_root
from readloom.plans.shape import spread
from readloom.plans.workflows import auto_whitelist, spatial_reformatted
from readloom.sources import fastq as fq
from readloom.streaming.counts import late_counts, run_to_end

_QUERIES: dict[str, rq.Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: rq.Query) -> rq.Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, which must be mounted on all machines, since FASTQ files are opened by path."""
    root = urlparse(scratch_root(spark))
    if root.scheme not in ("", "file"):
        raise ValueError("FASTQ files are read by path: spark.checkpoint.dir must be a mounted folder for these queries")
    os.makedirs(root.path, exist_ok=True)
    return os.path.join(root.path, f"{name}-{uuid.uuid4().hex}")


# Sources and sinks -----------------------------------------------------------------

_WRITABLE = "seq_id IS NOT NULL AND qual IS NOT NULL AND length(qual) = length(seq) AND NOT regexp_matches(concat(seq_id, coalesce(seq_comment, ''), seq, qual), '[\\r\\n]')"
#: Ids without blanks and not empty come back as they were; the rest of a header is its comment.
_PLAIN_ID = "NOT regexp_matches(seq_id, '\\s') AND seq_id <> '' AND NOT regexp_matches(coalesce(seq_comment, ''), '\\t')"
_SOUND = f"(SELECT * FROM rad_reads WHERE {_WRITABLE} AND {_PLAIN_ID})"


def _sound(spark, sf) -> DataFrame:
    r = rq.reads_of(spark, sf).where("seq_id is not null and qual is not null and length(qual) = length(seq)")
    text = F.concat("seq_id", F.coalesce("seq_comment", F.lit("")), "seq", "qual")
    return r.where(~text.rlike("[\r\n]") & ~F.col("seq_id").rlike(r"\s") & (F.col("seq_id") != "") & ~F.coalesce("seq_comment", F.lit("")).rlike("\t"))


@query(f"SELECT row_number() OVER (ORDER BY read_key) AS place, seq_id, nullif(seq_comment, '') AS seq_comment, seq, qual, CAST(length(seq) AS INT) AS length FROM {_SOUND}")
def fastq_round_trip(spark, sf):
    path = _folder(spark, "fastq")
    fq.write_fastq_parts(_sound(spark, sf).select("read_key", "seq_id", "seq_comment", "seq", "qual"), f"file://{path}")
    back = fq.read_fastq(spark, path).select("read_key", "seq_id", "seq_comment", "seq", "qual", "length")
    return rd.numbered(back, ["read_key"], "place").select("place", "seq_id", "seq_comment", "seq", "qual", "length")


@query(f"SELECT row_number() OVER (ORDER BY t, read_key) AS read_key, seq_id, seq FROM (SELECT 0 AS t, * FROM {_SOUND} WHERE min_q >= 10 UNION ALL SELECT 1, * FROM {_SOUND} WHERE min_q < 10)")
def fastq_append(spark, sf):
    path, reads = _folder(spark, "append") + ".fastq.gz", _sound(spark, sf).select("read_key", "seq_id", "seq_comment", "seq", "qual", "min_q")
    fq.write_fastq(reads.where("min_q >= 10"), path)
    fq.write_fastq(reads.where("min_q < 10"), path, append=True)
    return fq.read_fastq(spark, path).select("read_key", "seq_id", "seq")


@query("""
SELECT count(*) FILTER (seq_id IS NULL) AS missing_ids, count(*) FILTER (qual IS NULL) AS missing_qualities, count(*) FILTER (length(qual) <> length(seq)) AS lengths_that_differ,
  count(*) FILTER (coalesce(regexp_matches(seq_id, '[\\r\\n]'), false) OR coalesce(regexp_matches(seq_comment, '[\\r\\n]'), false) OR regexp_matches(seq, '[\\r\\n]') OR coalesce(regexp_matches(qual, '[\\r\\n]'), false)) AS line_breaks FROM rad_reads""")
def fastq_rejections(spark, sf):
    return fq.rejections(rq.reads_of(spark, sf))


@query(f"SELECT chunk, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, min(i) AS first_key FROM (SELECT seq, i, (i - 1) // 1000 AS chunk FROM (SELECT seq, row_number() OVER (ORDER BY read_key) AS i FROM {_SOUND})) GROUP BY chunk")
def fastq_pull_stream(spark, sf):
    path = _folder(spark, "pulled") + ".fastq.gz"
    fq.write_fastq(_sound(spark, sf).select("read_key", "seq_id", "seq_comment", "seq", "qual"), path)
    stream, kind = fq.FastqStream(spark, path), "chunk long, reads long, bases long, first_key long"
    out, held, chunk, before = f"{scratch_root(spark)}/chunks-{uuid.uuid4().hex}", [], 0, 0

    def summed():
        """Adds up the chunks in hand, so that the driver never holds more than a few."""
        every = functools.reduce(DataFrame.unionAll, held).coalesce(1)
        every.groupBy("chunk").agg(F.count(F.lit(1)).alias("reads"), F.sum("length").alias("bases"), F.min("read_key").alias("first_key")).write.mode("append").parquet(out)
        held.clear()

    while (rows := stream.next(1000)) is not None:
        held.append(rows.select(F.lit(chunk).cast("long").alias("chunk"), F.length("seq").alias("length"), "read_key"))
        chunk += 1
        if len(held) == 64 or stream.letters - before > 8_000_000:
            summed()
            before = stream.letters
    if held:
        summed()
    stream.close()
    return spark.read.schema(kind).parquet(out) if chunk else spark.createDataFrame([], kind)


@query(f"SELECT row_number() OVER (ORDER BY read_key) AS read_key, seq_id, nullif(seq_comment, '') AS seq_comment, seq FROM {_SOUND} ")
def fasta_round_trip(spark, sf):
    path = _folder(spark, "fasta")
    reads = _sound(spark, sf)
    reads.select("read_key", reformat.fasta(F.col("seq_id"), F.col("seq_comment"), F.col("seq")).alias("value")).repartitionByRange("read_key").sortWithinPartitions("read_key").select("value").write.option("compression", "gzip").text(f"file://{path}")
    back = fq.read_fastq(spark, path).where("qual is null").select("read_key", "seq_id", "seq_comment", "seq")
    return rd.numbered(back, ["read_key"], "read_key")


@query(f"SELECT read_key, seq_id, seq_comment, seq, qual FROM {_SOUND} WHERE read_key <= (SELECT quantile_disc(read_key, 0.5) FROM {_SOUND})")
def fastq_key_bound(spark, sf):
    """Keys of the file count its records; a bound on them is pushed into the reader."""
    path, reads = _folder(spark, "bound") + ".fastq.gz", _sound(spark, sf).select("read_key", "seq_id", "seq_comment", "seq", "qual")
    numbered = rd.compact(reads.withColumn("old_key", F.col("read_key")))
    fq.write_fastq(numbered, path)
    half = numbered.agg(F.expr("percentile_disc(0.5) within group (order by read_key)")).scalar()
    most = numbered.select(half.alias("m")).first()["m"]
    kept = fq.read_fastq(spark, path).where(F.col("read_key") <= most).select("read_key", "seq")
    old = numbered.select(F.col("read_key").alias("k"), "old_key", "seq_id", "seq_comment", "qual")
    return kept.join(old, F.col("read_key") == F.col("k")).select(F.col("old_key").alias("read_key"), "seq_id", "seq_comment", "seq", "qual")


_SUMMARIES = """
SELECT read_key, seq_id, seq_comment, seq, qual, CAST(length(seq) AS INT) AS length, round(list_avg(v), 6) AS mean_q, CAST(list_min(v) AS INT) AS min_q, round(len(list_filter(v, lambda x: x >= 20)) / nullif(len(v), 0), 6) AS frac_q20
FROM (SELECT *, CASE WHEN qual <> '' THEN list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) END AS v FROM rad_reads)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean_q", "frac_q20")})


@query(_SUMMARIES)
def reads_as_reads(spark, sf):
    """A read table of a table with other names."""
    other = spread(rq.reads_of(spark, sf)).select(F.col("read_key").alias("k"), F.col("seq_id").alias("id"), F.col("seq_comment").alias("note"), F.col("seq").alias("bases"), F.col("qual").alias("q"), "run_id")
    return _rounded(rd.as_reads(other, "id", "bases", "q", "note", "k"))


@query(_SUMMARIES + " WHERE qual IS NULL OR length(qual) = length(seq)")
def reads_save_load(spark, sf):
    path = f"{scratch_root(spark)}/saved-{uuid.uuid4().hex}"
    r = spread(rq.reads_of(spark, sf)).where("qual is null or length(qual) = length(seq)").select("read_key", "seq_id", "seq_comment", "seq", "qual")
    sinks.save(rd.with_summaries(r).select(*rd.CORE), path)
    return _rounded(sinks.load(spark, path).select(*rd.CORE))


_SAFE_CB = f"(SELECT * FROM (SELECT *, nullif({rq._TAG.format('CB')}, '') AS cb FROM {_SOUND}) WHERE regexp_full_match(cb, '{sinks.SAFE[1:-1]}'))"


@query(f"SELECT cb, row_number() OVER (PARTITION BY cb ORDER BY read_key) AS i, seq_id, seq, qual FROM {_SAFE_CB}")
def split_sink(spark, sf):
    """Records by barcode, as they lie in the files of each."""
    path, cb = f"{scratch_root(spark)}/split-{uuid.uuid4().hex}", dna.tag(F.col("seq_comment"), "CB")
    sinks.split_by_barcode(_sound(spark, sf).where((cb != "") & cb.rlike(sinks.SAFE)), path)
    files = spark.read.text(f"{path}/CB=*/", wholetext=True).select(F.col("value"), F.input_file_name().alias("f"))
    lines = files.select(F.url_decode(F.regexp_extract("f", "/CB=([^/]+)/", 1)).alias("cb"), "f", F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("n", "line"))
    four = lines.groupBy("cb", "f", F.floor(F.col("n") / 4).alias("r")).agg(*(F.max(F.when(F.col("n") % 4 == i, F.col("line"))).alias(c) for i, c in ((0, "head"), (1, "seq"), (3, "qual"))))
    named = four.withColumn("seq_id", F.substring_index(F.expr("substring(head, 2)"), " ", 1))
    return rd.numbered(named, ["cb", "f", "r"], "m").withColumn("i", F.col("m") - F.min("m").over(rd.Window.partitionBy("cb")) + 1).select("cb", "i", "seq_id", "seq", "qual")


@query(f"SELECT read_key, seq_id || '_x' AS seq_id, nullif(seq_comment, '') AS seq_comment, seq, qual FROM (SELECT * REPLACE (row_number() OVER (ORDER BY read_key) AS read_key) FROM {_SOUND})")
def fastq_rewrite(spark, sf):
    """A file rewritten in place with other ids."""
    path = _folder(spark, "rewritten") + ".fastq.gz"
    fq.write_fastq(_sound(spark, sf).select("read_key", "seq_id", "seq_comment", "seq", "qual"), path)
    sinks.rewrite(spark, path, lambda r: r.withColumn("seq_id", F.concat("seq_id", F.lit("_x"))))
    return fq.read_fastq(spark, path).select("read_key", "seq_id", "seq_comment", "seq", "qual")


# Whole-table operations ---------------------------------------------------------------


@query("SELECT read_key, CASE WHEN qual IS NULL THEN NULL WHEN qual = '' THEN '' ELSE array_to_string(list_transform(string_split(qual, ''), lambda c: chr(ascii(c) + 31)), '') END AS moved, qual AS back FROM rad_reads WHERE qual IS NULL OR NOT regexp_matches(qual, '[`-~]')")
def reads_recode_quality(spark, sf):
    r = rq.reads_of(spark, sf).where("qual is null or not qual rlike '[`-~]'").withColumn("moved", quality.recoded(F.col("qual"), 64))
    return r.select("read_key", "moved", quality.from_offset(F.col("moved"), 64).alias("back"))


@query("SELECT row_number() OVER (ORDER BY read_key) AS read_key, seq_id, seq, sample_id FROM rad_reads WHERE mean_q >= 30")
def reads_compact(spark, sf):
    return rd.compact(rq.reads_of(spark, sf).where("mean_q >= 30").select("read_key", "seq_id", "seq", "sample_id"))


@query("SELECT row_number() OVER (ORDER BY t, read_key, e) AS ordinal, read_key, seq_id FROM rad_reads, range(2) a(t), range(3) b(e) WHERE min_q < 3")
def reads_repeated(spark, sf):
    return rd.repeated(rq.reads_of(spark, sf).where("min_q < 3").select("read_key", "seq_id"), times=2, each=3)


@query("SELECT read_key, seq_id = 'r' AS eq, seq_id <> 'r' AS ne, seq_id < 'r' AS lt, seq_id <= 'r' AS le, seq_id > 'r' AS gt, seq_id >= 'r' AS ge FROM rad_reads")
def reads_compare_ids(spark, sf):
    each = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return rq.reads_of(spark, sf).select("read_key", *(rd.id_is("seq_id", op, "r").alias(n) for n, op in each.items()))


@query("SELECT read_key, seq_id, row_number() OVER (ORDER BY seq_id DESC NULLS LAST, read_key) AS place FROM rad_reads")
def reads_sort_ids_decreasing(spark, sf):
    return rd.sorted_by_id(rq.reads_of(spark, sf).select("read_key", "seq_id"), decreasing=True)


@query("SELECT read_key, seq_id, row_number() OVER (ORDER BY seq_id, read_key) AS place FROM rad_reads WHERE seq_id IS NOT NULL")
def reads_sort_ids_known(spark, sf):
    return rd.sorted_by_id(rq.reads_of(spark, sf).select("read_key", "seq_id"), na_last=None)


@query("""
WITH w AS (SELECT seq_id, min(-read_key) AS o FROM rad_reads WHERE mean_q < 15 AND seq_id <> '' GROUP BY seq_id)
SELECT row_number() OVER (ORDER BY o, read_key) AS place, read_key, seq_id, sample_id FROM (SELECT r.*, o FROM rad_reads r JOIN w ON w.seq_id = r.seq_id)""")
def reads_ordered_join(spark, sf):
    r = rq.reads_of(spark, sf)
    wanted = r.where("mean_q < 15 and seq_id <> ''").groupBy("seq_id").agg(F.min(-F.col("read_key")).alias("o"))
    return rd.ordered_join(r.select("read_key", "seq_id", "sample_id"), wanted, "seq_id", "o")


@query("SELECT read_key, seq_id, length(seq) AS bases, coalesce(sample_id, '') || '/' || run_id AS label FROM rad_reads")
def reads_annotate(spark, sf):
    r = rd.annotate(rq.reads_of(spark, sf), bases=F.length("seq").cast("long"), label=F.concat_ws("/", F.coalesce("sample_id", F.lit("")), "run_id"))
    return r.select("read_key", "seq_id", "bases", "label")


@query(f"SELECT read_key, {rq._RC.format('seq')} AS rc, {rq._TAG.format('CB')} AS cb, coalesce(regexp_full_match(seq_id, '{dna.UUID}'), false) AS uuid FROM rad_reads")
def sql_udfs(spark, sf):
    """The functions as they are registered for SQL."""
    sql_functions.register(spark)
    rq.reads_of(spark, sf).createOrReplaceTempView("_reads_of_sql_udfs")
    return spark.sql("SELECT read_key, rl_revcomp(seq) AS rc, rl_tag(seq_comment, 'CB') AS cb, coalesce(rl_is_uuid(seq_id), false) AS uuid FROM _reads_of_sql_udfs")


@query("SELECT read_key, 'x_' || seq_id || '_B1_U1' AS seq_id, 'B1' AS cb, 'U1' AS ub FROM rad_reads WHERE seq_id IS NOT NULL UNION ALL SELECT read_key, seq_id, NULL, NULL FROM rad_reads WHERE seq_id IS NOT NULL AND len(string_split(seq_id, '_')) < 3")
def reformat_collapsed_input(spark, sf):
    """Fields of collapsed ids; ids with fewer than three fields have none."""
    r = rq.reads_of(spark, sf).where("seq_id is not null").select("read_key", "seq_id")
    made = r.select("read_key", F.concat(F.lit("x_"), "seq_id", F.lit("_B1_U1")).alias("seq_id")).unionAll(r.where(F.size(F.split("seq_id", "_")) < 3))
    cb, ub = reformat.barcode_and_umi(F.col("seq_id"), F.lit(None).cast("string"), collapsed_input=True)
    return made.select("read_key", "seq_id", cb.alias("cb"), ub.alias("ub"))


@query("SELECT sequenced_at::DATE AS day, run_id, count(*) AS count FROM rad_reads GROUP BY ALL")
def stream_late_counts(spark, sf):
    """Counts by day and run of a stream with a watermark."""
    schema = rq.reads_of(spark, sf).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/rad_reads.parquet*")
    timed = stream.withColumn("at", F.col("sequenced_at").cast("timestamp"))
    done = run_to_end(late_counts(timed, "at", "run_id", "1 day", "3650 days"), "late", "complete")
    return done.select(F.col("window.start").cast("date").alias("day"), "run_id", "count")


# Slides ----------------------------------------------------------------------------------


@query(rq._COUNTED + "SELECT c.barcode, c.count, array_row, array_col FROM c JOIN slide_map m ON m.barcode = c.barcode")
def scan_slide_membership(spark, sf):
    return rq._counted(spark, sf).join(table(spark, sf, "slide_map").select("barcode", "array_row", "array_col"), "barcode")


@query(f"SELECT barcode, count(*) AS n, CAST(sum(array_row) AS BIGINT) AS count FROM (SELECT * FROM {rq._UNIQUE_MAP} WHERE array_row IS NOT NULL AND array_col IS NOT NULL AND (array_row, array_col) IN (SELECT (array_row, array_col) FROM {rq._UNIQUE_MAP} GROUP BY 1 HAVING count(*) = 1)) GROUP BY barcode")
def hd_native_rescan(spark, sf):
    """A count table by native spot names, brought back to the barcodes of the map."""
    m = rq._slide(spark, sf).where("array_row is not null and array_col is not null")
    once = m.groupBy("array_row", "array_col").count().where("count = 1").select("array_row", "array_col")
    m = m.join(once, ["array_row", "array_col"], "left_semi")
    named = m.select(spatial.spot_name(F.col("array_row"), F.col("array_col"), 2).alias("barcode"), F.col("array_row").cast("long").alias("count"))
    return spatial.by_native_name(named, m).groupBy("barcode").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("count"))


@query(rq._SPLIT + f", p AS (SELECT DISTINCT bc1, bc2 FROM k WHERE n = 1) SELECT x.barcode AS bc1, string_agg(CASE WHEN p.bc2 IS NULL THEN '0' ELSE '1' END, '' ORDER BY y.barcode) AS cells FROM w x CROSS JOIN w y LEFT JOIN p ON p.bc1 = x.barcode AND p.bc2 = y.barcode GROUP BY x.barcode")
def scan_dense_mask(spark, sf):
    wells = rq.barcodes_of(spark, sf, "well8")
    return scan.dense_mask(scan.counts(rq._split(spark, sf), "bc1", "bc2"), wells, wells)


@query(rq._PLACED.format("").replace("WHEN twice THEN", "WHEN twice OR coalesce(regexp_matches(seq_comment, '(?:^|[ \\t])(?:XB|XS|XP):'), false) THEN") + "SELECT read_key, cb, status, CASE WHEN status = 'assigned' THEN printf('s_002um_%05d_%05d-1', r, c) END AS unit FROM s")
def spatial_reformat(spark, sf):
    out = spatial_reformatted(rq.reads_of(spark, sf).select("read_key", "seq_id", "seq_comment", "seq", "qual"), "sample1", rq._slide(spark, sf))
    return out.tables["assignments"].select("read_key", "cb", "status", "unit")


# Demultiplexing -----------------------------------------------------------------------------


def _parts(source: str) -> str:
    """Common tables for a ``source (id, seq)`` of longchain units: ``e`` with the parts behind the first exact copy of the primer, ``w`` the barcodes."""
    return f"""
w AS {rq._WL.format('cell16')},
o AS (SELECT id, upper(seq) AS f, {rq._RC.format('upper(seq)')} AS r FROM ({source})),
a AS (SELECT {rq.sql_part('longchain', 'forw_primer')} AS p, [{rq.sql_part('longchain', 'join_a')}, {rq.sql_part('longchain', 'join_b')}, {rq.sql_part('longchain', 'rev_primer')}] AS stops),
x AS (SELECT o.id, f, r, p, stops, strpos(f, p) > 0 AND length(f) >= strpos(f, p) + length(p) + 27 AS fwd, strpos(r, p) > 0 AND length(r) >= strpos(r, p) + length(p) + 27 AS rev FROM o, a),
y AS (SELECT id, stops, CASE WHEN fwd THEN 'F' ELSE 'R' END AS strand, CASE WHEN fwd THEN f ELSE r END AS s, p FROM x WHERE fwd OR rev),
z AS (SELECT *, strpos(s, p) + length(p) AS b FROM y),
t AS (SELECT *, substr(s, b, 16) AS barcode_raw, substr(s, b + 16, 12) AS umi, ltrim(substr(s, b + 28), 'T') AS tail FROM z),
e AS (SELECT *, coalesce(list_min(list_filter(list_transform(stops, lambda q: strpos(tail, q)), lambda i: i > 0)) - 1, length(tail)) AS n FROM t)"""


#: Units of longchain reads, cut at the joins on both strands.
_UNITS = f"""j AS (SELECT upper(seq) AS f, {rq._RC.format('upper(seq)')} AS r FROM read_layout WHERE layout = 'longchain' AND class = 'linker'),
jp AS (SELECT string_agg(s, '|' ORDER BY length(s) DESC, s) AS p FROM (SELECT f AS s FROM j UNION SELECT r FROM j)),
cut AS (SELECT read_key, list_filter(regexp_split_to_array(upper(seq), p), lambda x: x <> '') AS xs FROM rad_reads, jp WHERE run_id IN (SELECT run_id FROM run_batches WHERE layout = 'longchain')),
units AS (SELECT read_key || '/' || generate_subscripts(xs, 1) AS id, len(xs) AS units, unnest(xs) AS seq FROM cut)"""
_LONGCHAIN = "SELECT read_key AS id, seq FROM rad_reads WHERE run_id IN (SELECT run_id FROM run_batches WHERE layout = 'longchain')"


@query(f"""
WITH {_parts(_LONGCHAIN)},
c AS (SELECT e.*, r.seq_id, r.seq AS whole, r.qual, length(s) - length(tail) AS at0 FROM e JOIN rad_reads r ON r.read_key = e.id JOIN w ON w.barcode = e.barcode_raw),
g AS (SELECT *, CASE strand WHEN 'F' THEN substr(upper(whole), at0 + 1, n) ELSE {rq._RC.format('substr(s, at0 + 1, n)')} END AS part, substr(qual, CASE strand WHEN 'F' THEN at0 ELSE length(s) - at0 - n END + 1, n) AS q FROM c WHERE length(qual) = length(whole)),
k AS (SELECT *, list_filter(range(1, length(part) + 1), lambda i: part[i] <> 'N') AS idx FROM g)
SELECT id AS read_key, coalesce(seq_id, '') || '-' || strand AS seq_id, 'TS:A:' || CASE strand WHEN 'F' THEN '+' ELSE '-' END || ' CB:Z:' || barcode_raw || ' CR:Z:' || barcode_raw || ' UB:Z:' || umi AS seq_comment,
  array_to_string(list_transform(idx, lambda i: part[i]), '') AS seq, array_to_string(list_transform(idx, lambda i: q[i]), '') AS qual FROM k WHERE len(idx) >= 30""")
def demux_records(spark, sf):
    """Records with the quality of their cDNA, found by alignment without errors."""
    elements = rq.layout_of(spark, sf, "longchain")
    lists = {e.whitelist: rq.barcodes_of(spark, sf, e.whitelist) for e in elements if e.cls == "barcode"}
    reads = spread(rq.in_layout(spark, sf, "longchain").select("read_key", "seq_id", "seq", "qual"))
    return dm.fastq_records(dm.demux(reads, elements, lists, 0, 30, keep=["seq_id"], qual="qual"), ["barcode"])


@query(rq._FIXED + """, q AS (SELECT barcode, count(*) FILTER (barcode_kind = 'exact') >= 2 OR count(*) FILTER (barcode_kind = 'corrected') / count(*) <= 0.8 AS t FROM c WHERE barcode IS NOT NULL GROUP BY barcode)
SELECT read_key, c.barcode, c.barcode IS NOT NULL AND length(cdna) >= 30 AND coalesce(t, false) AS passing FROM c LEFT JOIN q ON q.barcode = c.barcode""")
def demux_defensive(spark, sf):
    return dm.with_policy(rq._demux(spark, sf, "longchain", 1, 30), ["barcode"], "defensive").select("read_key", "barcode", "passing")


@query(rq._FIXED + "SELECT read_key, barcode, barcode_kind = 'exact' AND length(cdna) >= 30 AS passing FROM c")
def demux_strict(spark, sf):
    return dm.strict(rq._demux(spark, sf, "longchain", 1, 30), ["barcode"]).select("read_key", "barcode", "passing")


@query(rq._COUNTED.replace("'tagline_three'", "'longchain'").replace("FROM rad_reads)", "FROM rad_reads WHERE run_id IN (SELECT run_id FROM run_batches WHERE layout = 'longchain'))") + rq._LIMITS + "SELECT barcode FROM c, l WHERE count >= threshold")
def demux_auto_whitelist(spark, sf):
    return auto_whitelist(rq.in_layout(spark, sf, "longchain").select("read_key", "seq"), rq.layout_of(spark, sf, "longchain"), max_error=0.0)


@query(f"""
WITH {_parts(_LONGCHAIN)},
k AS (SELECT e.*, w.barcode AS own FROM e LEFT JOIN w ON w.barcode = e.barcode_raw),
m AS (SELECT id, arg_min(k, abs(k) * 20 - k) AS k FROM (SELECT id, s, b, CAST(unnest(range(-4, 5)) AS BIGINT) AS k FROM k WHERE own IS NULL) WHERE b + k >= 1 AND substr(s, b + k, 16) IN (SELECT barcode FROM w) GROUP BY id),
l AS (SELECT k.*, m.k AS shift, length(s) - length(tail) + n AS stop FROM k LEFT JOIN m ON m.id = k.id),
v AS (SELECT id, strand, CASE WHEN shift IS NULL THEN barcode_raw ELSE substr(s, b + shift, 16) END AS barcode_raw, CASE WHEN shift IS NULL THEN own ELSE substr(s, b + shift, 16) END AS barcode,
  CASE WHEN shift IS NOT NULL THEN 'located' WHEN own IS NULL THEN 'none' ELSE 'exact' END AS barcode_kind, CASE WHEN shift IS NULL THEN umi ELSE substr(s, b + shift + 16, 12) END AS umi,
  regexp_replace(CASE WHEN shift IS NULL THEN substr(tail, 1, n) ELSE ltrim(substr(s, b + shift + 28, greatest(stop + 1 - (b + shift + 28), 0)), 'T') END, 'N+', '', 'g') AS c FROM l)
SELECT id AS read_key, strand, barcode_raw, barcode, barcode_kind, umi, CASE strand WHEN 'F' THEN c ELSE {rq._RC.format('c')} END AS cdna, barcode IS NOT NULL AND length(c) >= 30 AS passing FROM v""")
def demux_relocated(spark, sf):
    """Barcodes that are not known at their place are looked for in a window of four bases around it; what is chained to them moves along."""
    elements = rq.layout_of(spark, sf, "longchain")
    lists = {e.whitelist: rq.barcodes_of(spark, sf, e.whitelist) for e in elements if e.cls == "barcode"}
    return dm.demux(rq.in_layout(spark, sf, "longchain").select("read_key", "seq"), elements, lists, 0, 30, pad=4)


@query(rq._FIXED + "SELECT *, barcode IS NOT NULL AND length(cdna) >= 30 AS passing FROM c")
def demux_generated(spark, sf):
    """Observed barcodes are varied and looked up, as for large whitelists."""
    elements = rq.layout_of(spark, sf, "longchain")
    lists = {e.whitelist: rq.barcodes_of(spark, sf, e.whitelist) for e in elements if e.cls == "barcode"}
    return dm.demux(rq.in_layout(spark, sf, "longchain").select("read_key", "seq"), elements, lists, 1, 30, generate=True)


@query(f"""
WITH {_UNITS},
{_parts('SELECT id, seq FROM units')},
c AS (SELECT e.*, u.units, length(regexp_replace(substr(tail, 1, n), 'N+', '', 'g')) >= 30 AS kept FROM e JOIN units u ON u.id = e.id JOIN w ON w.barcode = e.barcode_raw)
SELECT 1 AS class_id, barcode_raw AS true_bc, count(*) AS raw_count, count(*) AS total_count, CAST(0 AS BIGINT) AS corrected_count, count(*) FILTER (strand = 'F') AS forw_count, count(*) FILTER (strand = 'R') AS rev_count,
  count(*) FILTER (strand = 'F' AND units > 1) AS forw_concat_count, count(*) FILTER (strand = 'R' AND units > 1) AS rev_concat_count, count(*) FILTER (NOT kept) AS filtered_count FROM c GROUP BY barcode_raw""")
def demux_unit_counters_exact(spark, sf):
    """Counters of every unit of concatenated reads, with exact copies of primers and barcodes."""
    elements = rq.layout_of(spark, sf, "longchain")
    joins = [e.seq for e in elements if e.cls == "linker"]
    lists = {e.whitelist: rq.barcodes_of(spark, sf, e.whitelist) for e in elements if e.cls == "barcode"}
    d = dm.demux_units(rq.in_layout(spark, sf, "longchain").select("read_key", "seq"), elements, lists, joins, 0, 30, max_error=0.0).where("barcode is not null")
    return whitelist.counters(d.select(F.lit(1).alias("class_id"), F.col("barcode").alias("true_bc"), F.col("barcode_kind").alias("kind"), "strand", "units", F.col("passing").alias("kept")))


@query(f"SELECT count(*) AS records_read, count(cb) AS written, count(*) - count(cb) AS skipped_missing_cb, count(cb) AS reformatted, CAST(0 AS BIGINT) AS converted, count(*) FILTER (cb IN (SELECT barcode FROM slide_map)) AS coordinates_mapped, count(*) - count(*) FILTER (cb IN (SELECT barcode FROM slide_map)) AS coordinates_unmapped, count(*) FILTER (seq = '') AS empty_records, count(DISTINCT cb) AS split_barcodes FROM {rq._TAGS}")
def reformat_all_stats(spark, sf):
    known = table(spark, sf, "slide_map").select(F.col("barcode").alias("_b")).distinct().withColumn("_known", F.lit(True))
    r = rq.reads_of(spark, sf).withColumn("_cb", dna.tag(F.col("seq_comment"), "CB")).join(known, F.col("_cb") == F.col("_b"), "left")
    return reformat.full_stats(r, "seq_comment", header=True, split=True, placed=F.coalesce("_known", F.lit(False)))


# Alignment with errors, against a dynamic program over all reads in SQL --------------------------


def _aligned(pairs: str, name: str = "", anchored: bool = False) -> str:
    """Common table ``aligned (id, distance, spot, ties)`` of ``pairs (id, p, t)``: each pattern of up to 62 letters against its text, one letter of the text a step.

    The shorter text is the pattern; ``steps`` holds the distance up to each letter.  ``anchored`` alignments begin with the text.
    """
    bits = lambda c: f"CAST(coalesce(list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN p[i] = '{c}' THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)), 0) AS BIGINT)"
    swap = "SELECT id, p, t" if anchored else "SELECT id, CASE WHEN length(p) <= length(t) THEN p ELSE t END AS p, CASE WHEN length(p) <= length(t) THEN t ELSE p END AS t"
    return f"""
masks{name} AS (SELECT id, t, m, n, (CAST(1 AS BIGINT) << m) - 1 AS ones, {bits('A')} AS ma, {bits('C')} AS mc, {bits('G')} AS mg, {bits('T')} AS mt FROM (SELECT *, length(p) AS m, length(t) AS n FROM ({swap} FROM ({pairs})))),
steps{name} AS (
  SELECT id, CAST(0 AS BIGINT) AS j, ones AS vp, CAST(0 AS BIGINT) AS vn, m AS score, m AS best, CAST(-1 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS ties FROM masks{name}
  UNION ALL
  SELECT id, j + 1, ((hn << 1) & ones) | (xor(ones, (d0 | x) & ones)), d0 & x, s, least(best, s), CASE WHEN s < best THEN j ELSE spot END, CASE WHEN s < best THEN 1 WHEN s = best AND best < m THEN ties + 1 ELSE ties END
  FROM (SELECT *, ((hp << 1) | {int(anchored)}) & ones AS x, score + ((hp >> (m - 1)) & 1) - ((hn >> (m - 1)) & 1) AS s
    FROM (SELECT *, (vn | xor(ones, (d0 | vp) & ones)) & ones AS hp, d0 & vp AS hn
      FROM (SELECT *, (xor((eq & vp) + vp, vp) | eq | vn) & ones AS d0
        FROM (SELECT k.*, m, ones, CASE t[k.j + 1] WHEN 'A' THEN ma WHEN 'C' THEN mc WHEN 'G' THEN mg WHEN 'T' THEN mt ELSE 0 END AS eq FROM steps{name} k JOIN masks{name} g ON g.id = k.id WHERE k.j < g.n AND g.m > 0))))),
aligned{name} AS (SELECT s.id, s.best AS distance, s.spot, s.ties FROM steps{name} s JOIN masks{name} g ON g.id = s.id WHERE s.j = CASE WHEN g.m > 0 THEN g.n ELSE 0 END)"""


_PRIMER = rq.sql_part("longchain", "forw_primer")
_DISTANCES = f"WITH RECURSIVE {_aligned(f'SELECT read_key AS id, {_PRIMER} AS p, upper(seq) AS t FROM rad_reads')}"


@query(_DISTANCES + " SELECT CAST(distance AS INT) AS distance, count(*) AS n FROM aligned GROUP BY distance")
def infix_histogram(spark, sf):
    """The histogram of edit distances that calibration reads."""
    d = infix_distance(rq.part_of(spark, sf, "longchain", "forw_primer"), F.upper("seq"))
    return spread(rq.reads_of(spark, sf).select("seq")).select(d.alias("d")).groupBy(F.col("d.distance").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


#: SQL of queries that are registered beside the exact ones.
_SQL["infix_distances"] = _DISTANCES + " SELECT id AS read_key, CAST(distance AS INT) AS distance, CAST(spot AS INT) AS \"end\", CAST(ties AS INT) AS ties FROM aligned"
_SQL["scan_fuzzy"] = f"""
WITH RECURSIVE o AS (SELECT read_key, upper(seq) AS f, {rq._RC.format('upper(seq)')} AS r FROM rad_reads),
{_aligned(f"SELECT read_key || 'F' AS id, {_PRIMER} AS p, f AS t FROM o UNION ALL SELECT read_key || 'R', {_PRIMER}, r FROM o")},
b AS (SELECT o.*, x.distance AS df, x.spot AS af, y.distance AS dr, y.spot AS ar FROM o JOIN aligned x ON x.id = read_key || 'F' JOIN aligned y ON y.id = read_key || 'R'),
h AS (SELECT read_key, CASE WHEN df <= dr THEN 'F' ELSE 'R' END AS strand, least(df, dr) AS distance, CASE WHEN df <= dr THEN substr(f, af + 2, 16) ELSE substr(r, ar + 2, 16) END AS barcode,
  CASE WHEN df <= dr THEN af ELSE ar END AS spot FROM b WHERE least(df, dr) <= (SELECT CAST(floor(length({_PRIMER}) * 0.15) AS INT)))
SELECT read_key, strand, CAST(distance AS INT) AS distance, barcode FROM h WHERE spot >= 0 AND length(barcode) = 16"""
_SQL["similarity_infix"] = f"""
WITH RECURSIVE {rq._LOCATED.strip().removeprefix('WITH ').replace('WITH a AS', 'a AS')},
seen AS (SELECT DISTINCT substr(s, pl - 4, 24) AS a FROM h WHERE length(substr(s, pl, 16)) = 16 AND length(substr(s, pl - 4, 24)) = 24),
{_aligned(f"SELECT a || '|' || w.barcode AS id, w.barcode AS p, a AS t FROM seen, {rq._WL.format('cell16')} w")}
SELECT split_part(id, '|', 1) AS a, split_part(id, '|', 2) AS b, CAST(distance AS INT) AS distance FROM aligned WHERE distance <= 2"""
_SQL["concat_segments_both"] = f"""
WITH j AS (SELECT upper(seq) AS f, {rq._RC.format('upper(seq)')} AS r FROM read_layout WHERE layout = 'longchain' AND class = 'linker'),
b AS (SELECT r AS s, 'R' AS side FROM j WHERE r NOT IN (SELECT f FROM j) UNION SELECT f, 'F' FROM j),
p AS (SELECT '(' || string_agg(s, '|' ORDER BY length(s) DESC, s) || ')' AS p, map(list(s ORDER BY s), list(side ORDER BY s)) AS sides FROM b),
x AS (SELECT read_key, regexp_split_to_array(upper(seq), p) AS parts, regexp_extract_all(upper(seq), p, 1) AS cuts, sides FROM rad_reads, p),
y AS (SELECT read_key, list_filter(list_transform(range(1, len(parts) + 1), lambda i: {{'part': parts[i], 'l': CASE WHEN i > 1 THEN sides[cuts[i - 1]] END, 'r': CASE WHEN i <= len(cuts) THEN sides[cuts[i]] END}}), lambda q: q.part <> '') AS ps FROM x)
SELECT read_key, CAST(generate_subscripts(ps, 1) AS BIGINT) AS segment, CAST(len(ps) AS BIGINT) AS units, unnest(ps).part AS part, unnest(ps).l AS left_strand, unnest(ps).r AS right_strand FROM y"""


# Primers and joins within 15 % of their letters: the primer's first best end on the better strand, then the first place of a
# join or the closing primer behind the tail of T, whose start is found by an anchored alignment of the reversed letters.
def _fuzzy(source: str, first: str = "") -> str:
    """Common tables up to ``c`` for a ``source (read_key, seq)`` of longchain reads or units."""
    return f"""
WITH RECURSIVE {first}w AS {rq._WL.format('cell16')},
o AS (SELECT read_key, upper(seq) AS f, {rq._RC.format('upper(seq)')} AS r FROM ({source})),
sides AS (SELECT read_key, 'F' AS side, f AS s FROM o UNION ALL SELECT read_key, 'R', r FROM o),
{_aligned(f"SELECT (read_key, side) AS id, {_PRIMER} AS p, s AS t FROM sides WHERE length(s) >= length({_PRIMER}) - 3", "_p")},
placed AS (SELECT b.read_key, b.side AS strand, b.s, l.distance, l.spot + 1 + 28 AS at0, l.spot + 1 AS b FROM sides b JOIN aligned_p l ON l.id = (b.read_key, b.side)
  WHERE l.distance <= (SELECT CAST(floor(length({_PRIMER}) * 0.15) AS INT)) AND length(b.s) >= l.spot + 1 + 28),
better AS (SELECT *, row_number() OVER (PARTITION BY read_key ORDER BY distance, strand) AS i FROM placed),
taken AS (SELECT *, length(s) - length(ltrim(substr(s, at0 + 1), 'T')) AS at1 FROM better WHERE i = 1),
stops AS (SELECT id AS part, upper(seq) AS p, CAST(floor(length(seq) * 0.15) AS INT) AS most FROM read_layout WHERE layout = 'longchain' AND id IN ('join_a', 'join_b', 'rev_primer')),
{_aligned("SELECT (read_key, part) AS id, p, s AS t FROM taken, stops WHERE length(s) >= length(p)", "_s")},
ends AS (SELECT k.id, k.j - 1 AS e, k.score AS d, k.j - row_number() OVER (PARTITION BY k.id ORDER BY k.j) AS run FROM steps_s k JOIN stops ON k.id[2] = part WHERE k.score <= most AND k.j > 0),
hits AS (SELECT id, arg_min(e, d * 100000 + e) AS e, min(d) AS d FROM ends GROUP BY id, run),
{_aligned("SELECT (h.id[1], h.id[2], h.e) AS id, reverse(p) AS p, reverse(substr(s, CAST(greatest(0, h.e + 1 - length(p) - h.d) + 1 AS BIGINT), CAST(h.e + 1 - greatest(0, h.e + 1 - length(p) - h.d) AS BIGINT))) AS t FROM hits h JOIN taken ON read_key = h.id[1] JOIN stops ON part = h.id[2]", "_a", True)},
starts AS (SELECT k.id[1] AS read_key, k.id[3] + 1 - arg_min(k.j, k.score * 10000 + abs(k.j - g.m) * 100 + k.j) AS start FROM steps_a k JOIN masks_a g ON g.id = k.id GROUP BY k.id),
closed AS (SELECT t.read_key, min(start) AS stop FROM taken t JOIN starts ON starts.read_key = t.read_key WHERE start >= at1 GROUP BY t.read_key),
found AS (SELECT t.*, regexp_replace(substr(s, CAST(at1 + 1 AS BIGINT), CAST(coalesce(stop, length(s)) - at1 AS BIGINT)), '[Nn]+', '', 'g') AS part FROM taken t LEFT JOIN closed ON closed.read_key = t.read_key),
d AS (SELECT read_key, strand, substr(s, b + 1, 16) AS barcode_raw, substr(s, b + 17, 12) AS umi, CASE strand WHEN 'R' THEN {rq._RC.format('part')} ELSE part END AS cdna FROM found)
{rq._FIXED[len(rq._LONG):]}"""


_SQL["demux_fuzzy"] = _fuzzy(_LONGCHAIN.replace("AS id", "AS read_key").replace("read_key AS read_key", "read_key")) + "SELECT *, barcode IS NOT NULL AND length(cdna) >= 30 AS passing FROM c"
_SQL["demux_unit_counters"] = (
    _fuzzy("SELECT id AS read_key, seq FROM units", _UNITS + ",\n")
    + """SELECT 1 AS class_id, barcode AS true_bc, count(*) FILTER (barcode_kind = 'exact') AS raw_count, count(*) FILTER (barcode_kind IN ('exact', 'corrected')) AS total_count, count(*) FILTER (barcode_kind = 'corrected') AS corrected_count,
  count(*) FILTER (strand = 'F') AS forw_count, count(*) FILTER (strand = 'R') AS rev_count, count(*) FILTER (strand = 'F' AND units > 1) AS forw_concat_count, count(*) FILTER (strand = 'R' AND units > 1) AS rev_concat_count, count(*) FILTER (length(cdna) < 30) AS filtered_count,
  count(*) FILTER (barcode_kind = 'exact') >= 2 OR count(*) FILTER (barcode_kind = 'corrected') / greatest(count(*), 1) <= 0.8 AS trusted FROM c JOIN units u ON u.id = c.read_key WHERE barcode IS NOT NULL GROUP BY barcode"""
)


def queries() -> dict[str, rq.Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
