"""Queries of the core operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.packed import unpack
from readloom.sources.delimited import parse_read_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse_read_lines(table(spark, sf_dir, "raw_read_lines"), "line_id", "raw_line")
    return lines.where("reason is not null").select(F.col("key").alias("line_id"), "reason")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse_read_lines(table(spark, sf_dir, "raw_read_lines"), "line_id", "raw_line")
    return lines.where("reason is null").select(F.col("key").alias("line_id"), "seq_id", "seq_comment", "seq", "qual")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "rad_reads"), "read_key", "seq_comment").withColumnRenamed("key", "read_key")


_LINES = r"""
WITH own AS (
  SELECT line_id, regexp_replace(regexp_replace(raw_line, '^\x{FEFF}', ''), '\r$', '') AS l FROM raw_read_lines WHERE raw_line IS NOT NULL),
lines AS (SELECT line_id, l, regexp_full_match(l, '(?s)(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*') AS quoted FROM own WHERE l <> 'seq_id,seq_comment,seq,qual'),
split AS (
  SELECT line_id, quoted, CASE WHEN quoted THEN [
    CASE WHEN x[1:1] = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END
    FOR x IN list_transform(regexp_extract_all(',' || l, '(?s),(?:"(?:[^"]|"")*"|[^",]*)'), lambda y: y[2:])] END AS f
  FROM lines),
reasons AS (
  SELECT line_id, f, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN len(f) <> 4 THEN 'column_count'
    WHEN f[1] = '' OR regexp_matches(f[1], '[\s\x00-\x1f\x7f-\x9f\pZ\x{85}]') THEN 'seq_id'
    WHEN NOT regexp_full_match(f[3], '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]*') THEN 'seq'
    WHEN NOT regexp_full_match(f[4], '[!-~]*') THEN 'qual'
    WHEN f[4] <> '' AND length(f[4]) <> length(f[3]) THEN 'length' END AS reason
  FROM split)
"""

_ITEMS = r"""
WITH v AS (
  SELECT read_key, regexp_extract_all(seq_comment, '(?s)(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')?(?:[^ \t,;|:]|:(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')?)*') AS xs
  FROM rad_reads WHERE seq_comment IS NOT NULL),
n AS (SELECT read_key, list_filter(list_transform(xs, lambda x:
    array_to_string(list_transform(
      regexp_extract_all(x, '(?s)^"(?:[^"]|"")*"|^''(?:[^'']|'''')*''|:"(?:[^"]|"")*"|:''(?:[^'']|'''')*''|.'),
      lambda p: CASE
        WHEN length(p) > 1 AND p[1:1] = '"' THEN replace(p[2:length(p) - 1], '""', '"')
        WHEN length(p) > 1 AND p[1:1] = '''' THEN replace(p[2:length(p) - 1], '''''', '''')
        WHEN length(p) > 1 AND p[2:2] = '"' THEN ':' || replace(p[3:length(p) - 1], '""', '"')
        WHEN length(p) > 1 THEN ':' || replace(p[3:length(p) - 1], '''''', '''')
        ELSE p END), '')), lambda x: x <> '') AS xs FROM v)
SELECT read_key, CAST(generate_subscripts(xs, 1) AS BIGINT) AS pos, unnest(xs) AS item FROM n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_loaded, p6_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _LINES + "SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL",
        "p4_loaded": _LINES + "SELECT line_id, f[1] AS seq_id, f[2] AS seq_comment, f[3] AS seq, f[4] AS qual FROM reasons WHERE reason IS NULL",
        "p6_found": _ITEMS,
    }
