"""The column functions as functions of SQL, so that any SQL text may use them; Spark inlines them into its plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from readloom.functions.dna import UUID

#: Name, arguments, type and body of each function.
FUNCTIONS = {
    "rl_revcomp": ("s STRING", "STRING", "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
    "rl_tag": ("comment STRING, name STRING", "STRING", "CASE WHEN rlike(comment, concat('(?:^|[ \\t])', name, ':Z:')) THEN regexp_extract(comment, concat('(?:^|[ \\t])', name, ':Z:([^ \\t]*)'), 1) END"),
    "rl_is_uuid": ("id STRING", "BOOLEAN", f"rlike(id, '^(?:{UUID})$')"),
    "rl_phred": ("qual STRING", "ARRAY<INT>", "transform(filter(split(qual, ''), c -> c <> ''), c -> ascii(c) - 33)"),
    "rl_without_gaps": ("s STRING", "STRING", "regexp_replace(s, '[Nn]+', '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        escaped = body.replace("\\", "\\\\")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {escaped}")
    return list(FUNCTIONS)
