"""Writing results: saved read tables, records by barcode, and sets of tables."""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.dna import tag
from readloom.operators.reads import validate
from readloom.operators.reformat import fasta, fastq
from readloom.plans.publish import publish
from readloom.sources.fastq import read_fastq, write_fastq

FORMAT = {"format": "read-table", "version": 1, "phred_offset": 33}
#: Names that are safe as parts of a path.
SAFE = "^[A-Za-z0-9][A-Za-z0-9_.+-]*$"


def save(reads: DataFrame, path: str) -> str:
    """A read table as Parquet with a format note beside it; the note is written last and marks the table as complete."""
    validate(reads)
    reads.write.mode("errorifexists").parquet(path)
    note = reads.sparkSession.createDataFrame([(json.dumps(FORMAT),)], "value string")
    note.coalesce(1).write.text(f"{path.rstrip('/')}.format")
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved read table; other formats and versions are refused."""
    try:
        note = json.loads(spark.read.text(f"{path.rstrip('/')}.format").first()["value"])
    except Exception as e:
        raise ValueError(f"{path} is no saved read table") from e
    if {k: note.get(k) for k in ("format", "version")} != {k: FORMAT[k] for k in ("format", "version")}:
        raise ValueError(f"unknown format {note}")
    return spark.read.parquet(path)


def split_by_barcode(reads: DataFrame, path: str, comment: str = "seq_comment", to_fasta: bool = False, most_records: int = 5_000_000) -> None:
    """Records under ``CB=<barcode>/``, packed; records without a barcode are left out, unsafe names refused.

    Rows are spread by barcode and key, so a barcode of any size is written by several tasks, and each task
    holds one open file at a time because its rows are sorted by barcode.
    """
    cb = tag(F.col(comment), "CB")
    keyed = reads.withColumn("CB", F.when(cb != "", cb)).where("CB is not null")
    if not keyed.where(~F.col("CB").rlike(SAFE)).isEmpty():
        raise ValueError("a barcode is no safe file name")
    text = fasta(F.col("seq_id"), F.col(comment), F.col("seq")) if to_fasta else fastq(F.col("seq_id"), F.col(comment), F.col("seq"), F.col("qual"))
    ranged = keyed.select("CB", "read_key", text.alias("value")).repartitionByRange("CB", "read_key").sortWithinPartitions("CB", "read_key")
    ranged.select("CB", "value").write.option("compression", "gzip").option("maxRecordsPerFile", most_records).partitionBy("CB").text(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, overwrite: bool = True) -> dict[str, str]:
    """Small result tables as ``<name>`` (``.csv``, ``.tsv``, each also ``.gz``) in a folder, all or none; rows stream through the driver."""
    os.makedirs(folder, exist_ok=True)
    paths = {name: os.path.join(folder, name) for name in tables}

    def writer(df: DataFrame, sep: str):
        def write(path: str) -> None:
            quote = lambda v: "" if v is None else f'"{str(v).replace(chr(34), chr(34) * 2)}"' if any(c in str(v) for c in (sep, '"', "\n")) else str(v)
            with (gzip.open if path.endswith(".gz") else open)(path, "wt", encoding="utf-8") as f:
                f.write(sep.join(df.columns) + "\n")
                for row in df.toLocalIterator():
                    f.write(sep.join(map(quote, row)) + "\n")

        return write

    publish({paths[n]: writer(df, "\t" if ".tsv" in n else ",") for n, df in tables.items()}, overwrite)
    return paths


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame] = lambda reads: reads, output: str | None = None, phred_offset: int = 33) -> str:
    """A FASTQ file with changed records, in place unless ``output`` is named; replaced only when the new one is complete.

    Lines behind the plus sign and the order of records stay.
    """
    reads = read_fastq(spark, path, phred_offset=phred_offset)
    return write_fastq(change(reads), output or path, phred_offset=phred_offset)


def spatial_export(result, folder: str) -> dict[str, str]:
    """Records, assignments and summary of a spatial reformat in a folder that must be new: ``reads.fastq.gz``, ``assignments.tsv.gz``, ``summary.tsv``."""
    os.makedirs(folder, exist_ok=False)
    paths = write_tables({"assignments.tsv.gz": result.tables["assignments"], "summary.tsv": result.tables["summary"]}, folder)
    paths["reads.fastq.gz"] = write_fastq(result.tables["records"], os.path.join(folder, "reads.fastq.gz"))
    return paths


#: Tables of a scan by the file each goes into; which of them there are depends on the mode.
SCAN_FILES = {"called": ".csv", "selected": ".txt", "valid_pairs": "_valid_pairs.csv", "dense_mask": "_spat_mask.csv", "coordinates": "_coordinates.tsv.gz", "regions": "_regions.tsv"}


def scan_artifacts(result, prefix: str) -> dict[str, str]:
    """Files of a scan beside each other, named by the prefix: counts, the selected barcodes, and what its mode adds."""
    tables = dict(result.tables)
    tables["selected"] = tables["called"].where("selected").select("barcode")
    folder, name = os.path.split(os.path.abspath(prefix))
    return write_tables({name + end: tables[t] for t, end in SCAN_FILES.items() if t in tables}, folder)


def discovery_tables(result, prefix: str) -> dict[str, str]:
    """Tables of a discovery: parts, whitelists, spacing, and the layout, marked as partial where it is not settled."""
    folder, name = os.path.split(os.path.abspath(prefix))
    spark = next(iter(result.tables.values())).sparkSession
    rows = [(i, e.id, e.seq, e.kind, e.cls, "-".join(map(str, e.lengths))) for i, e in enumerate(result.notes["layout"], 1)]
    layout = spark.createDataFrame(rows, "element_no int, id string, seq string, type string, class string, expected_length string").coalesce(1)
    ends = {"parts": "_parts.csv", "whitelists": "_whitelists.csv", "spacing": "_spacing.csv"}
    tables = {name + e: result.tables[t] for t, e in ends.items() if t in result.tables}
    return write_tables(tables | {name + ("_layout.csv" if result.notes["layout_complete"] else "_layout.partial.csv"): layout}, folder)


#: Tables of a demultiplexing by the file each goes into.
DEMUX_FILES = {"stats": "_stats.csv", "counters": "_counters.csv.gz", "whitelist_true": "_whitelist_true.csv.gz", "debug": "_debug.csv.gz"}


def demux_artifacts(result, prefix: str) -> dict[str, str]:
    """Records as ``<prefix>.fastq.gz`` in input order, beside them statistics, counters, the trusted barcodes and, if there is one, the debug table."""
    if "fastq" not in result.tables:
        raise ValueError("the records have no qualities")
    tables = dict(result.tables)
    if "counters" in tables:
        tables["whitelist_true"] = tables["counters"].where("trusted").select(F.col("true_bc").alias("barcode")).orderBy("barcode")
    folder, name = os.path.split(os.path.abspath(prefix))
    paths = write_tables({name + end: tables[t] for t, end in DEMUX_FILES.items() if t in tables}, folder)
    paths[f"{name}.fastq.gz"] = write_fastq(tables["fastq"], os.path.join(folder, f"{name}.fastq.gz"))
    return paths
