"""FASTQ and FASTA: a Python data source for batches and streams, a pull stream, and writers."""

from __future__ import annotations

import gzip
import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, LessThanOrEqual

from readloom.functions.quality import OFFSET, from_offset, recoded

SCHEMA = "file string, read_key long, seq_id string, seq_comment string, seq string, qual string, plus string"
SUFFIXES = (".fastq", ".fq", ".fasta", ".fa")


class FastqError(ValueError):
    """A record that cannot be read; nothing after it is read either."""


def _open(path: str):
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    return gzip.open(path, "rt", encoding="utf-8", newline="\n") if packed else open(path, encoding="utf-8", newline="\n")


def _named(head: str) -> tuple[str, str]:
    """Identifier and comment of a header line, parted at the first blank or tab."""
    name, _, comment = head[1:].partition(" ") if "\t" not in head or 0 < head.find(" ") < head.find("\t") else head[1:].partition("\t")
    return name, comment


def records(path: str) -> Iterator[tuple]:
    """``(seq_id, seq_comment, seq, qual, plus)`` of a file, FASTA or FASTQ by its first letter; sequences may run over lines."""
    try:
        with _open(path) as f:
            line, kind, n = f.readline(), None, 0
            while line:
                head = line.rstrip("\r\n")
                if not head:
                    line = f.readline()
                    continue
                n += 1
                kind = kind or head[0]
                if kind not in "@>" or head[0] != kind:
                    raise FastqError(f"{path}, record {n}: expected {kind if kind in '@>' else '@ or >'}")
                name, comment = _named(head)
                seq, line = [], f.readline()
                while line and line[0] not in ("+>" if kind == "@" else ">") and not (kind == "@" and line[0] == "@" and seq == []):
                    seq.append(line.rstrip("\r\n"))
                    line = f.readline()
                text = "".join(seq)
                if kind == ">":
                    yield name, comment or None, text, None, None
                    continue
                if not line or line[0] != "+":
                    raise FastqError(f"{path}, record {n}: truncated before the quality")
                plus, qual, got = line[1:].rstrip("\r\n"), [], 0
                line = f.readline()
                if not text and line and not line.rstrip("\r\n"):
                    line = f.readline()
                while line and got < len(text):
                    part = line.rstrip("\r\n")
                    qual.append(part)
                    got += len(part)
                    line = f.readline()
                if got != len(text):
                    raise FastqError(f"{path}, record {n}: quality and sequence differ in length")
                yield name, comment or None, text, "".join(qual), plus or None
    except (EOFError, OSError, UnicodeDecodeError, gzip.BadGzipFile) as e:
        raise FastqError(f"{path}: {e}") from e


def files_of(path: str) -> list[str]:
    """The file, or the sequence files of a folder in order of their names; the parts that ``write_fastq_parts`` leaves are some, too."""
    path = path.removeprefix("file://")
    if not os.path.isdir(path):
        return [path]
    names = sorted(n for n in os.listdir(path) if n.lower().removesuffix(".gz").endswith(SUFFIXES) or n.startswith("part-"))
    return [os.path.join(path, n) for n in names]


#: Keys of the records of a file begin at its place in the folder times this.
FILE_KEYS = 1 << 40


class _File(InputPartition):
    def __init__(self, path: str, place: int):
        self.path, self.place = path, place


def _rows(partition: _File, most: int | None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a file; ``read_key`` is unique in the folder and rises with files and records."""
    source = records(partition.path) if most is None else itertools.islice(records(partition.path), max(most, 0))
    n, schema = 0, pa.schema([("file", pa.string()), ("read_key", pa.int64()), *((c, pa.string()) for c in ("seq_id", "seq_comment", "seq", "qual", "plus"))])
    while rows := list(itertools.islice(source, 5000)):
        keys = pa.array(range(partition.place * FILE_KEYS + n + 1, partition.place * FILE_KEYS + n + len(rows) + 1), pa.int64())
        n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), keys, *(pa.array(c, pa.string()) for c in zip(*rows))], schema=schema)


class _Stretch(InputPartition):
    """Records of a plain file that begin within a stretch of its bytes."""

    def __init__(self, path: str, place: int, start: int, end: int):
        self.path, self.place, self.start, self.end = path, place, start, end


def _stretch_rows(part: _Stretch) -> Iterator[pa.RecordBatch]:
    """Records of four lines; ``read_key`` is the place of the record's first byte, from 1 on, so it needs no count of what lies before."""
    schema = pa.schema([("file", pa.string()), ("read_key", pa.int64()), *((c, pa.string()) for c in ("seq_id", "seq_comment", "seq", "qual", "plus"))])

    def found() -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
                # The line after the next begins with a plus only behind a header: neither bases nor qualities' places fit.
                ahead: list[bytes] = []
                while len(ahead) < 8 and (line := f.readline()):
                    ahead.append(line)
                skip = next((i for i in range(min(4, len(ahead))) if ahead[i][:1] == b"@" and i + 2 < len(ahead) and ahead[i + 2][:1] == b"+"), None)
                if skip is None:
                    return
                at += sum(map(len, ahead[:skip]))
                f.seek(at)
            while at < part.end and (lines := list(itertools.islice(f, 4))):
                head, seq, plus, qual = ([x.decode().rstrip("\r\n") for x in lines] + [""] * 4)[:4]
                if head[:1] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                    raise FastqError(f"{part.path}, byte {at}: no record of four lines")
                name, comment = _named(head)
                yield part.path, part.place * FILE_KEYS + at + 1, name, comment or None, seq, qual, plus[1:] or None
                at += sum(map(len, lines))

    rows = found()
    while batch := list(itertools.islice(rows, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*batch), schema)], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.stretch = int(options.get("splitbytes") or options.get("splitBytes") or 0)
        self.path = options.get("path")
        self.most = int(options["maxreads"]) if "maxreads" in options else int(options["maxReads"]) if "maxReads" in options else None
        if not self.path:
            raise ValueError("a path is required")

    def partitions(self):
        out: list[InputPartition] = []
        for i, p in enumerate(files_of(self.path)):
            size = os.path.getsize(p)
            with open(p, "rb") as f:
                plain = f.read(1) == b"@"
            if self.stretch and plain and size > self.stretch and self.most is None:
                out += [_Stretch(p, i, at, min(at + self.stretch, size)) for at in range(0, size, self.stretch)]
            else:
                out.append(_File(p, i))
        return out

    def read(self, partition):
        return _stretch_rows(partition) if isinstance(partition, _Stretch) else _rows(partition, self.most)


class _BoundedReader(_Reader):
    def pushFilters(self, filters):
        """A bound on ``read_key`` ends the reading of a file early; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("read_key",) and f.value < FILE_KEYS:
                self.most = f.value if self.most is None else min(self.most, f.value)
            yield f


class _StreamReader(DataSourceStreamReader):
    """Files in order of their names; the offset is the number of files taken, at most ``filesPerBatch`` a batch."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("filesPerBatch", "1000"))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        self.at = min(len(files_of(self.path)), self.at + self.step)
        return {"files": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at, end["files"])
        return [_File(p, i) for i, p in enumerate(files_of(self.path)) if start["files"] <= i < end["files"]]

    def read(self, partition):
        return _rows(partition, None)

    def commit(self, end: dict) -> None:
        pass


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path)`` and ``spark.readStream``; a file is a partition, as gzip cannot be split; ``splitBytes`` splits plain ones.

    ``read_key`` counts the records of the first file from 1, those of file n from n times ``FILE_KEYS`` on, so it is unique
    in a folder and keeps the order of the input; ``maxReads`` ends each file after so many.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        # Spark refuses a reader with filters where their pushdown is not enabled.
        return (_BoundedReader if self.options.get("bounded") == "true" else _Reader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_fastq(spark: SparkSession, path: str, max_reads: int | None = None, phred_offset: int = 33, keep_comment: bool = True, split_bytes: int | None = None) -> DataFrame:
    """Records of a file or folder with their summaries; an empty file gives no rows.

    A bound on ``read_key`` in a filter ends the reading early, for which pushdown to Python sources is enabled.
    With ``split_bytes`` plain FASTQ files of four lines a record are read by a task for so many bytes; their keys rise with
    the records but are byte places, which ``compact`` turns into numbers.
    ``max_reads`` keeps the first records of the whole input; qualities of another ``phred_offset`` are brought to 33.
    """
    from readloom.operators.reads import with_summaries

    spark.dataSource.register(FastqSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("fastq").option("bounded", "true")
    if max_reads is not None:
        reader = reader.option("maxReads", str(max_reads))
    if split_bytes is not None:
        reader = reader.option("splitBytes", str(split_bytes)).option("bounded", "false")
    reads = reader.load(path)
    if max_reads is not None and len(files_of(path)) > 1:
        reads = reads.orderBy("read_key").limit(max_reads)
    if phred_offset != OFFSET:
        reads = reads.withColumn("qual", from_offset(F.col("qual"), phred_offset))
    if not keep_comment:
        reads = reads.withColumn("seq_comment", F.lit(None).cast("string"))
    return with_summaries(reads)


class FastqStream:
    """Pull stream over a file: ``next(n)`` gives at most ``n`` records as a table, then ``None``; it cannot go on after an error.

    The driver holds the records of a table as long as the table is used.  ``letters`` counts those of all sequences so far.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._records, self._read, self.done, self._broken = spark, records(path), 0, False, False
        self.letters = 0

    def next(self, n: int = 50_000) -> DataFrame | None:
        if self._records is None:
            raise ValueError("the stream is closed")
        if self._broken:
            raise FastqError("the stream failed before")
        if n < 1:
            raise ValueError("n must be positive")
        rows = []
        try:
            for r in self._records:
                rows.append((self._read + len(rows) + 1, *r))
                if len(rows) == n:
                    break
        except FastqError:
            self._broken = True
            raise
        if len(rows) < n:
            self.done = True
        if not rows:
            return None
        self._read += len(rows)
        self.letters += sum(len(r[3]) for r in rows)
        # By Arrow, which makes a small local relation that goes with the table.
        kinds = [pa.int64(), *[pa.string()] * 5]
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["read_key", "seq_id", "seq_comment", "seq", "qual", "plus"])
        return self.spark.createDataFrame(table)

    def close(self) -> None:
        self._records = None


def rejections(reads: DataFrame) -> DataFrame:
    """One row: why rows cannot be written, each with its number of rows; a row may count for several reasons."""
    breaks = F.lit(False)
    for c in ("seq_id", "seq_comment", "seq", "qual"):
        breaks = breaks | F.coalesce(F.col(c).rlike("[\r\n]"), F.lit(False))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return reads.agg(n(F.col("seq_id").isNull()).alias("missing_ids"), n(F.col("qual").isNull()).alias("missing_qualities"), n(F.length("seq") != F.length("qual")).alias("lengths_that_differ"), n(breaks).alias("line_breaks"))


def check_writable(reads: DataFrame) -> None:
    """Refuses missing ids or qualities, lengths that differ, and line breaks in any field; one pass."""
    if wrong := {k.replace("_", " "): v for k, v in rejections(reads).first().asDict().items() if v}:
        raise ValueError(f"cannot be written: {wrong}")


def write_fastq_parts(reads: DataFrame, path: str, order: str = "read_key", phred_offset: int = 33) -> None:
    """A folder of gzip parts in the order of keys, written by all executors; a ``plus`` column goes back to its line."""
    from readloom.operators.reformat import fastq

    check_writable(reads)
    ranged = reads.repartitionByRange(order).sortWithinPartitions(order)
    qual = F.col("qual") if phred_offset == OFFSET else recoded(F.col("qual"), phred_offset)
    plus = F.col("plus") if "plus" in reads.columns else None
    ranged.select(fastq(F.col("seq_id"), F.col("seq_comment"), F.col("seq"), qual, plus).alias("value")).write.option("compression", "gzip").text(path)


def write_fastq(reads: DataFrame, path: str, order: str = "read_key", append: bool = False, phred_offset: int = 33) -> str:
    """One file in the order of keys, packed if its name ends in ``.gz``; replaced only when it is complete.

    Executors write packed parts into a staging folder beside the target, on a file system that all of them share with the
    driver, as for any single local file; ``write_fastq_parts`` has no such need.  The driver only copies bytes.
    """
    packed, there = path.endswith(".gz"), append and os.path.exists(path) and os.path.getsize(path) > 0
    if there:
        with open(path, "rb") as f:
            if (f.read(2) == b"\x1f\x8b") != packed:
                raise ValueError("compression and suffix disagree")
        if packed:
            with gzip.open(path) as f:  # a broken file is an error here, before it is touched
                while f.read(1 << 20):
                    pass
    stage = tempfile.mkdtemp(prefix=".stage-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        write_fastq_parts(reads, f"file://{stage}/parts", order, phred_offset)
        with open(f"{stage}/whole", "wb") as out:
            if there:
                with open(path, "rb") as old:
                    shutil.copyfileobj(old, out)
                if not _ends_with_break(path):
                    out.write(gzip.compress(b"\n") if packed else b"\n")
            for name in sorted(n for n in os.listdir(f"{stage}/parts") if n.startswith("part-")):
                with (open if packed else gzip.open)(f"{stage}/parts/{name}", "rb") as part:
                    shutil.copyfileobj(part, out)
        os.replace(f"{stage}/whole", path)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return path


def _ends_with_break(path: str) -> bool:
    last = b"\n"
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        while block := f.read(1 << 20):
            last = block[-1:]
    return last == b"\n"
