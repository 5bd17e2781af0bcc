import gzip
import io
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from readloom.operators import reads as rd
from readloom.plans import publish as pb
from readloom.plans import store_queries
from readloom.plans.scratch import written
from readloom.sources import fastq as fq
from readloom.streaming import counts

FASTQ = "@a first\nACGT\n+\nIIII\n@b\n\n+payload\n\n@c x y\nAC\nGT\n+\n@I\nII\n"


def put(path, text, packed=False):
    (gzip.open if packed else open)(path, "wt").write(text) if not packed else Path(path).write_bytes(gzip.compress(text.encode()))
    return str(path)


@pytest.mark.parametrize("packed", [False, True])
def test_reads_fastq(spark, tmp_path, packed):
    p = put(tmp_path / ("x.fastq.gz" if packed else "x.fastq"), FASTQ, packed)
    rows = [tuple(r)[1:7] for r in fq.read_fastq(spark, p).orderBy("read_key").collect()]
    assert rows == [(1, "a", "first", "ACGT", "IIII", None), (2, "b", None, "", "", "payload"), (3, "c", "x y", "ACGT", "@III", None)]
    assert fq.read_fastq(spark, p, 2).count() == 2


def test_fasta_empty_and_broken(spark, tmp_path):
    assert [r["seq"] for r in fq.read_fastq(spark, put(tmp_path / "x.fa", ">a\nAC\nGT\n>b\n\n")).collect()] == ["ACGT", ""]
    assert fq.read_fastq(spark, put(tmp_path / "empty.fq", "")).count() == 0
    for i, bad in enumerate(["@a\nACGT\n+\nIII", "@a\nACGT\n", "@a\nAC\n+\nII\n>b\nAC\n", "ACGT\n", "@a\nAC\n+\nIIII\n"]):
        with pytest.raises(fq.FastqError):
            list(fq.records(put(tmp_path / f"bad{i}.fq", bad)))
    whole = gzip.compress(FASTQ.encode())
    (tmp_path / "cut.fq.gz").write_bytes(whole[:-8])
    (tmp_path / "crc.fq.gz").write_bytes(whole[:-8] + b"\0" * 8)
    for name in ("cut", "crc"):
        with pytest.raises(fq.FastqError):
            list(fq.records(str(tmp_path / f"{name}.fq.gz")))


def test_pull_stream(spark, tmp_path):
    s = fq.FastqStream(spark, put(tmp_path / "x.fq", FASTQ))
    assert s.next(2).count() == 2 and not s.done
    assert [r["read_key"] for r in s.next(2).collect()] == [3] and s.done and s.next(2) is None
    s.close()
    s.close()
    with pytest.raises(ValueError):
        s.next()
    b = fq.FastqStream(spark, put(tmp_path / "y.fq", FASTQ + "@d\nAC\n"))
    with pytest.raises(fq.FastqError):
        b.next()
    with pytest.raises(fq.FastqError):
        b.next()


@pytest.mark.parametrize("name", ["out.fastq", "out.fastq.gz"])
def test_writes_and_appends(spark, tmp_path, name):
    r = rd.pack_reads(spark, ["a", "b", "c"], ["ACGT", "", "GG"], ["IIII", "", "55"], ["x y", None, ""])
    p = str(tmp_path / name)
    fq.write_fastq(r, p)
    fq.write_fastq(r, p, append=True)
    text = (gzip.open if name.endswith("gz") else open)(p, "rt").read()
    assert text == "@a x y\nACGT\n+\nIIII\n@b\n\n+\n\n@c\nGG\n+\n55\n" * 2
    assert fq.read_fastq(spark, p).count() == 6
    assert os.listdir(tmp_path) == [name]
    for bad in (r.withColumn("qual", F.lit(None).cast("string")), r.withColumn("seq_id", F.lit("a\nb"))):
        with pytest.raises(ValueError):
            fq.write_fastq(bad, p)


def test_stream_source(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        put(src / f"{i}.fq", FASTQ)
    spark.dataSource.register(fq.FastqSource)
    stream = spark.readStream.format("fastq").option("filesPerBatch", "2").load(str(src))
    q = counts.barcode_counts(stream, "seq_id").writeStream.outputMode("complete").format("memory").queryName("fq_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("fq_counts").collect()} == {("a", 3), ("b", 3), ("c", 3)}


def test_runs_to_the_end_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(30).selectExpr("id % 3 as bc", "timestamp_seconds(id * 600) as t").repartition(3).write.parquet(src)
    stream = counts.stream_parquet(spark, src)
    assert {tuple(r) for r in counts.run_to_end(counts.barcode_counts(stream, "bc"), "a").collect()} == {(0, 10), (1, 10), (2, 10)}
    late = counts.run_to_end(counts.late_counts(stream, "t", "bc", "1 hour", "10 hours"), "b", "append")
    assert late.where("count <> 2").count() == 0


def test_hand_over_keeps_order(spark):
    out = io.StringIO()
    df = spark.range(100).repartition(7).selectExpr("id", "concat(id, '\n') as t")
    assert counts.hand_over(df, "t", ["id"], out) == 100
    assert out.getvalue() == "".join(f"{i}\n" for i in range(100))


def test_scratch_tables(spark):
    df = written(spark.range(10).selectExpr("id", "cast(null as string) as t"), "test")
    assert df.count() == 10 and df.schema["t"].dataType.simpleString() == "string"


def test_publish(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    Path(a).write_text("old")
    pb.publish({a: lambda p: Path(p).write_text("1"), b: lambda p: Path(p).write_text("2")})
    assert (Path(a).read_text(), Path(b).read_text()) == ("1", "2")

    def fails(p):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        pb.publish({a: lambda p: Path(p).write_text("3"), b: fails})
    assert Path(a).read_text() == "1"
    with pytest.raises(FileExistsError):
        pb.publish({a: lambda p: Path(p).write_text("4")}, overwrite=False)
    os.link(a, tmp_path / "c")
    with pytest.raises(ValueError):
        pb.guard([a], [str(tmp_path / "c")])


def test_resources(tmp_path):
    (tmp_path / "w.gz").write_bytes(b"data")
    import hashlib

    m = {"w": {"path": "w.gz", "bytes": 4, "sha256": hashlib.sha256(b"data").hexdigest()}, "bad": {"path": "w.gz", "bytes": 4, "sha256": "0"}, "out": {"path": "../x", "bytes": 1, "sha256": ""}}
    assert pb.resource("w", m, str(tmp_path)).endswith("w.gz") and pb.resource("bad", m, str(tmp_path)) is None
    with pytest.raises(ValueError):
        pb.resource("out", m, str(tmp_path))
    with pytest.raises(KeyError):
        pb.resource("none", m, str(tmp_path))
    with pytest.raises(ValueError):
        pb.clear_cache(str(tmp_path / "cache"))
    assert pb.clear_cache(str(tmp_path / "cache"), confirm=True) is False


def test_keys_are_unique_in_a_folder_and_limits_hold_for_all_of_it(spark, tmp_path):
    for i in range(3):
        put(tmp_path / f"{i}.fq", FASTQ)
    r = fq.read_fastq(spark, str(tmp_path))
    keys = [x["read_key"] for x in r.orderBy("read_key").collect()]
    assert len(set(keys)) == 9 and keys[:3] == [1, 2, 3]
    assert fq.read_fastq(spark, str(tmp_path), 4).count() == 4
    assert [x["read_key"] for x in r.where("read_key <= 2").orderBy("read_key").collect()] == [1, 2]
    assert [x["seq_comment"] for x in fq.read_fastq(spark, str(tmp_path / "0.fq"), keep_comment=False).collect()] == [None] * 3
    first = r.orderBy("read_key").first()
    assert (first["length"], first["mean_q"], first["min_q"], first["frac_q20"]) == (4, 40.0, 40, 1.0)


def test_phred_offsets_go_round(spark, tmp_path):
    r = rd.pack_reads(spark, ["a"], ["ACGT"], ["@h~@"], phred_offset=64)
    assert r.first()["qual"] == "!I_!" and r.first()["min_q"] == 0
    p = fq.write_fastq(r, str(tmp_path / "x.fq"), phred_offset=64)
    assert "\n@h~@\n" in Path(p).read_text()
    assert fq.read_fastq(spark, p, phred_offset=64).first()["qual"] == "!I_!"
    for bad in (rd.pack_reads(spark, ["a"], ["A"], ["!"], phred_offset=64), fq.read_fastq(spark, put(tmp_path / "y.fq", "@a\nA\n+\n!\n"), phred_offset=64)):
        with pytest.raises(Exception, match="Phred offset"):
            bad.collect()


def test_folders_of_files_give_their_own_headers(spark, tmp_path):
    from readloom.plans.workflows import demultiplex
    from readloom.sources.layouts import Element

    layout = [Element("p", "static", "", "ACGTTGCAAC"), Element("barcode", "variable", "barcode", lengths=(4,), whitelist="w"), Element("umi", "variable", "umi", lengths=(3,)), Element("read", "variable", "read")]
    for i in range(2):
        put(tmp_path / f"{i}.fq", "".join(f"@r{i}{j}\nACGTTGCAACTTGG{'ACG'}CCCN{'A' * 5}\n+\n{'I' * 17}ABCDEFGHI\n" for j in range(2)))
    out = demultiplex(fq.read_fastq(spark, str(tmp_path)), layout, {"w": spark.createDataFrame([("TTGG",)], "barcode string")})
    heads = sorted(r["header"].split("-")[0] for r in out.tables["headers"].collect())
    assert heads == ["r00", "r01", "r10", "r11"]
    records = out.tables["fastq"].orderBy("read_key").collect()
    assert [(r["seq_id"], r["seq"], r["qual"]) for r in records][0] == ("r00-F", "CCCAAAAA", "ABCEFGHI")
    assert records[0]["seq_comment"] == "TS:A:+ CB:Z:TTGG CR:Z:TTGG UB:Z:ACG"
    from readloom.plans.sinks import demux_artifacts

    (tmp_path / "out").mkdir()
    paths = demux_artifacts(out, str(tmp_path / "out" / "run"))
    assert sorted(paths) == ["run.fastq.gz", "run_counters.csv.gz", "run_stats.csv", "run_whitelist_true.csv.gz"]
    assert gzip.open(paths["run_whitelist_true.csv.gz"], "rt").read() == "barcode\nTTGG\n"
    assert gzip.open(paths["run.fastq.gz"], "rt").read().startswith("@r00-F TS:A:+ CB:Z:TTGG CR:Z:TTGG UB:Z:ACG\nCCCAAAAA\n+\nABCEFGHI\n@r01-F")


def test_rewrite_keeps_the_plus_line_and_refuses_missing_quality(spark, tmp_path):
    from readloom.plans.sinks import rewrite
    from readloom.plans.workflows import reformatted

    p = put(tmp_path / "x.fq", FASTQ.replace("@c x y\nAC\nGT", "@c x y\nACGT").replace("@I\nII", "@III"))
    before = Path(p).read_text()
    rewrite(spark, p)
    assert Path(p).read_text() == before
    rewrite(spark, p, lambda r: r.withColumn("seq_id", F.concat("seq_id", F.lit("/1"))))
    assert Path(p).read_text() == before.replace("@a", "@a/1").replace("@b", "@b/1").replace("@c", "@c/1")
    r = rd.pack_reads(spark, ["a"], ["ACGT"])
    with pytest.raises(Exception, match="without quality"):
        reformatted(r, "collapsed").tables["records"].collect()


def test_plain_files_are_read_in_stretches(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(400):
        n = rng.randrange(0, 30)
        rows.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+I>") for _ in range(n))))
    p = put(tmp_path / "x.fq", "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in rows))
    for size in (211, 5000):
        got = fq.read_fastq(spark, p, split_bytes=size)
        assert [(r["seq_id"], r["seq"], r["qual"]) for r in got.orderBy("read_key").collect()] == rows
        assert got.select("read_key").distinct().count() == 400


def test_pulled_chunks_leave_the_driver(spark, tmp_path, monkeypatch):
    """The plan of a query over a pull stream does not hold the tables that were pulled."""
    reads = rd.pack_reads(spark, [f"r{i}" for i in range(66_500)], ["ACGT"] * 66_500, ["IIII"] * 66_500, [None] * 66_500)
    monkeypatch.setattr(store_queries, "_sound", lambda spark, sf: reads)
    out = store_queries.fastq_pull_stream(spark, "")
    assert "LocalRelation" not in out._jdf.queryExecution().optimizedPlan().toString() and out.rdd.getNumPartitions() < 20
    assert sorted(map(tuple, out.collect())) == [(i, min(1000, 66_500 - 1000 * i), 4 * min(1000, 66_500 - 1000 * i), 1000 * i + 1) for i in range(67)]
