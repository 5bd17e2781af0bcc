import json
import os
import time

import pytest
from pyspark.sql import functions as F

from readloom.operators import discover
from readloom.operators import reads as rd
from readloom.plans import publish as pb
from readloom.plans import sinks
from readloom.plans.cancel import Cancelled, Running
from readloom.plans.workflows import demultiplex, discovered, scan_batch, scan_whitelist, spatial_reformatted
from readloom.sources import fastq as fq
from readloom.sources.layouts import Element
from readloom.sources.tables import spot_metadata


def test_work_can_be_cancelled(spark):
    def work():
        slow = F.udf(lambda x: time.sleep(0.5) or x, "long")
        return spark.range(0, 2000, 1, 4).select(slow("id").alias("x")).agg(F.sum("x")).collect()

    r = Running(spark, work)
    time.sleep(2)
    began = time.time()
    r.cancel()
    with pytest.raises(Cancelled):
        r.result()
    assert time.time() - began < 60
    done = Running(spark, lambda: spark.range(3).count())
    assert done.result() == 3
    done.cancel()
    with pytest.raises(ZeroDivisionError):
        Running(spark, lambda: 1 // 0).result()


def test_a_cached_pair_is_used_whole_or_not_at_all(tmp_path):
    calls = []

    def make():
        calls.append(1)
        return {"a": 1}, [len(calls)]

    folder = str(tmp_path / "cache")
    assert pb.cached_pair(folder, "k", make) == ({"a": 1}, [1]) == pb.cached_pair(folder, "k", make)
    one = next(n for n in os.listdir(folder) if n.endswith("positions.json"))
    os.remove(os.path.join(folder, one))
    assert pb.cached_pair(folder, "k", make)[1] == [2]
    with open(os.path.join(folder, one)) as f:
        other = json.load(f)
    other["pair"] = "x"
    with open(os.path.join(folder, one), "w") as f:
        json.dump(other, f)
    assert pb.cached_pair(folder, "k", make)[1] == [3] and pb.cached_pair(folder, "k", make)[1] == [3]
    assert pb.cached_pair(folder, "other", make)[1] == [4]


def test_batches_and_artifacts(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.fq").write_text("".join(f"@r{j}\nCCACGTTGCAAC{'ACGT' * 4}TT\n+\n{'I' * 30}\n" for j in range(3 + i)))
    (tmp_path / "batch.csv").write_text("input,output\n0.fq,out0\n1.fq,out1\n")
    results = scan_batch(spark, str(tmp_path / "batch.csv"), adapter="ACGTTGCAAC", max_error=0.0)
    assert [os.path.basename(p) for p in results] == ["out0", "out1"]
    for prefix, r in results.items():
        assert sorted(os.path.basename(p) for p in sinks.scan_artifacts(r, prefix).values()) == [os.path.basename(prefix) + e for e in (".csv", ".txt")]
    assert (tmp_path / "out1.csv").read_text() == "barcode,count,selected\nACGTACGTACGTACGT,4,True\n"
    assert (tmp_path / "out0.txt").read_text() == "barcode\nACGTACGTACGTACGT\n"


def test_spatial_selection_and_native_names(spark):
    slide = spark.createDataFrame([("AAAA", 0, 0, 1, None), ("CCCC", 0, 1, 1, None)], "barcode string, array_row int, array_col int, in_tissue int, cell_id string")
    counts = spark.createDataFrame([("s_002um_00000_00001-1", 1), ("AAAA", 90), ("GGGG", 5), ("s_002um_00009_00009", 5)], "barcode string, count long")
    for how, more in (("abundance", []), ("legacy", [("CCCC", 1)])):
        out = scan_whitelist(counts=counts, slide=slide, platform="visium-hd", spatial_selection=how)
        assert sorted((r["barcode"], r["count"]) for r in out.tables["coordinates"].collect()) == [("AAAA", 90), *more]
    with pytest.raises(ValueError):
        scan_whitelist(counts=counts, spatial_selection="x")


def test_spatial_export_and_conflicting_tags(spark, tmp_path):
    slide = spark.createDataFrame([("AAAA", 1, 2, 1, None)], "barcode string, array_row int, array_col int, in_tissue int, cell_id string")
    r = rd.pack_reads(spark, ["a", "b", "c"], ["AC", "GT", "A"], ["II", "II", "I"], ["CB:Z:AAAA", "CB:Z:AAAA XP:Z:old", None])
    out = spatial_reformatted(r, "s1", slide)
    assert sorted((x["read_key"], x["status"]) for x in out.tables["assignments"].collect()) == [(1, "assigned"), (2, "invalid_tags"), (3, "missing_barcode")]
    folder = str(tmp_path / "new")
    paths = sinks.spatial_export(out, folder)
    assert sorted(n for n in os.listdir(folder) if n[0] != ".") == ["assignments.tsv.gz", "reads.fastq.gz", "summary.tsv"]
    assert fq.read_fastq(spark, paths["reads.fastq.gz"]).orderBy("read_key").first()["seq_comment"] == "CB:Z:s_002um_00001_00002-1 XB:Z:AAAA XS:Z:s1 XP:Z:s_002um_00001_00002-1"
    with pytest.raises(FileExistsError):
        sinks.spatial_export(out, folder)
    for bad in (dict(bin_size=3), dict(unit="cell", bin_size=4), dict(unit="x")):
        with pytest.raises(ValueError):
            spatial_reformatted(r, "s1", slide, **bad)


def test_discovery_tables_and_metadata(spark, tmp_path):
    reads = spark.createDataFrame([(i, "ACGTACGTAA" + "T" * 28 + "GGCCGGCCTT") for i in range(5)], "read_key long, seq string")
    found = discovered(reads, [("x", "ACGTACGTAA"), ("y", "GGCCGGCCTT")])
    names = sorted(os.path.basename(p) for p in sinks.discovery_tables(found, str(tmp_path / "d")).values())
    assert "d_parts.csv" in names and any(n.startswith("d_layout") for n in names)
    (tmp_path / "m.tsv").write_text("barcode\tin_tissue\tcell_id\ns_002um_00003_00004-1\t1\tc7\nbad\t1\tx\n")
    assert [tuple(r) for r in spot_metadata(spark, str(tmp_path / "m.tsv")).collect()] == [(3, 4, 1, "c7")]
    assert discover.usable_parts(spark.createDataFrame([("a", "ACG")], "id string, seq string")).count() == 0


def test_barcodes_move_within_their_window(spark):
    layout = [Element("p", "static", "", "ACGTTGCAAC"), Element("barcode", "variable", "barcode", lengths=(8,), whitelist="w"), Element("umi", "variable", "umi", lengths=(4,)), Element("t", "variable", "poly_t"), Element("read", "variable", "read")]
    lists = {"w": spark.createDataFrame([("GGCATTCA",)], "barcode string")}
    read = "ACGTTGCAAC" + "C" + "GGCATTCA" + "ACAC" + "TTTT" + "GATTACA"
    reads = spark.createDataFrame([(1, "r1", read, "I" * len(read)), (2, "r2", read.replace("AACC", "AAC"), "I" * (len(read) - 1))], "read_key long, seq_id string, seq string, qual string")
    out = demultiplex(reads, layout, lists, pad=4, debug=True)
    got = {r["read_key"]: (r["barcode"], r["barcode_kind"], r["umi"], r["cdna"]) for r in out.tables["records"].collect()}
    assert got == {1: ("GGCATTCA", "located", "ACAC", "GATTACA"), 2: ("GGCATTCA", "exact", "ACAC", "GATTACA")}
    assert len(out.tables["debug"].columns) == 8 and out.tables["debug"].count() == 2
    with pytest.raises(ValueError):
        demultiplex(reads, layout, lists, correction_policy="x").tables["records"].collect()
