import gzip
import os

import pytest
from pyspark.sql import functions as F

from readloom.operators import reads as rd
from readloom.plans import sinks
from readloom.plans import workflows as wf
from readloom.sources import builtin_layouts, layouts, tables

PRIMER, REVERSE = "CTACACGACGCTCTTCCGATCT", "ACTCTGCGTTGATACCACTGCTT"
BARCODES, UMI = ["GACCTAGTTCAGGATC", "CAGTTCGATGACCTGA"], "AACCGTACGTCG"
INSERT = "GACTCGACTAGCTACGATCGTAGCATGCTAGCTGACTAGCA" * 4
RC = str.maketrans("ACGT", "TGCA")


def molecules():
    forward = [PRIMER + BARCODES[i % 2] + UMI + "T" * 20 + INSERT[:n] + REVERSE for i, n in enumerate((60, 80, 100, 120))]
    return forward + [s.translate(RC)[::-1] for s in forward]


@pytest.fixture(scope="module")
def reads(spark):
    s = molecules()
    return rd.pack_reads(spark, [f"read{i}" for i in range(len(s))], s, ["I" * len(x) for x in s])


def lists(spark):
    return spark.createDataFrame([(b,) for b in BARCODES], "barcode string")


def test_builtin_layouts():
    assert len(builtin_layouts.keys()) == 7
    hd = builtin_layouts.load("visium_hd")
    assert [e.lengths for e in hd if e.cls == "barcode"] == [(15, 16), (14, 15)]
    for k in builtin_layouts.keys():
        pattern, names = layouts.read_pattern(builtin_layouts.load(k))
        assert "read" in names
    with pytest.raises(ValueError):
        builtin_layouts.load("nothing")


def test_demultiplexing_with_every_kind_of_list(spark, reads):
    layout = builtin_layouts.load("three_prime")
    for kw in ({"custom_whitelist": lists(spark)}, {"auto": True}, {"whitelists": {"10x_3v3": lists(spark)}, "whitelist_mutation": 1}):
        out = wf.demultiplex(reads, layout, **kw)
        rows = {r["read_key"]: r for r in out.tables["records"].collect()}
        assert len(rows) == 8 and all(r["passing"] and r["umi"] == UMI for r in rows.values())
        assert [rows[i]["strand"] for i in range(1, 9)] == ["F"] * 4 + ["R"] * 4
        assert rows[2]["cdna"] == INSERT[:80] and rows[6]["cdna"] == INSERT[:80].translate(RC)[::-1] and rows[6]["barcode"] == BARCODES[1]
        head = {r["read_key"]: r["header"] for r in out.tables["headers"].collect()}
        assert head[5] == f"read4-R TS:A:- CB:Z:{BARCODES[0]} CR:Z:{BARCODES[0]} UB:Z:{UMI}"
        assert {r["true_bc"]: r["total_count"] for r in out.tables["counters"].collect()} == dict.fromkeys(BARCODES, 4)
    assert wf.demultiplex(reads, layout, custom_whitelist=lists(spark), max_reads=3).tables["records"].count() == 3
    with pytest.raises(ValueError):
        wf.demultiplex(reads, layout, auto=True, custom_whitelist=lists(spark))
    with pytest.raises(ValueError):
        wf.demultiplex(reads, layout)
    with pytest.raises(ValueError):
        wf.auto_whitelist(reads.where("false"), layout)


def test_discovery_infers_a_layout_that_demultiplexes(spark, reads):
    cat = lists(spark).withColumn("catalog", F.lit("local"))
    out = wf.discovered(reads, [("forw_primer", PRIMER), ("poly", "T" * 20), ("rev_primer", REVERSE)], cat, PRIMER)
    assert out.tables["parts"].where("id = 'forw_primer'").first()[1:] == (4, 4)
    row = out.tables["whitelists"].first()
    assert (row["matched_reads"], row["matched_distinct"], row["status"]) == (8, 2, "matched")
    assert out.notes["layout_complete"]
    got = [(e.cls, e.length) for e in out.notes["layout"] if e.kind == "variable"]
    assert got == [("barcode", 16), ("umi", 12), ("read", None)]
    layout = [e if e.cls != "barcode" else layouts.Element("barcode", "variable", "barcode", lengths=(16,), whitelist="w") for e in out.notes["layout"]]
    same = wf.demultiplex(reads, layout, {"w": lists(spark)}).tables["records"].select("read_key", "barcode", "umi", "cdna")
    want = wf.demultiplex(reads, builtin_layouts.load("three_prime"), {"10x_3v3": lists(spark)}).tables["records"].select("read_key", "barcode", "umi", "cdna")
    assert same.exceptAll(want).isEmpty() and want.exceptAll(same).isEmpty()


def test_scan_modes(spark, reads):
    out = wf.scan_whitelist(reads, PRIMER, 16, max_error=0.1, whitelist=lists(spark))
    assert sorted(r["count"] for r in out.tables["called"].where("selected").collect()) == [4, 4]
    rescan = wf.scan_whitelist(counts=spark.createDataFrame([("AAAA", 100), ("CCCC", 80), ("GGGG", 2), ("TTTT", 1)], "barcode string, count long"))
    assert sorted(r["barcode"] for r in rescan.tables["called"].where("selected").collect()) == ["AAAA", "CCCC"]
    slide = spark.createDataFrame([(BARCODES[0], 1, 2)], "barcode string, array_row int, array_col int")
    placed = wf.scan_whitelist(reads, platform="visium-hd", adapter=PRIMER, slide=slide, selection="above_floor")
    assert placed.tables["coordinates"].count() == 1 and placed.tables["regions"].first()["occupied_2um_spots"] == 1
    b = lists(spark)
    for bad in (
        {"reads": reads},
        {},
        {"reads": reads, "adapter": "A", "bc1": b},
        {"reads": reads, "adapter": "A", "bc1": b, "bc2": b, "whitelist": b},
        {"counts": b, "whitelist": b},
        {"reads": reads, "adapter": "NA", "capture_mode": "masked", "left_margin": 1},
        {"reads": reads, "adapter": "A", "max_error": 2},
    ):
        with pytest.raises(ValueError):
            wf.scan_whitelist(**bad)
    assert "spark" in wf.engine_info(spark)


def test_reformatting(spark):
    r = rd.pack_reads(spark, ["a", "b"], ["AC", "GT"], ["II", "II"], ["CB:Z:AAAA UB:Z:CC", None])
    out = wf.reformatted(r, header="collapsed", to_fasta=True)
    assert {x["record"] for x in out.tables["records"].collect()} == {">a_AAAA_CC\nAC", ">b\nGT"}
    assert out.tables["stats"].first()["skipped_missing_cb"] == 1
    for bad in ({}, {"header": "x"}, {"header": "presto", "collapsed_input": True}):
        with pytest.raises(ValueError):
            wf.reformatted(r, **bad)


def test_spatial_reformatting(spark):
    r = rd.pack_reads(spark, ["a", "b", "c"], ["AC", "", "GT"], ["II", "", "II"], ["CB:Z:AAAACCCC UB:Z:TG ZZ:Z:keep", "CB:Z:AAAACCCC", "CB:Z:TTTT"])
    m = spark.createDataFrame([("AAAACCCC", 5, 9, 1, "cellA")], "barcode string, array_row int, array_col int, in_tissue int, cell_id string")
    out = wf.spatial_reformatted(r, "s1", m, bin_size=4)
    rows = {x["seq_id"]: x["seq_comment"] for x in out.tables["records"].collect()}
    assert rows["a"] == "CB:Z:s_004um_00002_00004-1 UB:Z:TG ZZ:Z:keep XB:Z:AAAACCCC XS:Z:s1 XP:Z:s_002um_00005_00009-1" and rows["c"] == "CB:Z:TTTT"
    assert {x["status"]: x["n"] for x in out.tables["summary"].collect()} == {"assigned": 2, "unknown_barcode": 1}
    strict = wf.spatial_reformatted(r, "s1", m, unit="cell", tissue_only=True, strict=True)
    assert strict.tables["records"].count() == 2
    axes = spark.createDataFrame([("AAAA", 7)], "barcode string, array_col int"), spark.createDataFrame([("CCCC", 3)], "barcode string, array_row int")
    assert wf.spatial_reformatted(r, "s", axes=axes, length1=4).tables["summary"].where("status = 'assigned'").first()["n"] == 2
    for bad in ({"sample": "a b", "slide": m}, {"sample": "x"}, {"sample": "x", "slide": m, "axes": axes}):
        with pytest.raises(ValueError):
            wf.spatial_reformatted(r, **bad)


def test_side_tables(spark, tmp_path):
    put = lambda n, t: (p := tmp_path / n, p.write_bytes(gzip.compress(t.encode()) if n.endswith("gz") else t.encode()))[0]
    c = tables.count_table(spark, str(put("c.csv", "barcode,count\nAAAA,100\nCCCC\t80\nGGGG 2\n\n")))
    assert sorted(map(tuple, c.collect())) == [("AAAA", 100), ("CCCC", 80), ("GGGG", 2)]
    assert tables.whitelist_file(spark, str(put("w.txt", "whitelist_bcs\nacgt\r\n ACGT \n"))).count() == 1
    with pytest.raises(ValueError):
        tables.whitelist_file(spark, str(put("none.txt", "header\n")))
    m = tables.slide_map(spark, str(put("m.tsv", "barcode\tarray_row\tarray_col\nAAAA\t1\tx\n")))
    assert m.select("barcode", "array_row", "array_col", "cell_id").first()[:] == ("AAAA", 1, None, None)
    with pytest.raises(ValueError):
        tables.slide_map(spark, str(put("d.tsv", "barcode\tx\nAAAA\t1\nAAAA\t2\n")))
    (tmp_path / "visium").mkdir()
    put("visium/s1.tsv.gz", "barcode\tx\nAAAA\t1\n")
    assert tables.registered_map(spark, str(tmp_path), "visium", "s1").count() == 1
    with pytest.raises(ValueError):
        tables.registered_map(spark, str(tmp_path), "..", "s1")
    put("r.fq", "")
    runs = tables.batch(str(put("b.csv", "input,output_prefix\nr.fq, out\n")))
    assert [os.path.basename(r.output_prefix) for r in runs] == ["out"]
    for bad in ("input,output\n", "r.fq\n", "r.fq,o\nr.fq,o\n", "r.fq,r.fq\n"):
        with pytest.raises(ValueError):
            tables.batch(str(put("bad.csv", bad)))
    with pytest.raises(FileNotFoundError):
        tables.batch(str(put("miss.csv", "none.fq,o\n")))


def test_sinks(spark, tmp_path):
    r = rd.pack_reads(spark, ["a", "b", "c"], ["AC", "GT", "TT"], ["II", "II", "II"], ["CB:Z:AAAA", "CB:Z:CCCC", None])
    p = str(tmp_path / "saved")
    sinks.save(r, p)
    assert rd.validate(sinks.load(spark, p), deep=True) and sinks.load(spark, p).count() == 3
    with pytest.raises(ValueError):
        sinks.load(spark, str(tmp_path / "other"))
    out = str(tmp_path / "split")
    sinks.split_by_barcode(r, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("CB=")) == ["CB=AAAA", "CB=CCCC"]
    with pytest.raises(ValueError):
        sinks.split_by_barcode(rd.pack_reads(spark, ["a"], ["A"], ["I"], ["CB:Z:../x"]), str(tmp_path / "bad"))
    paths = sinks.write_tables({"n.csv": r.select("seq_id", F.lit('a,"b')), "n.tsv.gz": r.select("read_key")}, str(tmp_path / "t"))
    assert open(paths["n.csv"]).read().splitlines()[1] == 'a,"a,""b"'
    assert gzip.open(paths["n.tsv.gz"], "rt").read().startswith("read_key\n")
    with pytest.raises(FileExistsError):
        sinks.write_tables({"n.csv": r.select("seq_id")}, str(tmp_path / "t"), overwrite=False)


def test_bounded_tables_are_whole_or_an_error(spark):
    from readloom.plans.shape import few

    assert len(few(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        few(spark.range(6), 5)
