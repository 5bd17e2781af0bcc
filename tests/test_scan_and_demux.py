import random
import time

import pytest
from pyspark.sql import functions as F

from readloom.functions.dna import revcomp
from readloom.operators import align, concat, demux, discover, reformat, scan, spatial, whitelist
from readloom.plans import workflows
from readloom.sources import layouts

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def reads(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs, 1)], "read_key long, seq string")


def col(df, c):
    return sorted(r[c] for r in df.collect())


def test_adapters_on_both_strands(spark):
    r = reads(spark, "TTAGTCCGTAGACATT", rc("TTAGTCCGTAGACATT"), "AGTCCGTAGA", "CCCC", "", None)
    found = scan.located(r, "seq", "AGTCCGTA")
    assert col(scan.captured(found, 4), "barcode") == ["GACA", "GACA"]
    assert col(scan.captured(found, 4, 1, 1), "barcode") == ["ACATT", "ACATT"]


def test_fuzzy_adapters_shift_the_barcode(spark):
    seqs = ["AGTCACGTAGACA", "AGTCGTATTGC", "GGGGGGGGGGG"]
    r = reads(spark, *seqs, *map(rc, seqs[:2]))
    found = scan.located_fuzzy(r, "seq", "AGTCCGTA", 0.13)
    assert col(scan.captured(found, 4), "barcode") == ["GACA", "GACA", "TTGC", "TTGC"]


def test_masked_capture(spark):
    s = "ACAGTCCGTATTGA"
    r = reads(spark, s, rc(s), "ANAGTCCGTATTGA", "ACAGTNCGTATTGA")
    assert col(scan.masked(r, "seq", "NNAGTCCGTAnnNN"), "barcode") == ["ACGA", "ACGA"]


def test_split_scan(spark):
    bc1, bc2 = (spark.createDataFrame([(x,) for x in v], "b string") for v in (["AACC", "CCGG"], ["TTGA", "GGTT"]))
    make = lambda pad, a, b: "AGTCCGTA" + "GG" + "T" * pad + a + b + "CC"
    r = reads(spark, make(0, "AACC", "TTGA"), make(1, "AACC", "TTGA"), rc(make(3, "CCGG", "GGTT")), make(4, "CCGG", "GGTT"), make(0, "AACC", "CCCC"))
    got = scan.split_scan(r, "read_key", "seq", "AGTCCGTA", bc1, bc2, 4, 4, umi_length=2)
    assert sorted((x["key"], x["bc1"], x["bc2"], x["offset"], x["strand"]) for x in got.collect()) == [(1, "AACC", "TTGA", 0, "F"), (2, "AACC", "TTGA", 1, "F"), (3, "CCGG", "GGTT", 3, "R")]
    assert sorted(x["count"] for x in scan.counts(got, "bc1", "bc2").collect()) == [1, 2]
    with pytest.raises(ValueError):
        scan.split_scan(r, "read_key", "seq", "A", bc1, bc2, 4, 4, offset_min=2, offset_max=1)


@pytest.mark.parametrize(
    ("counts", "selection", "slide", "selected"),
    [
        ([100, 80, 2, 1], "high_specificity", False, [80, 100]),
        ([1, 1], "above_floor", False, [1, 1]),
        ([1, 1], "high_specificity", False, [1, 1]),
        ([1_000_000, 1], "above_floor", False, [1_000_000]),
        ([1_000_000, 1], "above_floor", True, [1, 1_000_000]),
        ([10, 5, 5], "above_floor", False, [5, 5, 10]),
    ],
)
def test_callers(spark, counts, selection, slide, selected):
    df = spark.createDataFrame([(f"B{i}", c) for i, c in enumerate(counts)], "barcode string, count long")
    assert col(scan.called(df, selection, slide).where("selected"), "count") == selected


def test_whitelists(spark):
    lines = spark.createDataFrame([(x,) for x in ["barcode", " acgt ", "ACGT\r", "TTTT", "", None, "AC-T"]], "barcode string")
    assert col(whitelist.cleaned(lines), "barcode") == ["ACGT", "TTTT"]
    packed = spark.createDataFrame([("27",), ("256",), ("x",), ("0",)], "barcode string")
    assert col(whitelist.cleaned(packed, packed_length=4), "barcode") == ["AAAA", "ACTG"]
    ref, sel = (spark.createDataFrame([(x,) for x in v], "barcode string") for v in (["A", "C", "G"], ["A", "C"]))
    assert sorted(map(tuple, whitelist.roles(sel, ref).collect())) == [("A", "true"), ("C", "true"), ("G", "global")]
    wl = spark.createDataFrame([("AAAA",), ("AATT",)], "barcode string")
    seen = spark.createDataFrame([("AAAA",), ("AAAC",), ("AAAT",), ("GGGG",), (None,)], "bc string")
    got = {r["bc"]: (r["true_bc"], r["kind"]) for r in whitelist.corrected(seen, "bc", whitelist.aliases(wl, 1)).collect()}
    assert got == {"AAAA": ("AAAA", "exact"), "AAAC": ("AAAA", "corrected"), "AAAT": (None, "ambiguous"), "GGGG": (None, "none"), None: (None, "none")}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_similarity_join_matches_brute_force(spark, cap):
    rng = random.Random(cap)
    words = lambda n: list({"".join(rng.choice("AC") for _ in range(rng.randrange(1, 12))) for _ in range(n)})
    a, b = words(60), words(60)
    x, y = spark.createDataFrame([(w,) for w in a] + [(None,)], "a string"), spark.createDataFrame([(w,) for w in b] + [(b[0],)], "b string")
    got = {tuple(r) for r in whitelist.similar(x, "a", y, "b", cap).collect()}
    assert got == {(p, q, levenshtein(p, q)) for p in a for q in b if levenshtein(p, q) <= cap}


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_infix_similarity_matches_brute_force(spark, cap):
    rng = random.Random(cap)
    a = list({"".join(rng.choice("AC") for _ in range(rng.randrange(1, 14))) for _ in range(50)})
    b = list({"".join(rng.choice("AC") for _ in range(rng.randrange(1, 9))) for _ in range(40)})
    code = "ACGTTGCATTGACCAG"
    a, b = [*a, "ACTG" + code + "TGCA", code[2:] + "GT"], [*b, code]
    x, y = spark.createDataFrame([(w,) for w in a] + [(None,)], "a string"), spark.createDataFrame([(w,) for w in b], "b string")
    got = {tuple(r) for r in whitelist.similar_infix(x, "a", y, "b", cap).collect()}
    best = lambda p, t: min(levenshtein(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    every = {(p, q, best(*sorted((p, q), key=len))) for p in a for q in b}
    assert got == {x for x in every if x[2] <= cap}
    assert ("ACTG" + code + "TGCA", code, 0) in got
    assert not whitelist.similar(x, "a", y, "b", cap).where(f"b = '{code}' and length(a) > 20").count()


def test_infix_distances_of_pairs_take_steps_at_once():
    """Pair by pair, 100 000 barcode and window pairs took some 15 seconds."""
    rng = random.Random(3)
    word = lambda lo, hi, letters="ACGT": "".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi)))
    p, t = [word(0, 70) for _ in range(300)] + [word(0, 9, "AÉ\0g") for _ in range(300)], [word(0, 70) for _ in range(300)] + [word(0, 9, "AÉ\0g") for _ in range(300)]
    assert align.infix_pairs(p, t).tolist() == [align.infix_one(x, y)[0] for x, y in zip(p, t)]
    assert align.infix_pairs([], []).tolist() == []
    codes, windows = [word(16, 17) for _ in range(1000)], [word(24, 25) for _ in range(1000)]
    began = time.process_time()
    many = align.infix_pairs([codes[i % 1000] for i in range(100_000)], [windows[i // 100] for i in range(100_000)])
    took = time.process_time() - began
    began = time.process_time()
    assert many[:2000].tolist() == [align.infix_one(codes[i % 1000], windows[i // 100])[0] for i in range(2000)]
    assert took < 50 * (time.process_time() - began) / 5


def test_generated_candidates_and_shifted_windows(spark):
    wl = spark.createDataFrame([("AAAA",), ("AATT",), ("GGGG",)], "barcode string")
    seen = spark.createDataFrame([("AAAT",), ("AAAA",), ("CCCC",), (None,)], "bc string")
    assert {tuple(r) for r in whitelist.generated(seen, "bc", wl, 1).collect()} == {("AAAT", "AAAA"), ("AAAT", "AATT"), ("AAAA", "AAAA")}
    assert {tuple(r) for r in whitelist.generated(seen, "bc", wl, 0).collect()} == {("AAAA", "AAAA")}
    r = spark.createDataFrame([(1, "CCGGGGCC", 3), (2, "CGGGGCCC", 3), (3, "CCCCGGGG", 3), (4, "CCCC", 1), (5, "GGGGGGG", 2)], "k int, t string, s int")
    got = {x["key"]: (x["barcode"], x["shift"], x["end_at"]) for x in whitelist.relocated(r, "k", "t", "s", 4, wl).collect()}
    assert got == {1: ("GGGG", 0, 7), 2: ("GGGG", -1, 6), 3: ("GGGG", 2, 9), 5: ("GGGG", 0, 6)}


def test_demux_follows_errors_in_static_parts(spark):
    layout = layouts.from_rows(
        {"element_no": i, "id": n, "seq": s, "expected_length": ln, "class": c, "whitelist": w}
        for i, (n, s, ln, c, w) in enumerate([("primer", "GTAGGACCTCACCAGTCGGATT", "", "", ""), ("bc", "", "7-8", "barcode", "cells"), ("link", "CTAATAAGTGTCTTACAGGC", "", "linker", ""), ("umi", "", "4", "umi", ""), ("t", "", "", "poly_t", ""), ("read", "", "", "read", ""), ("tail", "CGTCACTCCTTACAGAGTGCCAG", "", "", "")])
    )
    wl = spark.createDataFrame([("AACCGGAC",), ("AACCGGA",)], "barcode string")
    make = lambda p, b, k, t: "CATG" + p + b + k + "GCAG" + "TTTT" + "CCAAGGACCA" + t + "GG"
    p, k, t = "GTAGGACCTCACCAGTCGGATT", "CTAATAAGTGTCTTACAGGC", "CGTCACTCCTTACAGAGTGCCAG"
    texts = [make(p, "AACCGGAC", k, t), make(p[:9] + p[10:], "AACCGGAC", k, t), make(p, "AACCGGAC", k[:8] + "A" + k[8:], t), make(p, "AACCGGAC", k, t[:11] + "C" + t[12:]), make(p, "AACCGGA", k, t)]
    rows = [(i, x) for i, x in enumerate([*texts, *map(rc, texts), "ACGT" * 30, "", None])]
    df = spark.createDataFrame(rows, "read_key long, seq string")
    got = {r["read_key"]: (r["strand"], r["bc_raw"], r["bc"], r["umi"], r["cdna"]) for r in demux.demux(df, layout, {"cells": wl}, max_error=0.15).collect()}
    bcs = ["AACCGGAC"] * 4 + ["AACCGGA"]
    assert got == {i: ("FR"[i // 5], bcs[i % 5], bcs[i % 5], "GCAG", "CCAAGGACCA" if i < 5 else rc("CCAAGGACCA")) for i in range(10)}
    assert {r["read_key"] for r in demux.demux(df, layout, {"cells": wl}).collect()} == {0, 3, 4, 5, 8, 9}


def test_every_unit_of_a_read_is_demultiplexed(spark):
    layout, wl = layouts.from_csv(CSV), spark.createDataFrame([("AACC",), ("GGTT",)], "barcode string")
    join = "CTAATAAGTGTCTTACAGGC"
    unit = lambda b: "ACGTACGT" + b + "GCA" + "TTTT" + "CCAA" + "GGCCGGCC"
    df = reads(spark, unit("AACC") + join + unit("GGTT"), rc(unit("AACC") + join + unit("AACC")), unit("GGTT")).withColumn("seq_id", F.lit("r"))
    out = workflows.demultiplex(df, layout, {"cells": wl}, joins=[join]).tables
    assert sorted((r["read_key"], r["unit"], r["units"], r["strand"], r["barcode"]) for r in out["records"].collect()) == [
        (1, 1, 2, "F", "AACC"), (1, 2, 2, "F", "GGTT"), (2, 1, 2, "R", "AACC"), (2, 2, 2, "R", "AACC"), (3, 1, 1, "F", "GGTT"),
    ]
    got = {r["true_bc"]: (r["forw_count"], r["rev_count"], r["forw_concat_count"], r["rev_concat_count"]) for r in out["counters"].collect()}
    assert got == {"AACC": (1, 2, 1, 2), "GGTT": (2, 0, 1, 0)}


def test_infix_hits_match_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACG") for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    pattern = "ACGGCA"
    for text, hits in zip(texts, align.infix_hits(pattern, texts, 1)):
        ends = [j for j in range(1, len(text) + 1) if min(levenshtein(pattern, text[i:j]) for i in range(j + 1)) <= 1]
        assert {e for _, e, _ in hits} <= set(ends) and len(hits) == sum(j - 1 not in ends for j in ends)
        assert all(levenshtein(pattern, text[a:b]) == d for a, b, d in hits)


def test_umi_orientation(spark):
    layout = layouts.from_csv(CSV)
    wl = spark.createDataFrame([("AACC",)], "barcode string")
    s = rc("ACGTACGT" + "AACC" + "GCA" + "TTTT" + "CCAA" + "GGCCGGCC")
    assert demux.demux(reads(spark, s), layout, {"cells": wl}, rc_umi=False).first()["umi"] == "TGC"


def test_trust_in_corrected_barcodes(spark):
    rows = [("a", 1, 10, 9), ("b", 2, 10, 10), ("c", 1, 10, 9), ("d", 1, 10, 7), ("e", 1, 10, 10)]
    df = spark.createDataFrame(rows, "bc string, raw_count long, total_count long, corrected_count long")
    assert {r["bc"]: r["trusted"] for r in whitelist.trusted(df).collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False}


CSV = "﻿Read Layout:bulk\nid,seq,expected_length,type,class,whitelist,flags\nprimer,ACGTACGT,,static,forw_primer,,\nbarcode,,4,variable,barcode,cells,\numi,,2-3,variable,umi,,\npoly,,,static,poly_t,,\nread,,,variable,read,,\ntail,GGCCGGCC,,static,rev_primer,,\n"


def test_layouts():
    e = layouts.from_csv(CSV)
    assert [x.id for x in e] == ["primer", "barcode", "umi", "poly", "read", "tail"] and e[2].lengths == (2, 3) and e[2].length == 3
    assert layouts.lengths("15-16") == (15, 16)
    for bad in ("x", "9-3"):
        with pytest.raises(ValueError):
            layouts.lengths(bad)
    with pytest.raises(ValueError):
        layouts.from_csv("a,b\n1,2\n")
    spec = "library_spec:\n- region_id: lib\n  regions:\n  - {region_id: p, region_type: linker, sequence_type: fixed, sequence: acgt}\n  - {region_id: b, region_type: barcode, sequence_type: onlist, min_len: 4, max_len: 4, onlist: {filename: cells.txt, location: %s}}\n  - {region_id: c, region_type: cdna, sequence_type: random}\n"
    pytest.importorskip("yaml")
    got = layouts.from_seqspec(spec % "local")
    assert [(x.id, x.kind, x.cls, x.whitelist) for x in got] == [("p", "static", "linker", ""), ("b", "variable", "barcode", "cells.txt"), ("c", "variable", "read", "")]
    with pytest.raises(ValueError):
        layouts.from_seqspec(spec % "remote")
    assert layouts.from_seqspec(spec % "remote", "mine.txt")[1].whitelist == "mine.txt"


def test_demux(spark):
    layout = layouts.from_csv(CSV)
    wl = spark.createDataFrame([("AACC",), ("TTGA",)], "barcode string")
    s = "ACGTACGT" + "AACC" + "GCA" + "TTTT" + "CCNNAAGG" + "GGCCGGCC" + "A"
    r = reads(spark, s, rc(s), s.replace("AACC", "AACG", 1), "ACGTACGTAACCGCATT", "CCCC", None)
    got = {x["read_key"]: x for x in demux.demux(r, layout, {"cells": wl}, mutation=1, min_read_length=3).collect()}
    assert {k: (x["strand"], x["barcode"], x["barcode_kind"], x["umi"], x["cdna"], x["passing"]) for k, x in got.items()} == {
        1: ("F", "AACC", "exact", "GCA", "CCAAGG", True),
        2: ("R", "AACC", "exact", "GCA", "CCTTGG", True),
        3: ("F", "AACC", "corrected", "GCA", "CCAAGG", True),
        4: ("F", "AACC", "exact", "GCA", "", False),
    }
    stats = demux.run_stats(r, demux.demux(r, layout, {"cells": wl}, 1, 3)).first()
    assert (stats["total_reads"], stats["demultiplexed_reads"], stats["rate_percent"]) == (6, 3, 50.0)


def test_cut_together(spark):
    df = spark.createDataFrame([("ACNNGT", "abcdef"), ("", ""), ("AN", None)], "s string, q string")
    a, b = demux.cut_together(F.col("s"), F.col("q"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("ACGT", "abef"), ("", ""), ("A", None)]


def test_slides(spark):
    m = spark.createDataFrame([("AAAACCCC", 5, 9, 1, "cellA"), ("GGGG", None, 1, 0, None)], "barcode string, array_row int, array_col int, in_tissue int, cell_id string")
    r = spark.createDataFrame([(1, "CB:Z:AAAACCCC UB:Z:T"), (2, "CB:Z:TTTT"), (3, None), (4, "CB:Z:GGGG"), (5, "CB:Z:AAAACCCC CB:Z:AAAACCCC")], "k int, c string")
    got = {x["k"]: (x["status"], x["unit"]) for x in spatial.assigned(r, "c", m, size=4).collect()}
    assert got == {1: ("assigned", "s_004um_00002_00004-1"), 2: ("unknown_barcode", None), 3: ("missing_barcode", None), 4: ("missing_coordinates", None), 5: ("invalid_tags", None)}
    cell = {x["k"]: (x["status"], x["unit"]) for x in spatial.assigned(r, "c", m, unit="cell", tissue_only=True).collect()}
    assert cell[1] == ("assigned", "cellA")
    with pytest.raises(ValueError):
        spatial.assigned(r, "c", m, unit="cell", size=4)
    with pytest.raises(ValueError):
        spatial.spot_name(F.lit(1), F.lit(1), 3)
    with pytest.raises(ValueError):
        spatial.unique_map(m.unionAll(m))
    x, y = spark.createDataFrame([("AAAA", 7)], "barcode string, array_col int"), spark.createDataFrame([("CCCC", 3)], "barcode string, array_row int")
    b = spark.createDataFrame([("AAAACCCC",), ("AAAA-CCCC",), ("CCCCAAAA",)], "cb string")
    assert sorted((r["cb"], r["array_col"], r["array_row"], r["status"]) for r in spatial.assigned_by_axes(b, "cb", x, y, 4).collect()) == [("AAAA-CCCC", 7, 3, "assigned"), ("AAAACCCC", 7, 3, "assigned"), ("CCCCAAAA", None, None, "unknown_barcode")]
    names = spark.createDataFrame([("s_002um_00005_00009-1",), ("other",)], "n string").select(*spatial.native_spot(F.col("n")))
    assert [tuple(r) for r in names.collect()] == [(5, 9), (None, None)]
    for n, want in ((32, True), (31, False)):
        spots = spark.createDataFrame([(i // 8, i % 8) for i in range(n)] * 3, "array_row int, array_col int")
        row = spatial.occupied_regions(spots).first()
        assert (row["occupied_2um_spots"], row["selected"]) == (n, want)


def test_headers(spark):
    rows = [("read-one-F", "TS:A:+ UB:Z:TGCA XX:Z:ignore CB:Z:AACC CR:Z:AATC BC:Z:s_1"), ("read-no-umi-R", "BC:Z: CR:Z:TTGA CB:Z:TTGA TS:A:-"), ("read-no-barcode-F", "UB:Z:CCCC TS:A:+"), ("plain", None)]
    df = spark.createDataFrame(rows, "id string, c string")
    assert [r[0] for r in df.select(reformat.presto_header(F.col("id"), F.col("c"))).collect()] == ["read-one-F|BARCODE=s_1|UMI=TGCA", "read-no-umi-R|BARCODE=TTGA", "read-no-barcode-F|UMI=CCCC", "plain"]
    assert [r[0] for r in df.select(reformat.collapsed_header(F.col("id"), F.col("c"))).collect()] == ["read-one-F_AACC_TGCA", "read-no-umi-R_TTGA", "read-no-barcode-F_CCCC", "plain"]
    assert df.select(reformat.fasta(F.col("id"), F.col("c"), F.lit("ACGT"))).collect()[3][0] == ">plain\nACGT"
    with pytest.raises(Exception, match="reserved"):
        spark.createDataFrame([("a", "CB:Z:x|y")], "id string, c string").select(reformat.presto_header(F.col("id"), F.col("c"))).collect()
    cb, ub = reformat.barcode_and_umi(F.col("id"), F.col("c"), collapsed_input=True)
    assert [tuple(r) for r in spark.createDataFrame([("q_AA_CC", None), ("q_AA_CC", "CB:Z:GG"), ("q", None)], "id string, c string").select(cb, ub).collect()] == [("AA", "CC"), ("GG", "CC"), (None, None)]
    ax = spark.createDataFrame([("AAAA", 0)], "barcode string, array_col int"), spark.createDataFrame([("CCCC", 0)], "barcode string, array_row int")
    h = spark.createDataFrame([("spot", "CB:Z:AAAA-CCCC UB:Z:AACC BC:Z:old"), ("unmapped_AACC_TGCA", None)], "id string, c string")
    got = {r["id"]: r["header"] for r in reformat.coordinate_header(h, "id", "c", *ax).collect()}
    assert got == {"spot": "spot_00000_00000\tCB:Z:AAAA-CCCC UB:Z:AACC\tBC:Z:s_002um_00000_00000-1\tRG:Z:s002um", "unmapped_AACC_TGCA": "unmapped_AACC_TGCA"}


def test_junctions_and_chance_hits():
    b, free = concat.Edge(8, 8), concat.Edge()
    assert concat.junction(60, 822, b, b)[:3] == (441, 441, 441)
    assert concat.junction(60, 822, b, free)[:3] == (68, 66, 70)
    assert concat.junction(60, 822, free, b)[:3] == (814, 812, 816)
    cut, lo, hi, kind, flags = concat.junction(60, 822, free, free)
    assert (cut, lo, hi, kind) == (441, 60, 822, "midpoint") and flags & concat.UNRESOLVED
    end = concat.Edge(0, 0)
    for overlap in (0, 1, 5, 6, 12):
        j = concat.junction(100, 100 - overlap, end, end)
        assert bool(j.flags & concat.UNRESOLVED) == (overlap > 5) and 100 - overlap <= j.cut <= 100 and j.lo <= 100 - overlap and j.hi >= 100
    assert concat.junction(100, 120, end, end).cut == 110
    c = concat.chance_hits([100, 0, 0, 10, 20, 50, 20])
    assert (c.n_all, c.split, c.n_low, c.n_chance, c.mode, c.lower, c.share_at_lower, c.share_above_lower) == (200, 2, 100, 100, 5, 2, 0.0, 0.1)
    assert concat.chance_hits([]).lower == -1


def test_discovery(spark):
    r = reads(spark, "A" * 40, "C" * 40, "G" * 40)
    assert discover.sampled(r, "read_key", "seq", 10, 100).count() == 2
    assert discover.sampled(r, "read_key", "seq", 1, 100).count() == 1
    seen = spark.createDataFrame([("AA",), ("AA",), ("CC",)], "barcode string")
    cat = spark.createDataFrame([("x", "AA"), ("x", "AA"), ("y", "CC"), ("z", "TT"), ("w", "AA")], "catalog string, barcode string")
    got = {r["catalog"]: (r["catalog_size"], r["matched_reads"], r["matched_distinct"], r["status"]) for r in discover.ranked_catalogs(seen, "barcode", cat).collect()}
    assert got == {"x": (1, 2, 1, "tie"), "w": (1, 2, 1, "tie"), "y": (1, 1, 1, "other"), "z": (1, 0, 0, "no_hits")}
    parts = spark.createDataFrame([("a", "acgtacgt"), ("b", "ACGT"), ("c", "ACGTNCGT")], "id string, seq string")
    assert col(discover.usable_parts(parts), "seq") == ["ACGTACGT"]


def test_revcomp_is_its_own_inverse(spark):
    r = reads(spark, "ACGTTGCAN")
    assert r.select(revcomp(revcomp(F.col("seq")))).first()[0] == "ACGTTGCAN"


def test_long_patterns_and_wildcards_align(spark):
    import random

    from readloom.operators.align import infix_hits, infix_many, infix_one

    rng = random.Random(31)
    pattern = "".join(rng.choice("ACGT") for _ in range(90))
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60))) + pattern[:40] + rng.choice(["", "A", "CC"]) + pattern[42:] + "GATTACA" for _ in range(40)] + ["ACGT", ""]
    d, e, n = infix_many(pattern, texts)
    assert [(int(a), int(b), int(c)) for a, b, c in zip(d, e, n)] == [infix_one(pattern, t) for t in texts]
    for t, hits in zip(texts, infix_hits(pattern, texts, 5)):
        assert (min(h[2] for h in hits) == infix_one(pattern, t)[0] and t[hits[0][0] : hits[0][1]][:5] == pattern[:5]) if len(t) > 60 else not hits
    masked = pattern[:30] + "N" * 8 + pattern[38:70]
    assert infix_hits(masked, [pattern], 0, "N") == [[(0, 70, 0)]]
    assert infix_hits(masked[:60], ["TT" + pattern], 0, "N") == [[(2, 62, 0)]]


def test_all_built_in_layouts_demultiplex(spark):
    from readloom.operators.demux import parsed_fuzzy
    from readloom.sources import builtin_layouts as bl

    reads = spark.createDataFrame([(1, "ACGTACGTTT" * 30)], "read_key long, seq string")
    for name in bl.keys():
        assert parsed_fuzzy(reads, bl.load(name), 0.1).count() >= 0
