import random

from readloom.operators import concat, hmm, scan

RC = str.maketrans("ACGT", "TGCA")
OPEN, CLOSE = "CTACACGACGCTCTTCCGATCT", "ACTCTGCGTTGATACCACTGCTT"


def rc(s):
    return s.translate(RC)[::-1]


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "k long, s string")


def test_fuzzy_masks_follow_indels_in_literals(spark):
    seqs = ["ACAGTCACGTAGA", "ACAGTCGTAGA"]
    got = scan.masked_fuzzy(reads(spark, seqs + [rc(s) for s in seqs] + ["", None, "A" * 40]), "s", "NNAGTCCGTANN", 0.13)
    assert [r["barcode"] for r in got.collect()] == ["ACGA"] * 4


def test_gaps_beside_captures_reject(spark):
    seqs = ["AGTCCGTAAACTGACCTAG", "AGTCCGTAAAACCTGACCTAG"]
    assert scan.masked_fuzzy(reads(spark, seqs + [rc(s) for s in seqs]), "s", "AGTCCGTANNNNTGACCTAG", 0.07).count() == 0
    assert scan.masked_fuzzy(reads(spark, ["AGTCCGTAAACCTGACCTAG"]), "s", "AGTCCGTANNNNTGACCTAG", 0.07).first()["barcode"] == "AACC"


def molecule(rng, strand, close=True):
    s = OPEN + "".join(rng.choice("ACGT") for _ in range(rng.randrange(60, 200))) + (CLOSE if close else "")
    return s if strand == "F" else rc(s)


def test_units_of_concatenated_reads(spark):
    rng = random.Random(1)
    plans = [rng.choice(["F", "R", "FF", "RF", "FRF", "RR"]) for _ in range(200)]
    parts = [[molecule(rng, c) for c in p] for p in plans]
    rows = ["".join(p) for p in parts]
    got = {}
    for r in hmm.segmented(reads(spark, [*rows, None, "", "ACGT"]), "k", "s", OPEN, CLOSE).collect():
        got.setdefault(r["key"], []).append((r["unit"], r["strand"], r["start_at"], r["end_at"], r["resolved"]))
    assert got.pop(202) == [(1, "", 0, 4, True)]
    for i, (p, units) in enumerate(zip(plans, parts)):
        u = sorted(got[i])
        assert "".join(x[1] for x in u) == p and all(x[4] for x in u)
        ends = [sum(map(len, units[: j + 1])) for j in range(len(units))]
        assert [x[3] for x in u] == ends and [x[2] for x in u] == [0, *ends[:-1]]


def test_missing_anchors_leave_the_cut_open(spark):
    rng = random.Random(2)
    rows = [molecule(rng, "F") + molecule(rng, "F") for _ in range(80)] + [molecule(rng, "F", close=False) + molecule(rng, "R", close=False)]
    got = [r for r in hmm.segmented(reads(spark, rows), "k", "s", OPEN, CLOSE).collect() if r["key"] == 80]
    assert [r["strand"] for r in sorted(got, key=lambda r: r["unit"])] == ["F", "R"] and not any(r["resolved"] for r in got)
    assert hmm.segmented(reads(spark, rows), "k", "s", OPEN, CLOSE, abstain="drop").where("key = 80").count() == 0


def test_anchors_with_errors_are_met(spark):
    rng = random.Random(5)
    rows = []
    for i, (a, b) in enumerate(("FF", "FR", "RF", "RR") * 25):
        r = molecule(rng, a) + molecule(rng, b)
        # Half of the reads have exact anchors, the others one or, more seldom, two edits in each.
        for part in (OPEN, CLOSE, rc(OPEN), rc(CLOSE)):
            r = r.replace(part, part if i < 50 else part[:9] + part[10:] if i < 85 else part[:9] + part[10:15] + "G" + part[15:])
        rows.append(r)
    noise = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(200)]
    got = {}
    for r in hmm.segmented(reads(spark, rows + noise), "k", "s", OPEN, CLOSE).collect():
        got.setdefault(r["key"], []).append((r["unit"], r["strand"], r["start_at"], r["end_at"]))
    for i in range(len(rows)):
        assert "".join(u[1] for u in sorted(got[i])) == ["FF", "FR", "RF", "RR"][i % 4]
    assert all(got[len(rows) + i] == [(1, "", 0, 150)] for i in range(200))


def test_guard_and_empty(spark):
    rng = random.Random(3)
    one = hmm.segmented(reads(spark, [molecule(rng, "R") + molecule(rng, "F")]), "k", "s", OPEN, CLOSE).collect()
    assert [(r["unit"], r["strand"]) for r in one] == [(1, "R")]
    assert hmm.segmented(reads(spark, []), "k", "s", OPEN, CLOSE).count() == 0


def test_parameters_are_probabilities():
    for row in hmm.initial():
        assert abs(sum(row) - 1) < 1e-9


def test_segments_are_cut_on_both_strands(spark):
    j, k = "CTAATAAGTGTCTTACAGGC", "TAACGAGATTCCACTGGGTTAACA"
    seqs = ["AAC" + j + "GGA" + k.lower() + "TTC", "AAC" + rc(j) + "GGA", rc(k) + "AAC" + j + rc(j) + "GG", "ACGT", "", None]
    got = [tuple(r) for r in concat.segments_both(reads(spark, seqs), "k", "s", [j, k]).orderBy("key", "segment").collect()]
    assert got == [
        (0, 1, 3, "AAC", None, "F"), (0, 2, 3, "GGA", "F", "F"), (0, 3, 3, "TTC", "F", None),
        (1, 1, 2, "AAC", None, "R"), (1, 2, 2, "GGA", "R", None),
        (2, 1, 2, "AAC", "R", "F"), (2, 2, 2, "GG", "R", None),
        (3, 1, 1, "ACGT", None, None),
    ]
    assert concat.segments(reads(spark, seqs), "k", "s", [j, k]).where("key = 1").count() == 1
