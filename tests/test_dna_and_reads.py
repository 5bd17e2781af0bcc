import itertools
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import dna, quality
from readloom.operators import reads as rd
from readloom.operators.align import infix_many, infix_one


def one(spark, column, **values):
    row = ", ".join(f"{'null' if v is None else repr(v)} as {k}" for k, v in values.items())
    return spark.sql(f"select {row}").select(column.alias("x")).first()["x"]


def naive_edits(s, lengths=None):
    out = set()
    for i in range(len(s) + 1):
        for b in "ACGT":
            out.add(s[:i] + b + s[i:])
            if i < len(s):
                out.add(s[:i] + b + s[i + 1 :])
        if i < len(s) and len(s) > 1:
            out.add(s[:i] + s[i + 1 :])
    return out - {s}


def test_neighbourhoods_match_brute_force(spark):
    df = spark.createDataFrame([("ACGT", 1), ("A", 1), ("", 1), (None, 1), ("AAAA", 1)], "seq string, n int")
    for k in (1, 2):
        got = {}
        for r in dna.neighbourhood(df, "seq", k).collect():
            got.setdefault(r["seq"], []).append(r["variant"])
        assert set(got) == {"ACGT", "A", "AAAA"}
        for s, v in got.items():
            reach = {s}
            for _ in range(k):
                reach |= {y for x in reach for y in naive_edits(x)}
            assert len(v) == len(set(v)) and set(v) == reach - {s}
    assert dna.point_mutations(df, "seq").where("seq = 'ACGT'").count() == 12
    shell = {r["variant"] for r in dna.hamming_shell(df, "seq").where("seq = 'ACGT'").collect()}
    assert shell == {v for v in map("".join, itertools.product("ACGT", repeat=4)) if 1 <= sum(a != b for a, b in zip(v, "ACGT")) <= 2}
    assert {r["variant"] for r in dna.shifted(df, "seq").where("seq = 'ACGT'").collect()} == {b + "ACG" for b in "ACGT"} | {"ACG" + b for b in "ACG"}


def test_packing(spark):
    assert one(spark, dna.pack(F.col("s")), s="A") == 0
    assert one(spark, dna.pack(F.col("s")), s="ACTG") == 0b00011011
    assert one(spark, dna.pack(F.col("s")), s="ACGN") is None
    assert one(spark, dna.unpack(F.col("n"), 4), n=27) == "ACTG"
    assert one(spark, dna.unpack(F.col("n"), 2), n=27) is None
    assert one(spark, dna.pack_wide(F.col("s")), s="G" * 64) == str(2**128 - 1)
    assert dna.unpack_wide(str(2**128 - 1), 64) == "G" * 64 and dna.unpack_wide(str(2**128), 64) is None
    rng = random.Random(2)
    for n in (1, 31):
        s = "".join(rng.choice("ACGT") for _ in range(n))
        assert one(spark, dna.unpack(dna.pack(F.col("s")), n), s=s) == s


def test_tags_masks_and_complements(spark):
    text = "XX:Z:prefixCB:Z:wrong CB:Z:RIGHT"
    assert one(spark, dna.tag(F.col("c"), "CB"), c=text) == "RIGHT"
    assert one(spark, dna.tag(F.col("c"), "UB"), c=text) is None
    assert one(spark, dna.revcomp(F.col("s")), s="ACGTNacgt-") == "-acgtNACGT"
    assert dna.mask_pattern("NNAGTCCGTAnnNN") == ("([ACGT]{2})AGTCCGTA[ACGT]{2}([ACGT]{2})", [2, 2])
    for bad in ("NNNN", "ACGT", "N" * 65 + "A", "NXA", ""):
        with pytest.raises(ValueError):
            dna.mask_pattern(bad)


def test_quality(spark):
    df = spark.createDataFrame([(1, "!5I~"), (2, "456"), (3, ""), (4, None), (5, "I")], "k int, qual string")
    rows = {r["k"]: r for r in df.select("k", quality.summary(F.col("qual")).alias("s"), quality.values(F.col("qual")).alias("v"), quality.fraction(F.col("qual"), 20).alias("f"), quality.shown(F.col("qual")).alias("t")).collect()}
    assert rows[1]["s"].asDict() == {"mean_q": 38.25, "min_q": 0, "frac_q20": 0.75} and rows[1]["v"] == [0, 20, 40, 93]
    assert rows[2]["s"].asDict() == {"mean_q": 20.0, "min_q": 19, "frac_q20": 2 / 3} and rows[2]["f"] == 2 / 3
    assert rows[3]["s"].asDict() == {"mean_q": None, "min_q": None, "frac_q20": None} and rows[3]["v"] == [] and rows[3]["f"] is None
    assert rows[4]["s"] is None or rows[4]["s"]["mean_q"] is None
    assert rows[4]["v"] is None and rows[4]["t"] == "<no quality>" and rows[2]["t"] == "<Q:3; mean=20.0>"
    assert one(spark, quality.recoded(F.col("q"), 64), q="!5") == "@T"
    with pytest.raises(Exception, match="too high"):
        one(spark, quality.recoded(F.col("q"), 64), q="~")
    assert one(spark, quality.shortened(F.col("s"), 6), s="ACGTACGT") == "ACG..."


def test_every_threshold(spark):
    q = "".join(chr(c) for c in range(33, 127))
    df = spark.createDataFrame([(q,)], "q string")
    for t in (0, 1, 14, 20, 59, 60, 61, 93):
        assert abs(df.select(quality.fraction(F.col("q"), t).alias("x")).first()["x"] - (94 - t) / 94) < 1e-12


def test_read_table(spark):
    r = rd.pack_reads(spark, ["a", "b", None, "", "a"], ["ACGT", "", "N", "AC", "ACGT"], ["IIII", "", None, "!!", "5555"])
    assert r.columns == list(rd.CORE) and rd.validate(r, deep=True)
    assert [x["read_key"] for x in r.orderBy("read_key").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        rd.pack_reads(spark, ["a"], ["ACGT"], ["I"])
    with pytest.raises(ValueError):
        rd.annotate(r, seq=F.lit("x"))
    with pytest.raises(ValueError):
        rd.validate(r.withColumn("length", F.lit(9)))
    assert "note" in rd.annotate(r, note=F.lit(1)).columns
    bound = rd.bind(r, r.withColumn("extra", F.lit("x")))
    assert sorted(x["read_key"] for x in bound.collect()) == list(range(1, 11))
    assert bound.where("read_key > 5").select("extra").distinct().collect()[0][0] == "x"
    dup = {x["read_key"]: x["duplicated"] for x in rd.duplicated(r).collect()}
    assert dup == {1: False, 2: False, 3: False, 4: False, 5: True}
    s = rd.storage_stats(r).first()
    assert (s["seq_bytes"], s["seq_packed_bytes"], s["qual_packed_bytes"]) == (11, 3, 9)
    again = rd.as_reads(r.withColumnRenamed("seq_id", "id").select("id", "seq", "qual"))
    assert again.count() == 5


def test_infix_distance_matches_dynamic_program():
    rng = random.Random(9)
    for m in (1, 5, 31, 32, 33, 62, 63, 64, 65, 130):
        pattern = "".join(rng.choice("ACGT") for _ in range(m))
        texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 150))) for _ in range(40)] + [pattern, "", "A", "x" + pattern[1:] + "yy", "Q" * 100]
        d, e, n = infix_many(pattern, texts)
        for i, t in enumerate(texts):
            assert (d[i], e[i], n[i]) == infix_one(pattern, t), (pattern, t)
    assert infix_one("ACGT", "TTTT") == (3, 0, 4)
    with pytest.raises(ValueError):
        infix_many("", ["A"])
    with pytest.raises(ValueError):
        infix_many("é", ["A"])
