import random
import re
from collections import Counter

import numpy as np
import pytest

from readloom.llm import term_counts as tc


def brute(texts, k):
    occ, rec = Counter(), Counter()
    for t in texts:
        terms = [t[i : i + k].upper() for i in range(len(t or "") - k + 1)]
        terms = [x for x in terms if re.fullmatch("[ACGT]+", x)]
        occ.update(terms)
        rec.update(set(terms))
    return {(x, occ[x], rec[x]) for x in occ}


@pytest.mark.parametrize("k", [1, 3, 8, 9, 10])
def test_matches_brute_force(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTacgtNR-") if rng.random() < 0.9 else "é" for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    texts += [None, "", "A" * 3000, "A" * (k - 1), texts[0], texts[0], "ACGT" * 5]
    df = spark.createDataFrame([(t, "clash", 1) for t in texts], "seq string, term string, records int")
    got = [tuple(r) for r in tc.term_counts(df, "seq", k).collect()]
    assert len(got) == len(set(got))
    # Letters beyond ASCII are no terms and keep the bytes around them apart.
    assert set(got) == brute(texts, k)


def test_marks(spark):
    texts = ["AAAAAAAA"] * 5 + ["CCCCCCCC"] * 2 + ["GGGGGGGG"] + [None] * 92
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    got = {r["term"]: r["mark"] for r in tc.marked_terms(df, "seq", 8, 20, 3000).collect()}
    assert got == {"AAAAAAAA": "common", "CCCCCCCC": None, "GGGGGGGG": "rare"}


def test_empty_table_and_bad_arguments(spark):
    df = spark.createDataFrame([], "seq string")
    assert tc.marked_terms(df, "seq").count() == 0
    assert tc.term_counts(spark.createDataFrame([(None,), ("",)], "seq string"), "seq").count() == 0
    with pytest.raises(ValueError):
        tc.term_counts(df, "seq", 11)


def test_tokens_of_any_kind(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [[rng.choice(["a", "bb", "é", "", "x" * 5000, None]) for _ in range(rng.randrange(0, 9))] for _ in range(2500)] + [None, [], ["a"] * 4000]
    df = spark.createDataFrame([(r, "clash") for r in rows], "w array<string>, term string")
    occurrences = Counter(t for r in rows for t in r or [] if t is not None)
    records = Counter(t for r in rows for t in set(r or []) if t is not None)
    for hold in (500_000, 2):
        got = {r["term"]: (r["occurrences"], r["records"]) for r in tc.token_counts(df, F.col("w"), hold).collect()}
        assert got == {t: (occurrences[t], records[t]) for t in occurrences}
    assert tc.token_counts(df.limit(0), F.col("w")).count() == 0


def test_last_seen_goes_on_between_blocks():
    seen = tc.LastSeen(4)
    seen.see(np.array([1, 1, 2]), np.array([0, 0, 0]))
    seen.see(np.array([1, 2, 2]), np.array([0, 1, 2]))
    assert seen.occurrences.tolist() == [0, 3, 3, 0] and seen.records.tolist() == [0, 1, 3, 0] and seen.last.tolist() == [-1, 0, 2, -1]
