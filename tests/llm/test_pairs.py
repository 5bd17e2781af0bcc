import random

from readloom.llm.pairs import paired_within, spread_join


def test_blocks_pair_every_two_rows_once(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, f"v{i}") for i in range(120)] + [(9, 1000, "alone")]
    df = spark.createDataFrame(rows, "g int, k long, v string")
    expected = {(a, b) for g, a, _ in rows for h, b, _ in rows if g is not None and g == h and a < b}
    for per in (7, 1000):
        got = [(min(r["k_a"], r["k_b"]), max(r["k_a"], r["k_b"]), r["v_a"] == f"v{r['k_a']}") for r in paired_within(df, ["g"], "k", per).collect()]
        assert len(got) == len(expected) and {(a, b) for a, b, ok in got if ok} == expected
    assert paired_within(df.limit(0), ["g"], "k").count() == 0


def test_hot_members_join_in_blocks(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, "d")], "g int, l string")
    members = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99), (3, 98)], "g int, k long")
    expected = sorted([(x, i) for x in "ab" for i in range(30)] + [("c", 99)])
    for per in (4, 1000):
        assert sorted((r["l"], r["k"]) for r in spread_join(left, members, ["g"], "k", per).collect()) == expected


def test_sizes_that_are_known_change_nothing(spark):
    left = spark.createDataFrame([(1, "a"), (2, "c")], "g int, l string")
    members = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99)], "g int, k long")
    sizes = spark.createDataFrame([(1, 30)], "g int, _n long")
    expected = sorted([("a", i) for i in range(30)] + [("c", 99)])
    for per in (4, 1000):
        assert sorted((r["l"], r["k"]) for r in spread_join(left, members, ["g"], "k", per, sizes).collect()) == expected
    assert paired_within(members, ["g"], "k", 4, sizes).count() == 30 * 29 // 2
