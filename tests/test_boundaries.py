from readloom.operators import concat


def test_boundaries_of_known_cases(spark):
    edges = spark.createDataFrame([(a, b, 60, 822) for a in ("bounded", "insert") for b in ("bounded", "insert")], "left_kind string, right_kind string, left_end int, right_start int")
    got = {(r["left_kind"], r["right_kind"]): (r["cut"], r["lo"], r["hi"], r["kind"]) for r in concat.junction_table(edges).collect()}
    assert got == {
        ("bounded", "bounded"): (441, 441, 441, "geometry"),
        ("bounded", "insert"): (68, 66, 70, "geometry"),
        ("insert", "bounded"): (814, 812, 816, "geometry"),
        ("insert", "insert"): (441, 60, 822, "midpoint"),
    }
