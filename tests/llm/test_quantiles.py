import math
import random

import numpy as np

from readloom.llm import quantiles as q

SCHEMA = "run_id string, x double, n int, grp string, metric string"


def exact(values, p):
    v = sorted(values)
    return v[math.ceil(p * len(v) / 100) - 1]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_cells_keep_order_and_hold_their_values():
    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(0, 1e3, 500), 0.0, -0.0, 5, -5, np.inf, -np.inf, 1e-300, 1e300]
    c = q.cells(v)
    order = np.argsort(v, kind="stable")
    assert (np.diff(c[order]) >= 0).all()
    low, high = q.cell_bounds(c)
    assert (low <= v).all() and (v <= high).all()
    assert len(set(q.cells(np.array([0.0, -0.0])).tolist())) == 1


def test_compression_bounds_nodes_and_keeps_counts():
    rng = np.random.default_rng(1)
    node = np.sort(q.cells(rng.normal(30, 5, 50_000)) + (1 << 32))
    group, one = np.zeros(len(node), np.int64), np.ones(len(node), np.int64)
    g, n, c = q.compress(*q._added(group, node, one), 100)
    assert c.sum() == len(node) and len(n) <= 300
    # No node above the leaves holds more than its share.
    assert c[n < (1 << 32)].max() <= len(node) // 100


def test_bounds_hold_and_are_within_the_stated_error(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), rng.lognormvariate(2, 1), rng.randrange(40)) for _ in range(4000)]
    k = 640
    whole = q.digests(frame(spark, rows), "run_id", ["x", "n"], k=k)
    for r in q.percentiles(whole, [1, 50, 90, 99]).collect():
        v = sorted(x[1 if r["metric"] == "x" else 2] for x in rows if x[0] == r["grp"])
        assert r["n"] == len(v)
        assert r["low"] <= exact(v, r["percent"]) <= r["high"]
        spread = sum(r["low"] <= x <= r["high"] for x in v) - sum(x == exact(v, r["percent"]) for x in v)
        assert spread <= 2 * q.rank_error(k) * len(v) + 1


def test_parts_add_up(spark):
    rng = random.Random(9)
    rows = [("a", rng.random(), rng.randrange(100)) for _ in range(600)]
    one = q.digests(frame(spark, rows[:100]), "run_id", ["x"])
    two = q.digests(frame(spark, rows[100:]), "run_id", ["x"])
    got = q.percentiles(q.merged(one.unionAll(two)), [50]).collect()
    assert len(got) == 1 and got[0]["n"] == 600
    assert got[0]["low"] <= exact([r[1] for r in rows], 50) <= got[0]["high"]


def test_nulls_nan_ties_and_null_groups(spark):
    rows = [(None, 1.0, None), (None, float("nan"), 3), ("a", None, 3), ("a", float("inf"), 3), ("a", float("-inf"), 3), ("a", 0.0, 3), ("b", None, None)]
    got = {(r["grp"], r["metric"]): r for r in q.percentiles(q.digests(frame(spark, rows), "run_id", ["x", "n"]), [50]).collect()}
    assert set(got) == {(None, "x"), (None, "n"), ("a", "x"), ("a", "n")}
    assert got["a", "x"]["n"] == 3 and got["a", "x"]["low"] <= 0.0 <= got["a", "x"]["high"]
    assert got["a", "n"]["low"] == 3.0


def brute_skewed(rows, metrics):
    out = set()
    for i, m in enumerate(metrics, 1):
        for g in {r[0] for r in rows}:
            v = [r[i] for r in rows if r[0] == g and r[i] is not None and not math.isnan(r[i])]
            if v and exact(v, 90) >= 2 * exact(v, 50):
                out.add((g, m))
    return out


def test_skewed_groups_match_exact_ranks(spark):
    rng = random.Random(6)
    rows = []
    for g in [*"abcdefgh", None]:
        wide = rng.choice([0.3, 0.5, 0.6, 1.0])
        rows += [(g, rng.lognormvariate(3, wide), rng.choice([1, 1, 2, 2, 4])) for _ in range(rng.choice([1, 2, 9, 400]))]
    rows += [("neg", -1.0, -4), ("neg", -2.0, -2), ("tie", 10.0, 2), ("tie", 20.0, 4), ("nan", float("nan"), None)]
    for k in (64, 6400):
        got = {tuple(r) for r in q.skewed_groups(frame(spark, rows), "run_id", ["x", "n"], k=k).collect()}
        assert got == brute_skewed(rows, ["x", "n"])


def test_many_groups_leave_early_and_empty_table(spark):
    rows = [(f"g{i % 50}", float(i), i) for i in range(500)]
    d = q.digests(frame(spark, rows), "run_id", ["x"], hold=40)
    assert d.agg({"n": "sum"}).first()[0] == 500
    assert q.skewed_groups(frame(spark, []), "run_id", ["x"]).count() == 0
