import random

import pytest

from readloom.llm import splitting as s

MARKERS = ["GATTACA", "ccctttggg"]


def naive(text):
    b = {i for m in MARKERS for i in range(len(text)) if text[i : i + len(m)].upper() == m.upper()}
    run = 0
    for i, c in enumerate(text + "x"):
        if c in "Nn-":
            run += 1
        else:
            if run >= 6:
                b.add(i)
            run = 0
    pieces, start = [], 0
    while len(text) - start > 1000:
        inside = [p for p in b if start + 500 <= p <= start + 1000]
        end = max(inside, default=start + 1000)
        pieces.append((start, end))
        start = end - 60
    return [*pieces, (start, len(text))]


def random_text(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(["".join(rng.choice("ACGTacgt") for _ in range(rng.randrange(1, 400))), "GATTACA", "gattacaGATTACATTACA", "CCCTTTGGG", "NNNNNN", "Nn-nnN-", "-----"]))
    return "".join(out)[:n]


def test_forward_matches_definition(spark):
    rng = random.Random(1)
    texts = [random_text(rng, n) for n in (1, 999, 1000, 1001, 1500, 2001, 9000, 60_000)] + [None, "", "N" * 5000, "A" * 1060]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, texts[4], "", 0)], "k long, t string, key string, piece_no int")
    got = {}
    for r in s.split_items(df, "k", "t", MARKERS, with_text=True).collect():
        got.setdefault(r["key"], []).append((r["piece_no"], r["start_at"], r["end_at"], r["piece"]))
    want = {i: naive(t) for i, t in [*enumerate(texts), (None, texts[4])] if t and len(t) > 1000}
    assert set(got) == set(want)
    for i, pieces in got.items():
        t = texts[4 if i is None else i]
        pieces.sort()
        assert [(a, b) for _, a, b, _ in pieces] == want[i]
        assert all(p == t[a:b] and b - a <= 1000 for _, a, b, p in pieces)
        assert pieces[0][3] + "".join(p[60:] for _, _, _, p in pieces[1:]) == t


def test_bisection_gives_whole_pieces_under_the_limit(spark):
    rng = random.Random(2)
    for n in (1001, 1939, 1941, 5000, 30_000):
        t = random_text(rng, n)
        pieces = s.bisect(len(t), s.boundaries(t, [m.upper() for m in MARKERS]), 1000, 60)
        assert all(b - a <= 1000 for a, b in pieces)
        assert t[: pieces[0][1]] + "".join(t[a + 60 : b] for a, b in pieces[1:]) == t
        assert pieces == sorted(pieces)
    df = spark.createDataFrame([(1, random_text(rng, 4000))], "k long, t string")
    assert s.split_items(df, "k", "t", MARKERS, method="bisect").count() >= 4


def test_bisection_takes_the_strongest_boundary():
    assert s.bisect(1500, {700: 1, 760: 1, 800: 2}, 1000, 60)[0] == (0, 800)
    assert s.bisect(1500, {}, 1000, 60)[0] == (0, 750)


def test_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert s.split_items(df, "k", "t", MARKERS).count() == 0
    for kw in ({"overlap": 600}, {"method": "other"}, {"least": 1200}):
        with pytest.raises(ValueError):
            s.split_items(df, "k", "t", MARKERS, **kw)
