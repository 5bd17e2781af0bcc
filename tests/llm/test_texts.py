import random
import unicodedata

import pytest

from readloom.llm import leakage as lk
from readloom.llm import lookalikes as la
from readloom.llm import mixing as mx

LATIN = "The scope of a Patent: COPY, xerox, joy, hat; naïve Ångström"


def disguise(rng, t):
    """The same look with other characters."""
    back: dict[str, list[str]] = {}
    for table in (la._CYRILLIC, la._GREEK):
        for other, shown in table.items():
            back.setdefault(shown, []).append(other)
    out = []
    for c in unicodedata.normalize(rng.choice(["NFC", "NFD"]), t):
        r = rng.random()
        if c == " ":
            c = rng.choice("    　")
        elif r < 0.3 and c in back:
            c = rng.choice(back[c])
        elif r < 0.5 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        out.append(c + ("​" if rng.random() < 0.1 else "­" if rng.random() < 0.1 else ""))
    return "".join(out)


def test_same_look_same_form():
    rng = random.Random(8)
    for text in (LATIN, "вода и ёлка", "Δt = 5 μm", "ПРИМЕР ОПЫТ"):
        forms = {la.Normaliser()(disguise(rng, text)) for _ in range(50)}
        assert forms == {la.Normaliser()(text)}
    assert la.Normaliser()(LATIN) == LATIN


def test_visible_differences_stay():
    n = la.Normaliser()
    for a, b in (("a", "A"), ("m2", "m²"), ("1", "¹"), ("e", "é"), ("a b", "a  b"), ("a b", "a\nb"), ("a", "α"), ("0", "O"), ("l", "1"), ("κ", "k")):
        assert n(a) != n(b)
    assert n("5 µm") == n("5 μm")


def test_spelling_is_consistent_in_script():
    n = la.Normaliser()
    assert {la._script(c) for c in n("вoдa")} == {"cyrillic"}
    assert {la._script(c) for c in n("сору")} == {"latin"}
    assert n("pacтвop") == n("раствор") == "раствор"


def test_scores_change_spelling_only():
    scores = {"oд": -20.0, "од": -0.1}
    texts = ["вoда", "вода", "воdа", "Тhe", "The"]
    plain, scored = [la.Normaliser()(t) for t in texts], [la.Normaliser(scores)(t) for t in texts]
    assert [plain.index(x) for x in plain] == [scored.index(x) for x in scored]


def test_column_and_pairs(spark):
    rows = [(1, "COPY"), (2, "СОРУ"), (3, "COPY"), (4, "copy"), (5, None), (6, ""), (7, "​"), (8, "​​"), (9, "ＣＯＰＹ"), (None, "CОPY"), (10, "x" * 100_000), (11, "х" + "x" * 99_999)]
    df = spark.createDataFrame([(*r, "clash", "c") for r in rows], "id long, text string, key string, form string")
    got = sorted(tuple(r) for r in la.same_looking(df, "id", "text", la.bigram_scores(df, "text")).collect())
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9), (7, 8), (10, 11)]
    forms = {r["id"]: r["normal"] for r in la.normal_form(df, "text").select("id", "normal").collect()}
    assert forms[2] == "COPY" and forms[5] is None and forms[6] == "" and forms[7] == ""
    none = spark.createDataFrame([], df.schema)
    assert la.same_looking(none, "id", "text").count() == 0 and la.bigram_scores(none, "text") == {}


def brute_leaks(docs, items, n):
    normal = la.Normaliser()
    runs = lambda t: {tuple(w[i : i + n]) for w in [lk.words(t, normal)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs if t for i, x in items if x and runs(t) & runs(x)}


def test_leaks_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "of", "Pа", "5"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(20)] + [(100, None), (101, ""), (102, "one two"), (103, items_text := text(30)), (104, items_text)]
    docs = []
    for d in range(120):
        t = text(rng.randrange(0, 60))
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split()
            k = rng.choice([11, 12, 13, 14, 20])
            at = rng.randrange(max(1, len(w) - k + 1))
            t += rng.choice([" ", ", ", "-"]) + " ​".join(w[at : at + k]).upper() + "_" + text(5)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, docs[0][1]), (504, " ".join(["the"] * 5000))]
    corpus = spark.createDataFrame([(*d, "c") for d in docs], "doc long, text string, item string")
    side = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, key string")
    for block in (16_000_000, 200):
        got = [tuple(r) for r in lk.leaked_items(corpus, "doc", "text", side, "item_id", "text", block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items, 13)
    none = spark.createDataFrame([], side.schema)
    assert lk.leaked_items(corpus, "doc", "text", none, "item_id", "text").count() == 0
    assert lk.leaked_items(spark.createDataFrame([], corpus.schema), "doc", "text", side, "item_id", "text").count() == 0


P = pytest.importorskip("public_tokenizers")
VOCABULARY, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_token_counts_are_those_of_the_tokenizer():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = mx._token_counter(VOCABULARY, PATTERN)
    rng = random.Random(1)
    for t in ["", " ", "a  b\n\n c", "naïve µm 日本語 <|endoftext|>", "x" * 5000, "".join(chr(rng.randrange(32, 3000)) for _ in range(500))]:
        assert count(t) == len(whole.encode_ordinary(t))


def test_pivot_keeps_sums_and_expectations():
    wins = [0] * 4
    p = [0.3, 0.6, 0.9, 0.2]
    for seed in range(3000):
        pivot, taken = mx.Pivot(seed), 0
        for i, f in enumerate(p):
            for row, n in pivot.meet(i, i, f):
                wins[row] += n
                taken += n
        rest = pivot.open[2] if pivot.open else 0.0
        assert abs(taken + rest - 2.0) < 1e-9
    assert all(abs(w / 3000 - f) < 0.04 for w, f in zip(wins, p))


def mixed(spark, docs, targets):
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, source string, text string, key string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mx.mix(d, "doc_id", "source", "text", t, VOCABULARY, PATTERN)
    return m.rows.collect(), {r["source"]: r for r in m.shares.collect()}


def test_shares_and_repeats(spark):
    rng = random.Random(3)
    docs = [(i, s, "some words here " * rng.randrange(1, 30)) for i, s in enumerate(rng.choices(["a", "b", "c", "no target", None], [60, 25, 5, 5, 5], k=1500))]
    docs += [(9000, "a", None), (9001, "a", ""), (None, "b", "text")]
    rows, shares = mixed(spark, docs, [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 5)])
    assert {r["source"] for r in rows} == {"a", "b", "c"}
    assert len(rows) == sum(1 for d in docs if d[1] in ("a", "b", "c") and d[2] is not None)
    assert all(0 <= r["copies"] <= {"a": 2, "b": 3, "c": 4}[r["source"]] for r in rows)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(shares[s]["actual_share"] - share / 0.9) < 0.01
    assert shares["gone"]["tokens_used"] == 0
    # Copies of a source differ by one at most: whole copies and one more by rounding.
    for s in "abc":
        c = {r["copies"] for r in rows if r["source"] == s and r["tokens"] > 0}
        assert max(c) - min(c) <= 1


def test_mix_of_nothing(spark):
    assert mixed(spark, [], [("a", 1.0, 2)])[0] == []
    assert mixed(spark, [(1, "a", "x")], [])[0] == []
    with pytest.raises(ValueError):
        mixed(spark, [(1, "a", "x")], [("a", 0.5, 1), ("a", 0.5, 1)])


def test_allotments_fill_small_sources_to_their_repeats():
    share, tokens, most = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 1000, "c": 10}, {"a": 2, "b": 1, "c": 4}
    got = mx.allotments(share, tokens, most)
    assert got["c"] == 40 and abs(sum(got.values()) - 2010) < 1e-6 and got["b"] <= 1000
    assert abs(got["a"] / got["b"] - 0.5 / 0.3) < 1e-6
    assert mx.allotments(share, tokens, most, keep_shares=True) == pytest.approx({"a": 100, "b": 60, "c": 40})
    assert mx.allotments(share, tokens, most, 100) == pytest.approx({"a": 50, "b": 30, "c": 20})
    assert sum(mx.allotments(share, tokens, most, 10**9).values()) == pytest.approx(2000 + 1000 + 40)
    assert mx.allotments({}, {}, {}) == {}
