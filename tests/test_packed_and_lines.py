import random
import re

from readloom.functions.packed import unpack
from readloom.sources import delimited as d

DELIMS = " \t,;|"


def naive_items(text):
    """The definition, letter by letter."""
    out, value, i, begun = [], "", 0, False
    while i < len(text):
        c = text[i]
        if c in DELIMS:
            if begun:
                out.append(value)
            value, begun, i = "", False, i + 1
            continue
        if c in "\"'" and (not begun or text[i - 1] == ":"):
            j, inner = i + 1, ""
            while j < len(text):
                if text[j] != c:
                    inner, j = inner + text[j], j + 1
                elif text[j : j + 2] == c * 2:
                    inner, j = inner + c, j + 2
                else:
                    break
            if j < len(text):
                # A colon inside of the quotes does not open another stretch behind them.
                value, begun, i = value + inner, True, j + 1
                if i < len(text) and text[i] in "\"'" and text[i] != c:
                    value, i = value + text[i], i + 1
                continue
        value, begun, i = value + c, True, i + 1
    if begun:
        out.append(value)
    return [x for x in out if x]


def test_examples(spark):
    cases = {
        "CB:Z:AA UB:Z:CC": ["CB:Z:AA", "UB:Z:CC"],
        'XS:Z:"left lobe, section 2"': ["XS:Z:left lobe, section 2"],
        "XX:Z:5'end;b": ["XX:Z:5'end", "b"],
        'XS:Z:"said ""ok"" twice; kept","CB"': ['XS:Z:said "ok" twice; kept', "CB"],
        "'it''s late, keep'|x": ["it's late, keep", "x"],
        '"open a,b': ['"open', "a", "b"],
        ";; |": [],
        '"" a': ["a"],
        '"a"b c': ["ab", "c"],
    }
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(cases)], "k int, c string, pos int, item string")
    got = {}
    for r in unpack(df, "k", "c").collect():
        got.setdefault(r["key"], []).append((r["pos"], r["item"]))
    for i, want in enumerate(cases.values()):
        assert sorted(got.get(i, [])) == list(enumerate(want, 1)), list(cases)[i]


def test_matches_letter_by_letter(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b:", ":", '"', "'", '""', " ", ",", "|", ";", "\t", "é"]) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    texts += [None, "", "x" * 50_000, ("k:" + '"v, ""w"" "' + " ;") * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b")], "k int, c string")
    got = {}
    for r in unpack(df, "k", "c").collect():
        got.setdefault(r["key"], []).append((r["pos"], r["item"]))
    for i, t in [*enumerate(texts), (None, "a b")]:
        assert sorted(got.get(i, [])) == list(enumerate(naive_items(t or ""), 1)), t
    assert unpack(spark.createDataFrame([], "k int, c string"), "k", "c").count() == 0


def naive_reason(raw):
    line = raw[1:] if raw[:1] == "﻿" else raw
    line = line[:-1] if line.endswith("\r") else line
    if line == d.HEADER:
        return None
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] != '"':
                    text, j = text + line[j], j + 1
                elif line[j : j + 2] == '""':
                    text, j = text + '"', j + 2
                else:
                    break
            i = j + 1
        else:
            j = i
            while j < len(line) and line[j] not in ',"':
                j += 1
            text, i = line[i:j], j
        fields.append(text)
        if i == len(line):
            break
        if line[i] != ",":
            return "quoting"
        i += 1
    if len(fields) != 4:
        return "column_count"
    a, _, s, q = fields
    if not a or any(c.isspace() or ord(c) < 32 or 127 <= ord(c) < 160 for c in a):
        return "seq_id"
    if re.search("[^ACGTUNRYSWKMBDHV-]", s.upper()) or not s.isascii():
        return "seq"
    if any(not "!" <= c <= "~" for c in q):
        return "qual"
    return "length" if q and len(q) != len(s) else ("ok", *fields)


def test_lines_match_the_rules(spark):
    rng = random.Random(3)
    parts = ["id", "A", "ac-N", '"', '""', ",", ",", ",", "FF", " ", "\t", "\r", "\x00", "é", " ", "x,y", '"x,y"', "\n", "﻿", "ß", "\x1f"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 10))) for _ in range(3000)]
    lines += [d.HEADER, "﻿" + d.HEADER + "\r", "", "\r", "i,c,AC,FF", 'i,"c""d",AC,"F,"', "i,c,AC,FF,", "i,,,", "i," + "c" * 3_000_000 + ",AC,FF", 'i,"c" ,AC,FF', "ſ,c,ſ,", "i,NULL,,", "7,c,AC,FF"]
    df = spark.createDataFrame([(i, t, "clash", "r") for i, t in enumerate(lines)] + [(None, "bad", "", ""), (9_999_999, None, "", "")], "k long, line string, seq string, reason string")
    got = {r["key"]: r for r in d.parse_read_lines(df, "k", "line").collect()}
    assert got[None]["reason"] == "column_count" and 9_999_999 not in got
    for i, t in enumerate(lines):
        want = naive_reason(t)
        if want is None:
            assert i not in got
        elif isinstance(want, tuple):
            r = got[i]
            assert r["reason"] is None and (r["seq_id"], r["seq_comment"], r["seq"], r["qual"]) == want[1:], t
        else:
            assert got[i]["reason"] == want and got[i]["seq"] is None, (t, want)
    assert d.parse_read_lines(spark.createDataFrame([], df.schema), "k", "line").count() == 0
