"""One consistent form for text that looks the same (problem 9).

Steps: characters without any width are deleted, blanks become the ordinary
blank, full-width forms become ASCII, text is decomposed canonically, letters
of Latin, Greek and Cyrillic of the same shape are folded into one class, and
every token that holds a letter of Greek or Cyrillic only is spelt by a Viterbi
search: each class offers its letters of the three scripts, neighbours in one
script score by the character bigrams of the collection, a change of script
costs a fixed penalty.  Tokens whose every letter has a Latin form take it.
The result is composed again (NFC).

The search sees classes, never the letters that were written, so texts that
look the same get the same form whatever scores are used; the scores only pick
the spelling.

Scale: a projection without shuffle.  ASCII text passes untouched, and only
runs of other characters and tokens with Greek or Cyrillic are looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.pairs import paired_within, spread_join
from readloom.plans.scratch import written

# Letters of the same shape, in the order of the Latin letters they look like.
_CYRILLIC = dict(zip("АВСЕНІЈКМОРԚЅТѴԜХУасԁеһіјӏорԛѕѵԝхуҮӀ", "ABCEHIJKMOPQSTVWXYacdehijlopqsvwxyYI", strict=True))
_GREEK = dict(zip("ΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖϲϳο", "ABCEHIJKMNOPTXYZcjo", strict=True))
# Cyrillic letters of the shape of a Greek letter that has no Latin one.
_CYRILLIC_GREEK = dict(zip("ГПФ", "ΓΠΦ"))
_FOLD = {ord(a): b for a, b in (_CYRILLIC | _GREEK | _CYRILLIC_GREEK).items()}

# Marks and format characters that show something themselves.
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Invisible characters outside the category of format characters.
_INVISIBLE = {0x34F, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

_PREPARE: dict[int, str | None] = {}
for _c in range(0x80, sys.maxunicode + 1):
    _kind = unicodedata.category(chr(_c))
    if _kind == "Cf" and _c not in _VISIBLE_FORMAT or _c in _INVISIBLE:
        _PREPARE[_c] = None
    elif _kind == "Zs":
        _PREPARE[_c] = " "
    elif 0xFF01 <= _c <= 0xFF5E:
        _PREPARE[_c] = chr(_c - 0xFEE0)
_PREPARE[0xB5] = "μ"

_OTHERS = re.compile(r"[^\x00-\x7f]+")
#: Tokens with Greek or Cyrillic; possessive parts and the look behind keep the search from trying a word twice.
_TOKEN = re.compile(r"(?<![A-Za-z\u0300-\u052f])[A-Za-z\u0300-\u036f]*+[\u0370-\u052f][A-Za-z\u0300-\u052f]*+")
_SWITCH = 12.0
_KEPT = 200_000  # entries of each cache of a worker


def _script(c: str) -> str:
    o = ord(c)
    return "latin" if o < 0x80 else "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else ""


def _options() -> dict[str, list[str]]:
    """Letters of each class, Latin first, then Greek, then Cyrillic."""
    out: dict[str, list[str]] = {}
    for table in (_GREEK, _CYRILLIC_GREEK, _CYRILLIC):
        for letter, shown in table.items():
            row = out.setdefault(shown, [shown])
            if _script(letter) not in {_script(x) for x in row}:
                row.append(letter)
    return out


_CHOICES = _options()

#: Letters counted in bigrams, by place in the score table.
_LETTERS = [c for c in map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x370, 0x530))) if c.isalpha()]


def spell(token: str, scores: Mapping[str, float]) -> str:
    """Best spelling of a folded token; marks go with the letter before them."""
    paths: list[tuple[float, str, str]] = [(0.0, "", "")]  # score, last letter, spelling
    for c in token:
        if "\u0300" <= c <= "\u036f":
            paths = [(s, last, out + c) for s, last, out in paths]
            continue
        after = []
        for letter in _CHOICES.get(c, (c,)):
            best = None
            for s, last, out in paths:
                if last:
                    s += scores.get(last + letter, -_SWITCH / 2) if _script(last) == _script(letter) else -_SWITCH
                if best is None or s > best[0]:
                    best = (s, letter, out + letter)
            after.append(best)
        paths = after
    return max(paths, key=lambda p: p[0])[2]


class Normaliser:
    """Form of texts under given bigram scores; keeps what it met in bounded caches."""

    def __init__(self, scores: Mapping[str, float] | None = None):
        self.scores = scores or {}
        self.runs: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def _run(self, m: re.Match) -> str:
        run = m.group()
        out = self.runs.get(run)
        if out is None:
            out = unicodedata.normalize("NFD", run.translate(_PREPARE)).translate(_FOLD)
            if len(run) <= 8:
                if len(self.runs) >= _KEPT:
                    self.runs.clear()
                self.runs[run] = out
        return out

    def _token(self, m: re.Match) -> str:
        token = m.group()
        out = self.tokens.get(token)
        if out is None:
            out = spell(token, self.scores)
            if len(self.tokens) >= _KEPT:
                self.tokens.clear()
            self.tokens[token] = out
        return out

    def __call__(self, text: str) -> str:
        text = text.replace("\t", " ")
        if text.isascii():
            return text
        folded = unicodedata.normalize("NFD", _OTHERS.sub(self._run, text))
        return unicodedata.normalize("NFC", _TOKEN.sub(self._token, folded))


def bigram_scores(df: DataFrame, text: str) -> dict[str, float]:
    """Logarithms of the shares of following letters, over neighbours in one script in all texts.

    The table has at most 500 x 500 entries, whatever the size of the collection.
    """
    size = len(_LETTERS) + 1
    place = np.zeros(0x531, np.int64)
    for i, c in enumerate(_LETTERS, 1):
        place[ord(c)] = i
    script = np.array([0] + [{"latin": 1, "greek": 2, "cyrillic": 3}[_script(c)] for c in _LETTERS])

    def counted(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                joined = "\n".join(t for t in b.column(0).slice(at, 500).to_pylist() if t)
                i = place[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0x530)]
                x, y = i[:-1], i[1:]
                same = (script[x] == script[y]) & (x > 0)
                total += np.bincount(x[same] * size + y[same], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    rows = df.select(F.col(text).alias("t")).mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    first: dict[int, int] = {}
    for r in rows:
        first[r["pair"] // size] = first.get(r["pair"] // size, 0) + r["n"]
    return {_LETTERS[r["pair"] // size - 1] + _LETTERS[r["pair"] % size - 1]: math.log(r["n"] / first[r["pair"] // size]) for r in rows}


def normal_form(df: DataFrame, text: str, out: str = "normal", scores: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with the consistent form of ``text`` as column ``out``.

    Defined cases: null gives null, empty gives empty (as does text made of
    invisible characters only); a column of the name ``out`` is replaced;
    texts of any length are taken whole.  Line breaks, case, digits, raised
    digits, accents and the number of blanks stay; a tab is a kind of blank.
    """
    table = df.sparkSession.sparkContext.broadcast(dict(scores or {}))

    def form(t):
        normal = Normaliser(table.value)
        return pa.array([None if x is None else normal(x) for x in t.to_pylist()], pa.string())

    form.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(form, "string")(F.col(text)))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def same_looking(df: DataFrame, key: str, text: str, scores: Mapping[str, float] | None = None) -> DataFrame:
    """``key_a, key_b``: pairs of rows whose texts differ as strings and have the same form.

    Defined cases: null and empty texts take no part; equal texts make no
    pair; a null key makes no pair; an empty table gives no rows; other columns
    are ignored.  Texts are read once; only keys and two 128-bit hashes are shuffled, groups of one form
    with one text leave before pairing, and copies meet only what they are paired with in the result.
    """
    table = df.sparkSession.sparkContext.broadcast(dict(scores or {}))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t")).where("key is not null and t <> ''")

    def hashed(batches):
        normal = Normaliser(table.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(normal(t)) for t in texts], pa.binary()), pa.array([_digest(t) for t in texts], pa.binary())], ["key", "form", "raw"])

    hashes = written(rows.mapInArrow(hashed, f"key {dict(rows.dtypes)['key']}, form binary, raw binary"), "forms")
    # A form with one text keeps one hash; only the others are paired, text by text, whatever the number of their copies.
    mixed = hashes.groupBy("form").agg(F.min("raw").alias("least"), F.max("raw").alias("most")).where("least <> most").select("form")
    members = hashes.join(mixed, "form", "left_semi")
    texts = members.select("form", "raw").distinct()
    different = paired_within(texts, ["form"], "raw")
    x, y = (members.select("form", F.col("raw").alias(f"raw_{c}"), F.col("key").alias(c)) for c in "ab")
    pairs = spread_join(spread_join(different, x, ["form", "raw_a"], "a"), y, ["form", "raw_b"], "b").where("a <> b")
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
