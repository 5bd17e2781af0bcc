"""Infix edit distance: a pattern against the best part of each text.

A bit-parallel dynamic program (one 64-bit word a text) runs over all texts of
an Arrow batch at once, one letter a step, so its cost in Python is the longest
text, not the number of texts.  Texts are taken in order of length and leave
when they end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = "struct<distance: int, end: int, ties: int>"
_U = np.uint64
_LONGEST = 63
_FEW = 24


def infix_one(pattern: str, text: str) -> tuple[int, int, int]:
    """Distance, first best end (0-based) and number of best ends; the shorter one is the pattern."""
    if len(text) < len(pattern):
        pattern, text = text, pattern
    m = len(pattern)
    row = list(range(m + 1))
    best, end, ties = m, -1, 0
    for j, c in enumerate(text):
        left, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            left, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, left + (p != c))
        if row[m] < best:
            best, end, ties = row[m], j, 1
        elif row[m] == best and best < m:
            ties += 1
    return best, end, ties


def _places(pattern: str, wild: str = "") -> list[int]:
    """Bits of the places of each letter in the pattern; letters in ``wild`` stand for every canonical base."""
    out = [0] * 256
    for i, c in enumerate(pattern):
        for x in "ACGT" if c in wild else c:
            out[ord(x)] |= 1 << i
    return out


def _continued(text: bytes, eqs: list[int], m: int, j: int, vp: int, vn: int, score: int, best: int, at: int, count: int) -> tuple[int, int, int]:
    """The same steps for the rest of one text."""
    ones, top = (1 << m) - 1, m - 1
    for c in text:
        eq = eqs[c]
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
        hp, hn = (vn | ~(d0 | vp)) & ones, d0 & vp
        score += (hp >> top) - (hn >> top)
        x = (hp << 1) & ones
        vp, vn = ((hn << 1) | ~(d0 | x)) & ones, d0 & x
        if score < best:
            best, at, count = score, j, 1
        elif score == best and best < m:
            count += 1
        j += 1
    return best, at, count


def infix_many(pattern: str, texts: list[str], wild: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``infix_one`` for many texts at once; patterns of ASCII letters, longer than 63 of them text by text in wide integers.

    Letters of the pattern in ``wild`` match every canonical base, and nothing else.
    """
    n, m = len(texts), len(pattern)
    if not m or not pattern.isascii():
        raise ValueError("a pattern has ASCII letters")
    distance, end, ties = np.full(n, m, np.int32), np.full(n, -1, np.int32), np.zeros(n, np.int32)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= (1 if wild else m)]
    places = _places(pattern, wild)
    if m > _LONGEST:
        for i in order.tolist():
            distance[i], end[i], ties[i] = _continued(texts[i].encode("ascii", "replace"), places, m, 0, (1 << m) - 1, 0, m, m, -1, 0)
    elif len(order):
        masks = np.array(places, _U)
        raw = [texts[i].encode("ascii", "replace") for i in order]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = lengths[order]
        start = np.r_[0, np.cumsum(size)[:-1]]
        ones = _U((1 << m) - 1)
        vp, vn = np.full(len(order), ones), np.zeros(len(order), _U)
        score, best = np.full(len(order), m, np.int32), np.full(len(order), m, np.int32)
        at, count = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int32)
        top, live = _U(m - 1), len(order)
        for j in range(int(size[0])):
            while size[live - 1] <= j:
                live -= 1
            if live < _FEW:
                # A few long texts are left: plain integers are faster than arrays of so few.
                for i in range(live):
                    rest = raw[i][j:]
                    best[i], at[i], count[i] = _continued(rest, places, m, j, int(vp[i]), int(vn[i]), int(score[i]), int(best[i]), int(at[i]), int(count[i]))
                break
            p, q = vp[:live], vn[:live]
            eq = masks[data[start[:live] + j]]
            d0 = (((eq & p) + p) ^ p) | eq | q
            hp, hn = q | ~(d0 | p), d0 & p
            s = score[:live]
            s += ((hp >> top) & _U(1)).astype(np.int32)
            s -= ((hn >> top) & _U(1)).astype(np.int32)
            x = (hp << _U(1)) & ones
            vp[:live] = ((hn << _U(1)) | ~(d0 | x)) & ones
            vn[:live] = d0 & x
            b = best[:live]
            better = s < b
            count[:live] = np.where(better, 1, count[:live] + ((s == b) & (b < m)))
            at[:live][better] = j
            np.minimum(b, s, out=b)
        distance[order], end[order], ties[order] = best, at, count
    for i in np.flatnonzero(lengths < (0 if wild else m)):
        distance[i], end[i], ties[i] = infix_one(pattern, texts[i])
    return distance, end, ties


def infix_pairs(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Distances of ``infix_one`` for pairs of strings, the shorter one of each as the pattern.

    All pairs of a block take a step at once, as in ``infix_many``; NUL, other letters than ASCII and patterns of more than
    63 letters are compared pair by pair.
    """
    out = np.zeros(len(patterns), np.int32)
    short, long = zip(*((t, p) if len(t) < len(p) else (p, t) for p, t in zip(patterns, texts))) if len(patterns) else ((), ())
    sizes = np.array([len(t) for t in long], np.int64)
    fits = np.array([0 < len(p) <= _LONGEST and (p + t).isascii() and "\0" not in p + t for p, t in zip(short, long)], bool)
    for i in np.flatnonzero(~fits).tolist():
        out[i] = infix_one(short[i], long[i])[0]
    order = np.flatnonzero(fits)
    order = order[np.argsort(sizes[order], kind="stable")]
    while len(order):
        # Texts of like length, up to a million letters; shorter ones are filled up with NUL, which matches nothing and so betters nothing.
        n = max(1, int(np.searchsorted(sizes[order] * np.arange(1, len(order) + 1), 1_000_000, side="right")))
        block, order = order[:n], order[n:]
        width = int(sizes[block[-1]])
        data = np.array([long[i].encode() for i in block.tolist()], f"S{width}").view(np.uint8).reshape(n, width).T.copy()
        place: dict[str, int] = {}
        own = np.array([place.setdefault(short[i], len(place)) for i in block.tolist()], np.int64)
        code = np.zeros(256, np.int64)
        letters = np.unique(data)
        code[letters] = np.arange(len(letters))
        masks = np.zeros((len(place), len(letters)), _U)
        known = {chr(c): k for k, c in enumerate(letters.tolist())}
        for p, row in place.items():
            for bit, c in enumerate(p):
                if c in known:
                    masks[row, known[c]] |= _U(1 << bit)
        masks, own = masks.ravel(), own * len(letters)
        m = np.array([len(short[i]) for i in block.tolist()], np.int32)
        ones, top = (_U(1) << m.astype(_U)) - _U(1), m.astype(_U) - _U(1)
        vp, vn, score, best = ones.copy(), np.zeros(n, _U), m.copy(), m.copy()
        for column in data:
            eq = masks[own + code[column]]
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = (vn | ~(d0 | vp)) & ones, d0 & vp
            score += ((hp >> top) & _U(1)).astype(np.int32)
            score -= ((hn >> top) & _U(1)).astype(np.int32)
            x = (hp << _U(1)) & ones
            vp, vn = ((hn << _U(1)) | ~(d0 | x)) & ones, d0 & x
            np.minimum(best, score, out=best)
        out[block] = best
    return out


def infix_hits(pattern: str, texts: list[str], most: int, wild: str = "") -> list[list[tuple[int, int, int]]]:
    """``start, end, distance`` of all places of each text within ``most`` edits of the pattern, from left to right; ``end`` is exclusive.

    Ends in a row are one place: its best end, the first on a tie.  Letters of the pattern in ``wild`` match every canonical base.
    """
    m, out = len(pattern), [[] for _ in texts]
    if not m or not pattern.isascii():
        raise ValueError("a pattern has ASCII letters")
    if not most and not any(c in wild for c in pattern):
        for i, t in enumerate(texts):
            at = t.find(pattern)
            while at >= 0:
                if not at or not t.startswith(pattern, at - 1):  # ends in a row are one place
                    out[i].append((at, at + m, 0))
                at = t.find(pattern, at + 1)
        return out
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    places = _places(pattern, wild)
    wide = m > _LONGEST
    masks = np.zeros(256, _U) if wide else np.array(places, _U)
    raw = [texts[i].encode("ascii", "replace") for i in order]
    data, size = np.frombuffer(b"".join(raw), np.uint8), lengths[order]
    start = np.r_[0, np.cumsum(size)[:-1]]
    all_ones = (1 << m) - 1
    ones, top, live = _U(all_ones if not wide else 0), _U(m - 1), len(order)
    vp, vn, score = np.full(live, ones), np.zeros(live, _U), np.full(live, m, np.int32)
    found: list[list[tuple[int, int]]] = [[] for _ in order]
    for j in range(int(size[0])):
        while size[live - 1] <= j:
            live -= 1
        if live < _FEW or wide:
            for i in range(live):
                v, w, s = all_ones if wide else int(vp[i]), int(vn[i]), int(score[i])
                for at, c in enumerate(raw[i][j:], j):
                    eq = places[c]
                    d0 = ((((eq & v) + v) ^ v) | eq | w) & all_ones
                    hp, hn = (w | ~(d0 | v)) & all_ones, d0 & v
                    s += (hp >> (m - 1)) - (hn >> (m - 1))
                    x = (hp << 1) & all_ones
                    v, w = ((hn << 1) | ~(d0 | x)) & all_ones, d0 & x
                    if s <= most:
                        found[i].append((at, s))
            break
        p, q = vp[:live], vn[:live]
        eq = masks[data[start[:live] + j]]
        d0 = (((eq & p) + p) ^ p) | eq | q
        hp, hn = q | ~(d0 | p), d0 & p
        s = score[:live]
        s += ((hp >> top) & _U(1)).astype(np.int32)
        s -= ((hn >> top) & _U(1)).astype(np.int32)
        x = (hp << _U(1)) & ones
        vp[:live] = ((hn << _U(1)) | ~(d0 | x)) & ones
        vn[:live] = d0 & x
        for i in np.flatnonzero(s <= most).tolist():
            found[i].append((j, int(s[i])))
    for i, ends in zip(order.tolist(), found):
        best: tuple[int, int] | None = None
        for k, (at, d) in enumerate(ends):
            if best is None or d < best[1]:
                best = at, d
            if k + 1 == len(ends) or ends[k + 1][0] != at + 1:
                out[i].append((_start(pattern, texts[i], *best, wild), best[0] + 1, best[1]))
                best = None
    return out


def _start(pattern: str, text: str, last: int, distance: int, wild: str = "") -> int:
    """Where a place begins that ends with letter ``last``; the one nearest to the pattern's length on a tie."""
    m = len(pattern)
    if not distance:
        return last + 1 - m
    window = text[max(0, last + 1 - m - distance) : last + 1][::-1]
    row = list(range(len(window) + 1))
    for i, p in enumerate(reversed(pattern), 1):
        left, row[0] = row[0], i
        for j, c in enumerate(window, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (p != c and not (p in wild and c in "ACGT")))
    return last + 1 - min(range(len(window) + 1), key=lambda j: (row[j], abs(j - m)))


def mask_capture(mask: str, text: str, end: int, errors: int) -> str | None:
    """Captured bases of a mask whose best alignment ends at ``end``; none where a best alignment has a gap in or beside a captured block.

    ``N`` captures, ``n`` skips, both match any canonical base.
    """
    m = len(mask)
    window = text[max(0, end + 1 - m - errors) : end + 1]
    cost = lambda p, c: 0 if p == c or p in "Nn" and c in "ACGT" else 1
    rows = [[0] * (len(window) + 1)]
    for i, p in enumerate(mask, 1):
        last = rows[-1]
        row = [i]
        for j, c in enumerate(window, 1):
            row.append(min(last[j - 1] + cost(p, c), last[j] + 1, row[-1] + 1))
        rows.append(row)
    # All best alignments are walked; the first one found, along diagonals, gives the capture.
    todo, seen, captured, straight = [(m, len(window))], set(), [], True
    while todo:
        i, j = todo.pop()
        if (i, j) in seen or not i:
            straight = straight and bool(i)
            continue
        seen.add((i, j))
        if rows[i][j] == rows[i - 1][j] + 1:
            # A letter of the mask is missing from the text.
            if "N" in mask[max(0, i - 2) : i + 1]:
                return None
            todo.append((i - 1, j))
        if j and rows[i][j] == rows[i][j - 1] + 1:
            # The text has a letter more.
            if "N" in mask[i - 1 : i + 1]:
                return None
            todo.append((i, j - 1))
        if j and rows[i][j] == rows[i - 1][j - 1] + cost(mask[i - 1], window[j - 1]):
            if straight and mask[i - 1] == "N":
                if window[j - 1] not in "ACGT":
                    return None
                captured.append(window[j - 1])
            todo.append((i - 1, j - 1))
    return "".join(reversed(captured))


def mask_captures(mask: str, text: Column, max_error: float) -> Column:
    """``distance`` and ``barcode`` of a mask within ``max_error`` of its literal letters, in one orientation; null where it is not found."""
    literal = sum(c not in "Nn" for c in mask)
    most = int(max_error * literal + 1e-9)

    def run(t):
        texts = [x or "" for x in t.to_pylist()]
        d, e, _ = infix_many(mask, texts, "Nn")
        hit = (d <= most) & (e >= 0)
        found = [mask_capture(mask, texts[i], int(e[i]), most) if hit[i] else None for i in range(len(texts))]
        return pa.StructArray.from_arrays([pa.array([int(d[i]) if f is not None else None for i, f in enumerate(found)], pa.int32()), pa.array(found, pa.string())], ["distance", "barcode"])

    run.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<distance: int, barcode: string>")(text)


def infix_distance(pattern: str, text: Column, wild: str = "") -> Column:
    """``distance, end, ties`` of the pattern in each text; null for null."""

    def run(t):
        null = t.is_null().to_numpy(zero_copy_only=False)
        d, e, n = infix_many(pattern, [x or "" for x in t.to_pylist()], wild)
        return pa.StructArray.from_arrays([pa.array(x, mask=null) for x in (d, e, n)], ["distance", "end", "ties"])

    run.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(text)
