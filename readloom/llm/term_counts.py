"""Occurrences and record counts of every distinct term (problem 5).

Every term keeps a last-seen counter: occurrences, records and the last record
met.  Within a task tokens are partitioned by term, in order of records; a token
whose record differs from the term's last one adds a record, so no set of terms
is built for any record.  Counters of tasks are then partitioned by term over
the cluster and added up, since a record never leaves its task.

``term_counts`` is for stretches of ``k`` letters A, C, G, T, where the term's
code is its place in a table of ``4**k`` counters; ``token_counts`` is for values
of any kind.

Scale: what is shuffled depends on the number of tasks and the vocabulary, not
on the number of tokens; a term that is everywhere costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.blocks import blocks

_BASES = "ACGT"
_BASE_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(_BASES):
    _BASE_CODE[ord(_c)] = _BASE_CODE[ord(_c.lower())] = _i


def base_terms(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (first base most significant) and record numbers of all terms, in order of records."""
    column = column.drop_null().cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    if end - start < k:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    base = _BASE_CODE[np.frombuffer(column.buffers()[2], np.uint8)[start:end]]
    bounds = offsets - start
    n = len(base) - k + 1
    wrong = np.cumsum(np.r_[np.zeros(1, np.int32), base > 3], dtype=np.int32)
    ok = wrong[k:] == wrong[:n]
    for back in range(1, k):  # windows over the end of a record
        at = bounds[1:] - back
        ok[at[(at >= 0) & (at < n)]] = False
    code = np.zeros(n, np.uint16 if k <= 8 else np.uint32)
    for i in range(k):
        code = (code << 2) | (base[i : n + i] & 3)
    record = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(bounds))[:n]
    return code[ok], record[ok]


class LastSeen:
    """Counters of terms by number: occurrences, records and the last record met."""

    def __init__(self, size: int):
        self.occurrences, self.records, self.last = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)

    def grow(self, size: int) -> None:
        more = max(size, 2 * len(self.last)) - len(self.last)
        if size > len(self.last):
            self.occurrences, self.records = (np.r_[x, np.zeros(more, np.int64)] for x in (self.occurrences, self.records))
            self.last = np.r_[self.last, np.full(more, -1, np.int64)]

    def see(self, term: np.ndarray, record: np.ndarray) -> None:
        """Tokens in order of records; a record may go on from the tokens seen before."""
        if not len(term):
            return
        order = np.argsort(term, kind="stable")
        t, r = term[order], record[order]
        first = np.r_[True, t[1:] != t[:-1]]
        before = np.r_[np.int64(-1), r[:-1]]
        before[first] = self.last[t[first]]
        size = len(self.last)
        self.occurrences += np.bincount(t, minlength=size)
        self.records += np.bincount(t[r != before], minlength=size)
        final = np.r_[first[1:], True]
        self.last[t[final]] = r[final]


def term_counts(df: DataFrame, text: str, k: int = 8) -> DataFrame:
    """``term, occurrences, records`` of every term of ``k`` bases (1 to 10) in upper-cased ``text``.

    Defined cases: null and short texts are records without terms; a stretch
    that holds any other letter is no term; a term repeated in a record adds
    occurrences but one record; equal rows are different records; an empty
    table gives no rows; other columns are ignored.
    """
    if not 1 <= k <= 10:
        raise ValueError("k must lie between 1 and 10")
    size = 4**k
    slices = min(256, size)
    width = size // slices
    kind = "slice int, occurrences binary, records binary"

    def batch(i, occurrences, records):
        return pa.RecordBatch.from_pydict({"slice": pa.array(i, pa.int32()), "occurrences": [x.tobytes() for x in occurrences], "records": [x.tobytes() for x in records]})

    def partial(batches):
        seen, met = LastSeen(size), 0
        for b in batches:
            for _, part in blocks(b.column(0).drop_null()):
                code, record = base_terms(part, k)
                seen.see(code, record.astype(np.int64) + met)
                met += len(part)
        if seen.occurrences.any():
            yield batch(range(slices), seen.occurrences.reshape(slices, width), seen.records.reshape(slices, width))

    def merged(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, o, r in zip(*(b.column(j).to_pylist() for j in range(3))):
                both = np.stack([np.frombuffer(o, np.int64), np.frombuffer(r, np.int64)])
                total[i] = total[i] + both if i in total else both
        for i, (o, r) in total.items():
            at = np.flatnonzero(o)
            code = at + i * width
            letters = np.stack([np.frombuffer(_BASES.encode(), np.uint8)[(code >> 2 * (k - 1 - j)) & 3] for j in range(k)], axis=1)
            terms = [x.decode() for x in letters.copy().view(f"S{k}").ravel().tolist()]
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "occurrences": o[at], "records": r[at]})

    return df.select(F.col(text).alias("t")).mapInArrow(partial, kind).repartition("slice").mapInArrow(merged, "term string, occurrences long, records long")


def token_counts(df: DataFrame, tokens: Column, hold: int = 500_000) -> DataFrame:
    """``term, occurrences, records`` of every distinct value in ``tokens``, an array of strings for each record.

    For vocabularies of any size: a task keeps last-seen counters of the terms it meets and hands them on when it
    holds more than ``hold``; Spark then hash-partitions the counters by term and adds them up.

    Defined cases: a null or empty array is a record without terms; null elements are no terms, empty strings are;
    a value repeated in a record adds occurrences but one record; equal rows are different records; an empty table
    gives no rows; other columns are ignored.
    """

    def partial(batches):
        place: dict[str, int] = {}
        seen, met = LastSeen(1024), 0

        def out():
            n = len(place)
            return pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), pa.array(seen.occurrences[:n]), pa.array(seen.records[:n])], ["term", "occurrences", "records"])

        for b in batches:
            # A record is never cut: a batch is taken in slices of whole records.
            for at in range(0, b.num_rows, 1000):
                lists = b.column(0).slice(at, 1000)
                per = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                flat, record = lists.flatten(), np.repeat(np.arange(len(lists), dtype=np.int64) + met, per)
                met += len(lists)
                known = flat.is_valid().to_numpy(zero_copy_only=False)
                coded = flat.drop_null().dictionary_encode()
                number = np.array([place.setdefault(t, len(place)) for t in coded.dictionary.to_pylist()], np.int64)
                seen.grow(len(place))
                if len(number):
                    seen.see(number[coded.indices.to_numpy()], record[known])
                if len(place) > hold:
                    yield out()
                    place, seen = {}, LastSeen(1024)
        if place:
            yield out()

    parts = df.select(tokens.alias("t")).mapInArrow(partial, "term string, occurrences long, records long")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, text: str, k: int = 8, common_one_in: int = 20, rare_one_in: int = 3000) -> DataFrame:
    """``term_counts`` with ``mark``: ``common`` from one record in ``common_one_in`` on, else ``rare`` up to one in
    ``rare_one_in`` (at least one record), else null.  All rows of ``df`` count as records."""
    n = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return marked(term_counts(df, text, k), n, common_one_in, rare_one_in)


def marked(counts: DataFrame, n, common_one_in: int, rare_one_in: int) -> DataFrame:
    """``counts`` of terms among ``n`` records, a number or a column, with their marks."""
    rare = F.col("records") <= F.greatest(F.lit(1), F.floor(F.lit(n) / rare_one_in))
    return counts.withColumn("mark", F.when(F.col("records") * common_one_in >= n, "common").when(rare, "rare"))
