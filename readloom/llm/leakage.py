"""Held-out passages inside corpus documents (problem 7).

A prefix-filtered set join.  A document leaks an item if it holds one of the
item's runs of ``n`` words, and so all of the run's shingles of two words: the
prefix that has to be joined is the run's rarest shingle.  Shingles are ordered
by the number of corpus documents that hold them, each run of an item is
indexed under its rarest one with its place, and every place of a document
whose shingle is a prefix is laid over the indexed places of the items.  Length
and position bound the overlap, then the words on both sides are compared
outwards; ``n`` equal words in a row are a leak.

The pass that counts shingles also sees which documents hold ``n - 1`` shingles
of items in a row, as any leak must; only those, a small share of a corpus, are
written and joined.

Scale: documents are read once for each block of items and never shuffled; only
counts of the items' shingles are.  Items go to every task in blocks of a
checked size, so their number is not limited by memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.lookalikes import Normaliser
from readloom.plans.scratch import written

_WORD = re.compile(r"\w+")


def words(text: str, normal: Normaliser) -> list[str]:
    """Maximal runs of letters and digits of the consistent form, in lower case."""
    return _WORD.findall(normal(text).lower().replace("_", " "))


Shingle = tuple[str, str]


def index(items: Mapping[int, list[str]], rarity: Mapping[Shingle, int], n: int) -> dict[Shingle, list[tuple[int, int]]]:
    """Places (item, position) of prefix shingles."""
    found: dict[Shingle, set[tuple[int, int]]] = {}
    for item, w in items.items():
        pairs = list(zip(w, w[1:]))
        rank = [(rarity.get(p, 0), p, -i) for i, p in enumerate(pairs)]
        for at in range(len(w) - n + 1):
            place = -min(rank[at : at + n - 1])[2]
            found.setdefault(pairs[place], set()).add((item, place))
    return {p: sorted(places) for p, places in found.items()}


def leaks(doc: list[str], items: Mapping[int, list[str]], prefixes: Mapping[Shingle, list[tuple[int, int]]], n: int) -> set[int]:
    """Items of which the document holds ``n`` words in a row."""
    found: set[int] = set()
    if len(doc) < n:
        return found
    for p, pair in enumerate(zip(doc, doc[1:])):
        places = prefixes.get(pair)
        if places is None:
            continue
        for item, q in places:
            if item in found:
                continue
            other = items[item]
            before, after = min(p, q), min(len(doc) - p, len(other) - q)
            if before + after < n:
                continue
            i, j = 1, 2
            while i <= before and doc[p - i] == other[q - i]:
                i += 1
            while j < after and doc[p + j] == other[q + j]:
                j += 1
            if i - 1 + j >= n:
                found.add(item)
    return found


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["key"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def leaked_items(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 13, scores: Mapping[str, float] | None = None, block_chars: int = 16_000_000) -> DataFrame:
    """``key, item``: documents and items with ``n`` consecutive words in common, once each.

    Defined cases: null and empty texts, and texts of fewer than ``n`` words,
    match nothing; null keys are kept; repeated documents match each; items
    with equal texts or keys are reported as their keys say; an empty table on either side gives no
    rows; other columns are ignored.  ``block_chars`` bounds the items held by a task at once.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    docs = corpus.select(F.col(key).alias("key"), F.col(text).alias("t")).where("t is not null")
    wanted = items.select(F.col(item_key).alias("key"), F.col(item_text).alias("t")).where("t is not null")
    spark, kinds = corpus.sparkSession, (dict(docs.dtypes)["key"], dict(wanted.dtypes)["key"])
    out = None
    for block in _blocks(wanted, block_chars):
        normal = Normaliser(scores)
        held = {i: w for i, (_, t) in enumerate(block) if len(w := words(t, normal)) >= n}
        names = [k for k, _ in block]
        known = spark.sparkContext.broadcast(({p for w in held.values() for p in zip(w, w[1:])}, dict(scores or {})))

        def counted(batches, known=known):
            """Rows of two kinds: documents that may hold a leak, and the task's counts of the items' shingles."""
            shingles, scores = known.value
            normal, total = Normaliser(scores), Counter()
            is_known, row = shingles.__contains__, b"\x01" * (n - 1)
            names = ["a", "b", "n", "key", "t"]
            for b in batches:
                may = []
                for i, t in enumerate(b.column(1).to_pylist()):
                    w = words(t, normal)
                    pairs = list(zip(w, w[1:]))
                    hit = bytes(map(is_known, pairs))
                    total.update(set(compress(pairs, hit)))
                    if row in hit:
                        may.append(i)
                kept = b.take(pa.array(may, pa.int64()))
                none = pa.nulls(len(may), pa.string())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(may), pa.int64()), kept.column(0), kept.column(1)], names)
                kind = b.column(0).type
            if total:
                first, second = ([p[i] for p in total] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(list(total.values()), pa.int64()), pa.nulls(len(total), kind), pa.nulls(len(total), pa.string())], names)

        seen = written(docs.mapInArrow(counted, f"a string, b string, n long, key {kinds[0]}, t string"), "leaks")
        # At most as many rows as the block of items has shingles.
        counts = seen.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
        rarity = {(r["a"], r["b"]): r["n"] for r in counts.collect()}
        side = spark.sparkContext.broadcast((held, index(held, rarity, n), dict(scores or {})))

        def matched(batches, side=side):
            held, prefixes, scores = side.value
            normal = Normaliser(scores)
            for b in batches:
                rows, which = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for item in sorted(leaks(words(t, normal), held, prefixes, n)):
                        rows.append(i)
                        which.append(item)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.int64())], ["key", "place"])

        pairs = seen.where("a is null").select("key", "t").mapInArrow(matched, f"key {kinds[0]}, place long")
        keys = spark.createDataFrame(list(enumerate(names)), f"place long, item {kinds[1]}")
        pairs = pairs.join(F.broadcast(keys), "place").select("key", "item")
        out = pairs if out is None else out.unionAll(pairs)
    if out is None:
        out = spark.createDataFrame([], f"key {kinds[0]}, item {kinds[1]}")
    return out.distinct()
