"""Queries of the training-data operators, by the names the driver calls."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.leakage import leaked_items
from readloom.llm.lookalikes import bigram_scores, normal_form, same_looking
from readloom.llm.mixing import mix
from readloom.llm.near_duplicates import classes, expand, near_duplicates
from readloom.llm.quantiles import checked_percentiles, skewed_groups
from readloom.llm.splitting import split_items
from readloom.llm.term_counts import marked, marked_terms, token_counts
from readloom.plans.shape import spread

METRICS = ("mean_q", "length", "min_q")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = spread(_table(spark, sf_dir, "rad_reads").select("read_key", "seq"))
    pairs = expand(near_duplicates(reads, "read_key", "seq", threshold=0.5, k=12, min_length=60))
    return pairs.select(F.col("key_a").alias("read_key_a"), F.col("key_b").alias("read_key_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read that takes part, with the least key of its class and the number of its links."""
    reads = spread(_table(spark, sf_dir, "rad_reads").select("read_key", "seq"))
    return classes(near_duplicates(reads, "read_key", "seq", threshold=0.5, k=12, min_length=60)).select(F.col("key").alias("read_key"), "class_id", "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skewed_groups(_table(spark, sf_dir, "rad_reads"), "run_id", METRICS, upper=90, lower=50, times=2.0)
    return found.select(F.col("grp").alias("run_id"), "metric")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, median and tails of every run: the exact value found within the digest's bounds, and whether these keep the stated error."""
    found = checked_percentiles(_table(spark, sf_dir, "rad_reads"), "run_id", METRICS, [5, 25, 50, 75, 90, 99])
    return found.select(F.col("grp").alias("run_id"), "metric", "percent", "n", "rank", "value", "within_bounds", "within_error")


def _linkers(spark: SparkSession, sf_dir: str) -> list[str]:
    """Linkers of all layouts; a table of fixed size, whose number the operator checks."""
    layout = _table(spark, sf_dir, "read_layout")
    return [r["seq"] for r in layout.where("class = 'linker' and seq is not null").select("seq").distinct().collect()]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_items(_table(spark, sf_dir, "rad_reads"), "read_key", "seq", _linkers(spark, sf_dir), limit=1000, least=500, overlap=60)
    return pieces.select(F.col("key").alias("read_key"), "piece_no", "start_at", "end_at")


def p3_bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads cut by recursive bisection at the strongest boundary near each midpoint."""
    pieces = split_items(_table(spark, sf_dir, "rad_reads"), "read_key", "seq", _linkers(spark, sf_dir), limit=1000, least=500, overlap=60, method="bisect")
    return pieces.select(F.col("key").alias("read_key"), "piece_no", "start_at", "end_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(_table(spark, sf_dir, "rad_reads"), "seq", k=8, common_one_in=20, rare_one_in=3000).where("mark is not null").select("term", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(_table(spark, sf_dir, "rad_reads"), "seq", k=8, common_one_in=20, rare_one_in=3000)


def p5_comment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of read comments, a vocabulary without a bound."""
    reads = _table(spark, sf_dir, "rad_reads")
    counts = token_counts(reads, F.expr("regexp_extract_all(lower(seq_comment), '[a-z0-9]+', 0)"))
    return marked(counts, reads.select(F.count(F.lit(1))).scalar(), common_one_in=20, rare_one_in=3000)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spelling scores would not change which texts are equal, so they are not counted here.
    docs, items = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "eval_items")
    found = leaked_items(docs, "doc_id", "text", items, "item_id", "text", n=13)
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def _mixed(spark: SparkSession, sf_dir: str, **how):
    import public_tokenizers

    return mix(spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "doc_id", "source", "text", _table(spark, sf_dir, "mix_targets"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **how)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).rows.select(F.col("key").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: wanted and reached shares, and what sources at their repeats are short by."""
    return _mixed(spark, sf_dir).shares


def _mix_checked(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """By source: its documents, and whether the mix keeps what it promises.

    Copies are at most ``max_repeats`` and differ by one at most; the tokens are those allotted, to within four
    times the longest document of the source.
    """
    rows, shares = _mixed(spark, sf_dir, **how)
    by_source = rows.groupBy("source").agg(F.max("copies").alias("most"), F.min("copies").alias("least"), F.max("tokens").alias("longest"))
    yes = lambda c: F.coalesce(c, F.lit(True))
    return shares.join(by_source, "source", "left").select(
        "source", "documents", yes(F.col("most") <= F.col("max_repeats")).alias("within_repeats"), yes(F.col("most") - F.col("least") <= 1).alias("even"),
        yes(F.abs(F.col("tokens_used") - F.col("tokens_allotted")) <= 4 * F.col("longest")).alias("as_allotted"),
    )


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix_checked(spark, sf_dir)


def p8_share_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the largest mix in which every source has its share."""
    return _mix_checked(spark, sf_dir, keep_shares=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return same_looking(docs, "doc_id", "text", bigram_scores(docs, "text")).select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text, as a digest of its classes, whatever script the search spelt them in."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = str.maketrans(_letter_pairs())

    def folded(t):
        return pa.array([None if x is None else unicodedata.normalize("NFC", x.translate(pairs)) for x in t.to_pylist()], pa.string())

    folded.__annotations__ = {"t": pa.Array, "return": pa.Array}
    return normal_form(docs, "text", "form", bigram_scores(docs, "text")).select("doc_id", F.md5(F.arrow_udf(folded, "string")("form")).alias("form"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_classes, p2_found, p2_percentiles, p3_found, p3_bisected, p5_found, p5_counts, p5_comment_terms, p7_found, p8_mix, p8_shares, p8_checks, p8_share_checks, p9_found, p9_forms)
    return {f.__name__: f for f in every}


_P2_PERCENTILES = """
WITH v AS (
  SELECT run_id, 'mean_q' AS metric, mean_q AS v FROM rad_reads
  UNION ALL SELECT run_id, 'length', CAST(length AS DOUBLE) FROM rad_reads
  UNION ALL SELECT run_id, 'min_q', CAST(min_q AS DOUBLE) FROM rad_reads),
r AS (
  SELECT run_id, metric, v, row_number() OVER (PARTITION BY run_id, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY run_id, metric) AS n
  FROM v WHERE v IS NOT NULL AND NOT isnan(v))
SELECT run_id, metric, CAST(p AS INTEGER) AS percent, n, i AS rank, v AS value, true AS within_bounds, true AS within_error
FROM r, (SELECT unnest([5, 25, 50, 75, 90, 99]) AS p) WHERE i = (p * n + 99) // 100
"""

_P2 = """
WITH v AS (
  SELECT run_id, 'mean_q' AS metric, mean_q AS v FROM rad_reads
  UNION ALL SELECT run_id, 'length', CAST(length AS DOUBLE) FROM rad_reads
  UNION ALL SELECT run_id, 'min_q', CAST(min_q AS DOUBLE) FROM rad_reads),
r AS (
  SELECT run_id, metric, v, row_number() OVER (PARTITION BY run_id, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY run_id, metric) AS n
  FROM v WHERE v IS NOT NULL AND NOT isnan(v)),
q AS (
  SELECT run_id, metric, max(CASE WHEN i = (90 * n + 99) // 100 THEN v END) AS u, max(CASE WHEN i = (50 * n + 99) // 100 THEN v END) AS l
  FROM r GROUP BY run_id, metric)
SELECT run_id, metric FROM q WHERE u >= 2 * l
"""

_P3 = """
WITH RECURSIVE long_reads AS (SELECT read_key, seq, length(seq) AS n FROM rad_reads WHERE length(seq) > 1000),
linkers AS (SELECT DISTINCT upper(seq) AS m FROM read_layout WHERE class = 'linker' AND seq IS NOT NULL),
places AS (SELECT read_key, seq, n, unnest(range(n + 1)) AS p FROM long_reads),
marks AS (
  SELECT read_key, p FROM places, linkers WHERE upper(substr(seq, CAST(p + 1 AS BIGINT), length(m))) = m
  UNION
  SELECT read_key, p FROM places WHERE p >= 6 AND regexp_full_match(substr(seq, CAST(p - 5 AS BIGINT), 6), '[Nn-]{6}') AND NOT regexp_full_match(substr(seq, CAST(p + 1 AS BIGINT), 1), '[Nn-]')),
listed AS (SELECT l.read_key, l.n, coalesce((SELECT list(m.p) FROM marks m WHERE m.read_key = l.read_key), []) AS ps FROM long_reads l),
pieces AS (
  SELECT read_key, n, ps, CAST(1 AS BIGINT) AS piece_no, CAST(0 AS BIGINT) AS start_at,
    CASE WHEN n <= 1000 THEN n ELSE coalesce(list_max(list_filter(ps, lambda p: p BETWEEN 500 AND 1000)), 1000) END AS end_at
  FROM listed
  UNION ALL
  SELECT read_key, n, ps, piece_no + 1, end_at - 60,
    CASE WHEN n - (end_at - 60) <= 1000 THEN n ELSE coalesce(list_max(list_filter(ps, lambda p: p BETWEEN end_at - 60 + 500 AND end_at - 60 + 1000)), end_at - 60 + 1000) END
  FROM pieces WHERE end_at < n)
SELECT read_key, piece_no, start_at, CAST(end_at AS BIGINT) AS end_at FROM pieces
"""

_P5 = """
WITH t AS (SELECT read_key, substr(upper(seq), i, 8) AS term FROM (SELECT read_key, seq, unnest(range(1, length(seq) - 6)) AS i FROM rad_reads)),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT read_key) AS records FROM t WHERE regexp_full_match(term, '[ACGT]{8}') GROUP BY term),
n AS (SELECT count(*) AS n FROM rad_reads)
SELECT term, occurrences, records, CASE WHEN records * 20 >= n THEN 'common' WHEN records <= greatest(1, n // 3000) THEN 'rare' END AS mark FROM c, n
"""


# An exact prefix-filtered join: pairs at 0.5 share one of the first half of their stretches, rare ones first.
_P1 = """
WITH r AS (SELECT read_key, upper(seq) AS s FROM rad_reads WHERE length(seq) >= 60),
k AS (SELECT DISTINCT read_key, substr(s, CAST(i AS BIGINT), 12) AS t FROM (SELECT read_key, s, unnest(range(1, length(s) - 10)) AS i FROM r)),
f AS (SELECT t, count(*) AS df FROM k GROUP BY t),
o AS (SELECT k.read_key, k.t, row_number() OVER (PARTITION BY read_key ORDER BY df, k.t) AS i, count(*) OVER (PARTITION BY read_key) AS n FROM k JOIN f ON f.t = k.t),
p AS (SELECT read_key, t, n FROM o WHERE i <= n - CAST(ceil(n / 2) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.read_key AS x, b.read_key AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.t = b.t AND a.read_key < b.read_key WHERE 2 * least(a.n, b.n) >= greatest(a.n, b.n)),
v AS (SELECT x, y, nx, ny, count(*) AS shared FROM c JOIN k a ON a.read_key = x JOIN k b ON b.read_key = y AND b.t = a.t GROUP BY x, y, nx, ny)
SELECT x AS read_key_a, y AS read_key_b FROM v WHERE 2 * shared >= nx + ny - shared
"""


_P1_CLASSES = f"""
WITH RECURSIVE pairs AS MATERIALIZED (SELECT * FROM ({_P1})),
live AS (SELECT read_key FROM rad_reads WHERE length(seq) >= 60),
edges AS (SELECT read_key_a AS x, read_key_b AS y FROM pairs UNION ALL SELECT read_key_b, read_key_a FROM pairs),
reach AS (SELECT read_key AS x, read_key AS y FROM live UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT x AS read_key, min(y) AS class_id, (SELECT count(*) FROM edges e WHERE e.x = reach.x) AS links FROM reach GROUP BY x
"""

_P3_BISECTED = """
WITH RECURSIVE long_reads AS (SELECT read_key, seq, CAST(length(seq) AS BIGINT) AS n FROM rad_reads WHERE length(seq) > 1000),
linkers AS (SELECT DISTINCT upper(seq) AS m FROM read_layout WHERE class = 'linker' AND seq IS NOT NULL),
places AS (SELECT read_key, seq, n, unnest(range(n + 1)) AS p FROM long_reads),
marks AS (
  SELECT read_key, p, 2 AS strength FROM places, linkers WHERE upper(substr(seq, CAST(p + 1 AS BIGINT), length(m))) = m
  UNION
  SELECT read_key, p, 1 FROM places WHERE p >= 6 AND regexp_full_match(substr(seq, CAST(p - 5 AS BIGINT), 6), '[Nn-]{6}') AND NOT regexp_full_match(substr(seq, CAST(p + 1 AS BIGINT), 1), '[Nn-]')),
strongest AS (SELECT read_key, p, max(strength) AS strength FROM marks GROUP BY ALL),
listed AS (SELECT l.read_key, l.n, coalesce((SELECT list({'p': m.p, 'w': m.strength}) FROM strongest m WHERE m.read_key = l.read_key), []) AS ps FROM long_reads l),
-- A boundary's claim: its strength, then how near it is to the middle, then its place, in one number that gives the place back.
cuts AS (
  SELECT read_key, ps, CAST(0 AS BIGINT) AS s, n AS e FROM listed
  UNION ALL
  SELECT read_key, ps, CASE side WHEN 0 THEN s ELSE c END, CASE side WHEN 0 THEN c ELSE e END
  FROM (
    SELECT read_key, ps, s, e, coalesce((3000000000000 - list_max(list_transform(
      list_filter(ps, lambda b: b.p > s AND b.p < e AND abs(b.p - (s + e) // 2) <= greatest(1, (e - s) // 4)),
      lambda b: b.w * 1000000000000 - abs(b.p - (s + e) // 2) * 1000000 - b.p))) % 1000000, (s + e) // 2) AS c
    FROM cuts WHERE e - s > 1000 - CASE WHEN s > 0 THEN 60 ELSE 0 END), (SELECT unnest([0, 1]) AS side))
SELECT read_key, row_number() OVER (PARTITION BY read_key ORDER BY s) AS piece_no, greatest(0, s - 60) AS start_at, CAST(e AS BIGINT) AS end_at
FROM cuts WHERE e - s <= 1000 - CASE WHEN s > 0 THEN 60 ELSE 0 END
"""

_P5_COMMENT_TERMS = """
WITH t AS (SELECT read_key, unnest(regexp_extract_all(lower(seq_comment), '[a-z0-9]+')) AS term FROM rad_reads),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT read_key) AS records FROM t GROUP BY term),
n AS (SELECT count(*) AS n FROM rad_reads)
SELECT term, occurrences, records, CASE WHEN records * 20 >= n THEN 'common' WHEN records <= greatest(1, n // 3000) THEN 'rare' END AS mark FROM c, n
"""

_P8_CHECKS = """
SELECT m.source, count(d.doc_id) AS documents, true AS within_repeats, true AS even, true AS as_allotted
FROM mix_targets m LEFT JOIN documents d ON d.source = m.source AND d.text IS NOT NULL WHERE m.source IS NOT NULL GROUP BY m.source
"""

# Fixed values, written down for the SQL apart from the operator's own: code points of letters and the letter each looks like.
_SAME_SHAPE = """
0391 A 0392 B 0395 E 0396 Z 0397 H 0399 I 039A K 039C M 039D N 039F O 03A1 P 03A4 T 03A5 Y 03A7 X 03BF o 037F J 03F2 c 03F3 j 03F9 C
0410 A 0412 B 0415 E 041A K 041C M 041D H 041E O 0420 P 0421 C 0422 T 0423 Y 0425 X 0430 a 0435 e 043E o 0440 p 0441 c 0443 y 0445 x
0405 S 0406 I 0408 J 0455 s 0456 i 0458 j 0474 V 0475 v 04AE Y 04C0 I 04CF l 0501 d 04BB h 051A Q 051B q 051C W 051D w
0413 \u0393 041F \u03A0 0424 \u03A6 00B5 \u03BC
"""


def _letter_pairs() -> dict[str, str]:
    """Letters and accented letters by the letter that stands for their class."""
    words = _SAME_SHAPE.split()
    pairs = {chr(int(a, 16)): b for a, b in zip(words[::2], words[1::2], strict=True)}
    for c in map(chr, range(0xC0, 0x530)):
        first, *marks = unicodedata.normalize("NFD", c)
        shown = unicodedata.normalize("NFC", pairs.get(first, first) + "".join(marks))
        if marks and len(shown) == 1 and shown != c:
            pairs[c] = shown
    return pairs


def _form_sql(column: str) -> str:
    """The consistent form without its spelling: one letter stands for every class, which keeps the same texts apart and together."""
    quote = lambda t: t.replace("'", "''")
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | _letter_pairs()
    # Format characters but those with a shape of their own, and marks that select or join without showing.
    gone = r"[\x{AD}\x{34F}\x{61C}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0001}\x{E0020}-\x{E007F}\x{E0100}-\x{E01EF}]"
    plain = f"regexp_replace(regexp_replace({column}, '{gone}', '', 'g'), '[\\t\\p{{Zs}}]', ' ', 'g')"
    return f"nfc_normalize(translate(nfc_normalize({plain}), '{quote(''.join(pairs))}', '{quote(''.join(pairs.values()))}'))"


def _p7_sql() -> str:
    words = lambda column: f"regexp_extract_all(lower({_form_sql(column)}), '[\\pL\\pN]+')"
    runs = lambda key, table: f"SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, {words('text')} AS w FROM {table} WHERE text IS NOT NULL))"
    return f"SELECT DISTINCT d.doc_id, e.item_id FROM ({runs('doc_id', 'documents')}) d JOIN ({runs('item_id', 'eval_items')}) e ON d.t = e.t"


def _p9_sql() -> str:
    return f"""
WITH f AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_classes": _P1_CLASSES,
        "p2_percentiles": _P2_PERCENTILES,
        "p3_bisected": _P3_BISECTED,
        "p5_comment_terms": _P5_COMMENT_TERMS,
        "p8_checks": _P8_CHECKS,
        "p8_share_checks": _P8_CHECKS,
        "p9_forms": f"SELECT doc_id, md5({_form_sql('text')}) AS form FROM documents",
        "p2_found": _P2,
        "p3_found": _P3,
        "p5_found": f"SELECT term, mark FROM ({_P5}) WHERE mark IS NOT NULL",
        "p5_counts": _P5,
        "p7_found": _p7_sql(),
        "p9_found": _p9_sql(),
    }
