"""Several values packed in one field (problem 6).

The field is split at its quote characters with SQL functions.  A fold over the
pieces decides which quotes are quotes: one opens a stretch only at the start of
a value or right after a colon, and only if a matching one closes it; until
then every piece is a literal.  Other pieces are split on delimiters.  The fold
puts the pieces of a value together, and values come out with their ordinals.

Everything stays in the JVM; fields without quotes, the most common ones, are
split directly and skip the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLASS = r"[ \t,;|]"

# One step outside of a stretch; ``p`` is a quote character or text without any.
_OPENS = r"""
  p in ('"', "'") and not s.again and (not s.begun or s.value like '%:')
  and regexp_like(substr(f, s.at + 2), case when p = '"' then '^[^"]*+(?:""[^"]*+)*+"' else "^[^']*+(?:''[^']*+)*+'" end)"""
_PARTS = rf"split(p, r'{_CLASS}', -1)"
_OUTSIDE = f"""
  case when {_OPENS}
         then named_struct('done', s.done, 'value', s.value, 'begun', true, 'quote', p, 'again', false, 'at', s.at + 1)
       when size({_PARTS}) = 1
         then named_struct('done', s.done, 'value', s.value || p, 'begun', true, 'quote', '', 'again', false, 'at', s.at + length(p))
       else named_struct(
         'done', s.done || filter(array(s.value || element_at({_PARTS}, 1)) || slice({_PARTS}, 2, size({_PARTS}) - 2), x -> x <> ''),
         'value', element_at({_PARTS}, -1), 'begun', element_at({_PARTS}, -1) <> '', 'quote', '', 'again', false, 'at', s.at + length(p)) end"""

# State: the items done, the value under way and whether it has begun, the open
# quote (or ''), whether that quote was just met again, so that it closes the
# stretch unless it comes once more, and the number of letters folded so far.
_FOLD = rf"""
aggregate(
  regexp_extract_all(f, r'["\x27]|[^"\x27]+', 0),
  named_struct('done', cast(array() as array<string>), 'value', '', 'begun', false, 'quote', '', 'again', false, 'at', 0),
  (s, p) -> case
    when s.quote <> '' and p = s.quote and s.again
      then named_struct('done', s.done, 'value', s.value || p, 'begun', true, 'quote', s.quote, 'again', false, 'at', s.at + 1)
    when s.quote <> '' and p = s.quote
      then named_struct('done', s.done, 'value', s.value, 'begun', true, 'quote', s.quote, 'again', true, 'at', s.at + 1)
    when s.quote <> '' and not s.again
      then named_struct('done', s.done, 'value', s.value || p, 'begun', true, 'quote', s.quote, 'again', false, 'at', s.at + length(p))
    else {_OUTSIDE} end,
  s -> s.done || filter(array(s.value), x -> x <> ''))"""


def quoted_items() -> Column:
    """Items of the column ``f``, which holds quote characters."""
    return F.expr(_FOLD)


def unpack(df: DataFrame, key: str, field: str) -> DataFrame:
    """``key, pos, item``: one row for each value of ``field``, numbered from 1 in its place.

    Delimiters are blank, tab, comma, semicolon and vertical bar, one or more,
    outside quotes.  A value is given without its enclosing quotes, doubled
    quotes inside them once.

    Defined cases: null, empty and delimiter-only fields give no row, and so do
    values that are empty (quoted or not); a quote that is never closed is an
    ordinary letter, so are quotes inside a value; text after a closing quote
    belongs to the value; a null key is kept; repeated rows are split each; an
    empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(field).alias("f")).where("f is not null")
    plain = F.filter(F.split("f", f"{_CLASS}+"), lambda x: x != "")
    items = F.when(F.col("f").rlike("[\"']"), quoted_items()).otherwise(plain)
    return rows.select("key", F.posexplode(items).alias("pos", "item")).select("key", (F.col("pos") + 1).cast("long").alias("pos"), "item")
