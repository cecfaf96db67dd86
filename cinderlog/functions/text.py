"""Text column expressions: one-pass captures, CSV cells, trimming, URL decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: Separator for one-pass captures; a line that holds it takes the per-group path instead.
_MARK = "\x01"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def dash_to_null(col: Column) -> Column:
    return F.when(col != "-", col)


def captures(col: Column, pattern: str, groups: int) -> Column:
    """Groups 1..n of a pattern that spans the whole line, as an array (index 1 is group 1).

    The pattern runs once per line: a matched line is rewritten to its marked group values and split,
    where asking ``regexp_extract`` for each group would run it once per group. A line that does not
    match leaves an array without index 1. Groups that took no part give ``''``.
    """
    marked = "".join(f"{_MARK}${i}" for i in range(1, groups + 1))
    one_pass = F.split(F.regexp_replace(col, F.lit(pattern), F.lit(marked)), _MARK)
    per_group = F.when(
        col.rlike(pattern),
        F.array(F.lit(""), *[F.regexp_extract(col, pattern, i) for i in range(1, groups + 1)]),
    )
    return F.when(F.contains(col, F.lit(_MARK)), per_group).otherwise(one_pass)


def matched(array: Column) -> Column:
    return F.get(array, F.lit(1)).isNotNull()


def raw_group(array: Column, index: int) -> Column:
    return F.get(array, F.lit(index))


def group(array: Column, index: int) -> Column:
    """Group ``index`` of ``captures``, NULL when the group is empty."""
    return blank_to_null(raw_group(array, index))


def contains_any(col: Column, words: list[str] | tuple[str, ...]) -> Column:
    found = F.contains(col, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(col, F.lit(word))
    return found


# A cell up to its closing comma: quoted (doubled quotes inside, text after the closing quote kept),
# left open to the end of the line, or plain.
_CSV_CELL = r'("(?:[^"]++|"")*+(?:"[^,]*,|$)|[^,]*,)'


def csv_cells(col: Column) -> Column:
    """Cells of one CSV line as an array; a quote left open runs to the end of the line."""
    cells = F.regexp_extract_all(F.concat(col, F.lit(",")), F.lit(_CSV_CELL), F.lit(1))

    def unquote(cell: Column) -> Column:
        body = F.substring(cell, F.lit(1), F.char_length(cell) - 1)
        inner = F.regexp_replace(body, r'^"((?:[^"]++|"")*+)"?', "$1")
        return F.when(F.startswith(body, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(body)

    return F.transform(cells, unquote)


def url_decode_lenient(col: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed ``%`` alone; bad UTF-8 becomes U+FFFD."""
    safe = F.replace(F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(col, F.lit("%")), F.try_url_decode(safe)).otherwise(col)
