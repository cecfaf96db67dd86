"""Timestamp column expressions.

The accepted layouts are a closed list; text in any other layout gives NULL. Each layout is chosen by a
cheap pattern test first, so no row pays for failed parse attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip_chars

# Strptime directives and their Spark pattern letters.
STRPTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%z": "Z", "%b": "MMM", "%B": "MMMM", "%p": "a", "%j": "DDD", "%%": "%",
}

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?\s?(?:Z|[+-]\d{2}:?\d{2})?$"
_ACCESS = r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}[: ]\d{2}:\d{2}:\d{2}"
_BSD = r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"
_US = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}"


def strptime_pattern(fmt: str) -> str:
    """Spark datetime pattern for a strptime format."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            code = fmt[i : i + 2]
            if code not in STRPTIME_TO_SPARK:
                raise ValueError(f"Unsupported strptime directive {code!r} in {fmt!r}")
            out.append(STRPTIME_TO_SPARK[code])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def iso_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd``, optionally with time, fraction (point or comma) and zone."""
    return F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def access_timestamp(text: Column) -> Column:
    """``dd/MMM/yyyy:HH:mm:ss Z``, the access log layout."""
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def bsd_timestamp(text: Column, year: int) -> Column:
    """``MMM d HH:mm:ss`` in ``year``: the layout carries none."""
    dated = F.concat(F.lit(f"{int(year)} "), F.regexp_replace(text, r"\s+", " "))
    return F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss"))


def normalize_timestamp(col: Column, fmt: str | None = None, year: int = 1970) -> Column:
    """Timestamp from text: wrapping quotes and brackets dropped, ``''`` and ``-`` give NULL.

    ``fmt`` is a strptime format tried first. ``year`` completes layouts without a year.
    """
    # The empty text and "-" fit none of the layouts.
    text = strip_chars(col, "[]\"' ")
    zoned = F.try_to_timestamp(
        F.regexp_replace(text, r"^(\d{1,2}/[A-Z][a-z]{2}/\d{4})[: ]", "$1:"),
        F.lit("d/MMM/yyyy:HH:mm:ss[ Z]"),
    )
    known = (
        F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
        .when(text.rlike(_ACCESS), zoned)
        .when(text.rlike(_BSD), bsd_timestamp(text, year))
        .when(text.rlike(_US), F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss[ a]")))
    )
    if fmt:
        return F.coalesce(F.try_to_timestamp(text, F.lit(strptime_pattern(fmt))), known)
    return known
