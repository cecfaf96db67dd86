"""Writing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: timestamps in text exports.
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def json_line(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object per record; absent values are left out."""
    return F.to_json(F.struct(*(columns or df.columns)), {"timestampFormat": _STAMP})


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("timestampFormat", _STAMP).json(path)


def csv_line(columns: list[str]) -> Column:
    """Record as one CSV line: every cell quoted, quotes doubled, NULL as an empty cell."""
    cells = [
        F.concat(
            F.lit('"'),
            F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')),
            F.lit('"'),
        )
        for c in columns
    ]
    return F.concat_ws(",", *cells)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Chosen columns in order, with a header in every part file."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns]
    df.select(*text).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
