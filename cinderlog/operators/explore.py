"""Record explorer: search, filters, sort, pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fields import Fields


def _has(text: Column, query: str) -> Column:
    return F.contains(F.lower(text.cast("string")), F.lit(query.lower().strip()))


def search_all_columns(df: DataFrame, query: str) -> DataFrame:
    """Rows where the text of any column holds the query, case ignored; a blank query keeps all."""
    if not query or not query.strip():
        return df
    hit = F.lit(False)
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        text = F.to_json(column) if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)) else column
        hit = hit | F.coalesce(_has(text, query), F.lit(False))
    return df.where(hit)


def filter_columns(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose named columns each hold their text, case ignored."""
    fields = Fields(df)
    for name, query in filters.items():
        if query and query.strip():
            df = df.where(_has(fields.text(name), query))
    return df


def filter_levels(df: DataFrame, levels: list[str]) -> DataFrame:
    """Rows whose level contains, or is contained in, one of the levels (so WARN meets WARNING)."""
    if not levels:
        return df
    level = F.upper(Fields(df).first_filled("level", "log_level"))
    hit = F.lit(False)
    for wanted in levels:
        word = F.lit(wanted.upper())
        hit = hit | F.contains(level, word) | F.contains(word, level)
    return df.where(hit)


def filter_status_class(df: DataFrame, classes: list[str]) -> DataFrame:
    """Rows whose status starts with the digit of one of the classes (``2xx`` …)."""
    if not classes:
        return df
    fields = Fields(df)
    status = F.coalesce(*[F.when(fields.filled(n) != "0", fields.filled(n)) for n in ("status_code", "status")])
    return df.where(F.substring(status, 1, 1).isin(*[c[:1] for c in classes]))


def filter_time_range(df: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Rows between the bounds, both included; rows without a time are dropped once a bound is given.

    A plain comparison on the column, so it reaches the Parquet scan.
    """
    time = Fields(df).timestamp()
    if start is not None:
        df = df.where(time >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(time <= F.lit(end).cast("timestamp"))
    return df


def sort_order(key: str, direction: str) -> Column:
    column = F.col(f"`{key}`")
    if direction not in ("asc", "desc"):
        raise ValueError(f"direction must be 'asc' or 'desc', not {direction!r}")
    return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()


def sort_records(df: DataFrame, key: str | None, direction: str | None) -> DataFrame:
    """Sorted by one key, NULLs last both ways; equal keys keep line order."""
    if not key or not direction:
        return df
    return df.orderBy(sort_order(key, direction), *_tie(df))


def _tie(df: DataFrame) -> list[Column]:
    return [F.col("line_id")] if "line_id" in df.columns else []


def paginate(df: DataFrame, key: str, direction: str = "asc", page: int = 1, rows_per_page: int = 50) -> DataFrame:
    """One page of the sorted rows: a top-k, not a full sort.

    Its cost grows with the page number; follow pages with ``next_page`` instead of asking for deep ones.
    """
    if page < 1 or rows_per_page < 1:
        raise ValueError("page and rows_per_page start at 1")
    return df.orderBy(sort_order(key, direction), *_tie(df)).offset((page - 1) * rows_per_page).limit(rows_per_page)


def next_page(df: DataFrame, key: str, last_key, last_line_id: int, direction: str = "asc", rows_per_page: int = 50) -> DataFrame:
    """The page after a given last row (keyset paging): same cost for every page."""
    column = F.col(f"`{key}`")
    later = F.col("line_id") > last_line_id
    if last_key is None:
        beyond = column.isNull() & later
    else:
        passed = column > F.lit(last_key) if direction == "asc" else column < F.lit(last_key)
        beyond = passed | ((column == F.lit(last_key)) & later) | column.isNull()
    return df.where(beyond).orderBy(sort_order(key, direction), *_tie(df)).limit(rows_per_page)


def page_count(df: DataFrame, rows_per_page: int) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.ceil(F.count(F.lit(1)) / rows_per_page).cast("bigint").alias("total_pages"),
    )


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Visible columns, in order; names the table lacks are read from ``attrs``."""
    fields = Fields(df)
    return df.select(*[F.col(f"`{c}`") if fields.has(c) else fields.text(c).alias(c) for c in columns])


def head(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("line_id").limit(n)


def tail(df: DataFrame, n: int) -> DataFrame:
    """Last ``n`` records, newest first."""
    return df.orderBy(F.desc("line_id")).limit(n)


def filter_rules(rules: DataFrame, search: str = "", category: str = "all") -> DataFrame:
    """Rules whose name, id or description holds the text, of one category or all."""
    hit = _has(F.col("name"), search) | _has(F.col("rule_id"), search) | _has(F.col("description"), search)
    kept = rules.where(hit) if search else rules
    return kept if category == "all" else kept.where(F.col("category") == category)
