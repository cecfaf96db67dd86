"""Canonical record schema shared by every parser and operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

RECORD_FIELDS: dict[str, T.DataType] = {
    "format": T.StringType(),
    "parse_error": T.BooleanType(),
    "raw": T.StringType(),
    "timestamp": T.TimestampType(),
    "level": T.StringType(),
    "message": T.StringType(),
    "source_ip": T.StringType(),
    "remote_user": T.StringType(),
    "method": T.StringType(),
    "path": T.StringType(),
    "protocol": T.StringType(),
    "request": T.StringType(),
    "status_code": T.LongType(),
    "size": T.LongType(),
    "referer": T.StringType(),
    "user_agent": T.StringType(),
    "hostname": T.StringType(),
    "process": T.StringType(),
    "pid": T.LongType(),
    "priority": T.LongType(),
    "syslog_version": T.StringType(),
    "msgid": T.StringType(),
    "structured_data": T.StringType(),
    "logger": T.StringType(),
    "source": T.StringType(),
    "event_id": T.LongType(),
    "category": T.StringType(),
    "attrs": T.MapType(T.StringType(), T.StringType()),
}

#: Columns a lines table must have.
LINE_COLUMNS = ("line_id", "source_file", "value")


def null_of(name: str) -> Column:
    return F.lit(None).cast(RECORD_FIELDS[name])


def require_columns(df: DataFrame, names: tuple[str, ...] | list[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} needs the columns {missing}; found {df.columns}")
