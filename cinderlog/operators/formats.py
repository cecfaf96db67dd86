"""Log formats as column expressions.

A format says how to read a line with ordinary columns: ``stages`` add the costly intermediate columns
(one regex pass, one JSON parse) step by step, ``fields`` maps them to record fields. Keeping the costly
part in a column of its own lets Spark evaluate it once per line however many fields are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions.fields import safe_int
from ..functions.text import (
    blank_to_null, captures, contains_any, csv_cells, dash_to_null, group, matched, raw_group, strip,
)
from ..functions.times import access_timestamp, bsd_timestamp, iso_timestamp, normalize_timestamp
from ..schema import RECORD_FIELDS

Stage = dict[str, Column]


@dataclass(frozen=True)
class Format:
    """One log format.

    ``matches`` is the detection test and ``parsed`` the success test, both over the stage columns.
    ``scoring`` is ``composite`` (weighted quality parts), ``flat`` (match rate times ``weight``) or
    ``tabular`` (first-line tests, then composite).
    """

    name: str
    description: str
    priority: int
    extensions: tuple[str, ...]
    stages: Callable[[Column], list[Stage]]
    fields: Callable[[], dict[str, Column]]
    parsed: Callable[[], Column]
    matches: Callable[[Column], Column]
    raw: Callable[[Column], Column] = strip
    scoring: str = "flat"
    weight: float = 1.0
    declared: tuple[str, ...] = ()
    numeric: tuple[str, ...] = field(default=())


# -- access logs ---------------------------------------------------------------------------------

# Fixed value: common or combined access line. Groups: address, user, time, method, path, protocol,
# whole request (only when it is not method + path), status, size, referer, agent.
ACCESS_PATTERN = (
    r'(?Ud)^(\S+) - (\S+) \[([^\]]+)\] '
    r'"(?:([A-Z]+)\s+([^"\s]+)(?:\s+(HTTP/[0-9.]+))?|([^"]*))" '
    r'(\d+) (\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?\s*$'
)


def _access_stages(value: Column) -> list[Stage]:
    return [
        {"_access": captures(value, ACCESS_PATTERN, 11)},
        {"_access_time": access_or_other_timestamp(raw_group(F.col("_access"), 3))},
    ]


def _access_fields() -> dict[str, Column]:
    g = F.col("_access")
    return {
        "source_ip": group(g, 1),
        "remote_user": dash_to_null(group(g, 2)),
        "timestamp": F.col("_access_time"),
        "method": group(g, 4),
        "path": group(g, 5),
        "protocol": group(g, 6),
        # A target that is not method + path is kept whole; an empty one stays empty text.
        "request": F.when(raw_group(g, 4) == "", raw_group(g, 7)),
        "status_code": raw_group(g, 8).try_cast("bigint"),
        "size": raw_group(g, 9).try_cast("bigint"),
        "referer": dash_to_null(group(g, 10)),
        "user_agent": dash_to_null(group(g, 11)),
    }


def access_or_other_timestamp(text: Column) -> Column:
    """Access layout by its fixed shape; other layouts through the general list."""
    usual = text.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$")
    return F.when(usual, access_timestamp(text)).otherwise(normalize_timestamp(text))


_ACCESS_DECLARED = (
    "source_ip", "timestamp", "method", "path", "status_code", "size",
    "remote_user", "protocol", "referer", "user_agent",
)


def _access(name: str, label: str, priority: int, extensions: tuple[str, ...]) -> Format:
    return Format(
        name=name, description=f"{label} Combined/Common Access Log", priority=priority,
        extensions=extensions, stages=_access_stages, fields=_access_fields,
        parsed=lambda: matched(F.col("_access")), matches=lambda value: matched(F.col("_access")),
        raw=lambda value: value, scoring="composite", declared=_ACCESS_DECLARED,
        numeric=("status_code", "size"),
    )


# -- syslog --------------------------------------------------------------------------------------

# BSD layout (priority, time, host, process, pid, message) and RFC 5424 layout (priority,
# time, host, process, pid, message id, structured data, message).
BSD_SYSLOG_PATTERN = (
    r"(?Ud)^(?:<(\d+)>)?([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s+(.*)$"
)
IETF_SYSLOG_PATTERN = (
    r"(?Ud)^<(\d+)>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+|-)\s+(\S+)\s+(-|(?:\[[^\]]+\])+)(?:\s+(.*))?$"
)

# Level by priority modulo 8, and keywords where no priority is given.
SYSLOG_LEVELS = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG")
SYSLOG_ERROR_WORDS = ("failed", "failure", "error", "kill", "out of memory", "panic", "fatal")


def syslog_level(priority: Column, message: Column) -> Column:
    """Level from the priority, else from words in the message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    by_word = (
        F.when(contains_any(text, SYSLOG_ERROR_WORDS), "ERROR")
        .when(F.contains(text, F.lit("warn")), "WARNING")
        .when(F.contains(text, F.lit("notice")), "NOTICE")
        .otherwise("INFO")
    )
    by_priority = F.get(F.array(*[F.lit(n) for n in SYSLOG_LEVELS]), F.pmod(priority, F.lit(8)).cast("int"))
    return F.when(priority.isNotNull(), by_priority).otherwise(by_word)


def _syslog_stages(value: Column, year: int) -> list[Stage]:
    line = strip(value)
    bsd = F.when(~F.coalesce(matched(F.col("_ietf")), F.lit(False)), captures(line, BSD_SYSLOG_PATTERN, 6))
    ietf_time = normalize_timestamp(raw_group(F.col("_ietf"), 2), year=year)
    return [
        {"_ietf": captures(line, IETF_SYSLOG_PATTERN, 8)},
        {"_bsd": bsd, "_ietf_time": ietf_time},
        {"_bsd_time": bsd_timestamp(raw_group(F.col("_bsd"), 2), year)},
    ]


def _syslog_fields() -> dict[str, Column]:
    ietf, bsd = F.col("_ietf"), F.col("_bsd")
    is_ietf, is_bsd = matched(ietf), matched(bsd)
    pick = lambda i, b: F.when(is_ietf, i).otherwise(b)
    priority = pick(raw_group(ietf, 1), group(bsd, 1)).try_cast("bigint")
    message = pick(group(ietf, 8), raw_group(bsd, 6))
    return {
        "priority": priority,
        "timestamp": pick(F.col("_ietf_time"), F.col("_bsd_time")),
        "hostname": pick(raw_group(ietf, 3), raw_group(bsd, 3)),
        "process": pick(raw_group(ietf, 4), raw_group(bsd, 4)),
        "pid": pick(raw_group(ietf, 5), raw_group(bsd, 5)).try_cast("bigint"),
        "msgid": dash_to_null(raw_group(ietf, 6)),
        "structured_data": dash_to_null(raw_group(ietf, 7)),
        "message": message,
        "syslog_version": F.when(is_ietf, "5424").when(is_bsd, "3164"),
        "level": F.when(is_ietf | is_bsd, syslog_level(priority, message)),
    }


def syslog_format(year: int) -> Format:
    """Syslog; ``year`` dates the BSD layout, which carries no year."""
    parsed = lambda: matched(F.col("_ietf")) | F.coalesce(matched(F.col("_bsd")), F.lit(False))
    return Format(
        name="syslog", description="Syslog (RFC 3164 / RFC 5424)", priority=60,
        extensions=(".log", ".syslog"), stages=lambda value: _syslog_stages(value, year), fields=_syslog_fields,
        parsed=parsed, matches=lambda value: parsed(), weight=0.90,
    )


# -- application logs ----------------------------------------------------------------------------

# Fixed values: "[time] LEVEL logger: message" and "time - logger - LEVEL - message".
BRACKET_APP_PATTERN = r"(?Ud)^\[([^\]]+)\]\s+(\w+)\s+([\w\.]+):\s+(.*)$"
DASH_APP_PATTERN = (
    r"(?Ud)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:,\d+)?)\s+-\s+([\w\.]+)\s+-\s+(\w+)\s+-\s+(.*)$"
)


def _app_stages(value: Column) -> list[Stage]:
    line = strip(value)
    dash = F.when(~F.coalesce(matched(F.col("_bracket")), F.lit(False)), captures(line, DASH_APP_PATTERN, 4))
    text = F.when(matched(F.col("_bracket")), raw_group(F.col("_bracket"), 1)).otherwise(raw_group(F.col("_dashed"), 1))
    return [
        {"_bracket": captures(line, BRACKET_APP_PATTERN, 4)},
        {"_dashed": dash},
        {"_app_text": F.replace(text, F.lit(","), F.lit("."))},
        {"_app_time": normalize_timestamp(F.col("_app_text"))},
    ]


def _app_fields() -> dict[str, Column]:
    bracket, dashed = F.col("_bracket"), F.col("_dashed")
    pick = lambda b, d: F.when(matched(bracket), raw_group(bracket, b)).otherwise(raw_group(dashed, d))
    level = F.upper(pick(2, 3))
    return {
        "timestamp": F.col("_app_time"),
        "level": F.when(level == "WARN", "WARNING").otherwise(level),
        "logger": pick(3, 2),
        "message": pick(4, 4),
    }


def _app_parsed() -> Column:
    return matched(F.col("_bracket")) | F.coalesce(matched(F.col("_dashed")), F.lit(False))


# -- JSON lines ----------------------------------------------------------------------------------

# Key aliases (any case) and level words.
JSON_TIME_ALIASES = ("ts", "time", "@timestamp")
JSON_MESSAGE_ALIASES = ("msg", "log")
JSON_LEVEL_KEYS = ("level", "lvl", "severity")
JSON_LEVEL_WORDS = ("INFO", "WARNING", "WARN", "ERROR", "DEBUG", "FATAL", "CRITICAL")

_JSON_SPECIAL = ("format", "parse_error", "raw", "attrs", "timestamp", "message", "level")


def _json_stages(value: Column) -> list[Stage]:
    """The object as a map, in document order, the last value of a repeated key kept.

    Reading ``[line]`` as an array refuses text after the object; two objects give two elements.
    """
    read = F.from_json(
        F.concat(F.lit("["), strip(value), F.lit("]")),
        T.ArrayType(T.MapType(T.StringType(), T.StringType())),
        {"allowSingleQuotes": "false"},
    )
    found = F.col("_json_read")
    once = F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    m = F.col("_json_map")
    keys = F.map_keys(m)
    last_of_key = F.map_from_entries(
        F.filter(
            F.map_entries(m),
            lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0,
        )
    )
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return [
        {"_json_read": read},
        {"_json_map": once},
        {"_json": F.when(repeated, last_of_key).otherwise(m)},
        {"_json_text": _json_aliased(F.col("_json"), "timestamp", JSON_TIME_ALIASES)},
        {"_json_time": normalize_timestamp(F.col("_json_text"))},
    ]


def _json_aliased(m: Column, name: str, aliases: tuple[str, ...]) -> Column:
    """Last entry, in document order, under the name or one of its aliases."""
    hits = F.filter(F.map_entries(m), lambda e: (e["key"] == name) | F.lower(e["key"]).isin(*aliases))
    return F.try_element_at(hits, F.lit(-1))["value"]


def json_level(m: Column) -> Column:
    """Level keys in order, else the first value that is a level word."""
    explicit = F.lit(None).cast("string")
    for key in reversed(JSON_LEVEL_KEYS):
        explicit = F.when(
            F.map_contains_key(m, F.lit(key)), F.upper(F.coalesce(m[key], F.lit("NONE")))
        ).otherwise(explicit)
    inferred = F.try_element_at(
        F.filter(F.map_values(m), lambda v: F.upper(v).isin(*JSON_LEVEL_WORDS)), F.lit(1)
    )
    level = F.coalesce(blank_to_null(explicit), F.upper(inferred))
    return F.when(level == "WARN", "WARNING").otherwise(level)


def map_fields(m: Column, skip: tuple[str, ...] = _JSON_SPECIAL) -> dict[str, Column]:
    """Map keys that name a record field, cast to its type; the rest stays in ``attrs``."""
    out: dict[str, Column] = {}
    for name, kind in RECORD_FIELDS.items():
        if name in skip:
            continue
        out[name] = safe_int(m[name]) if isinstance(kind, T.LongType) else m[name]
    return out


def _json_fields() -> dict[str, Column]:
    m = F.col("_json")
    lifted = [n for n in RECORD_FIELDS if n not in ("attrs", "format", "parse_error")]
    aliases = JSON_TIME_ALIASES + JSON_MESSAGE_ALIASES
    out = map_fields(m)
    out["timestamp"] = F.col("_json_time")
    out["message"] = _json_aliased(m, "message", JSON_MESSAGE_ALIASES)
    out["level"] = json_level(m)
    out["attrs"] = F.map_filter(m, lambda k, v: ~(k.isin(*lifted) | F.lower(k).isin(*aliases)))
    return out


def _json_matches(value: Column) -> Column:
    line = strip(value)
    return F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}")) & F.col("_json").isNotNull()


# -- Windows events ------------------------------------------------------------------------------

# Header cells, row levels and XML level numbers.
WINDOWS_HEADER_CELLS = (
    "level", "date and time", "source", "event id", "task category", "description", "keywords",
)
WINDOWS_EXPORT_CELLS = ("keywords", "date and time", "source", "event id", "task category")
WINDOWS_LEVELS = {
    "INFORMATION": "INFO", "AUDIT SUCCESS": "AUDIT_SUCCESS", "AUDIT FAILURE": "AUDIT_FAILURE",
    "WARNING": "WARNING", "ERROR": "ERROR", "CRITICAL": "CRITICAL",
}
WINDOWS_XML_LEVELS = {1: "CRITICAL", 2: "ERROR", 3: "WARNING", 4: "INFO"}

WINDOWS_XML_SCHEMA = T.StructType([
    T.StructField("System", T.StructType([
        T.StructField("Provider", T.StructType([T.StructField("_Name", T.StringType())])),
        T.StructField("EventID", T.StringType()),
        T.StructField("TimeCreated", T.StructType([T.StructField("_SystemTime", T.StringType())])),
        T.StructField("Level", T.StringType()),
        T.StructField("Task", T.StringType()),
    ])),
    T.StructField("EventData", T.StructType([
        T.StructField("Data", T.ArrayType(T.StructType([
            T.StructField("_VALUE", T.StringType()), T.StructField("_Name", T.StringType()),
        ]))),
    ])),
])


def has_cell(cells: Column, words: tuple[str, ...]) -> Column:
    """Whether any cell is one of the words."""
    return F.arrays_overlap(
        F.transform(cells, lambda c: F.lower(strip(c))), F.array(*[F.lit(w) for w in words])
    )


def windows_row_level(cell: Column) -> Column:
    level = F.upper(strip(cell))
    out = F.lit("INFO")
    for word, name in reversed(WINDOWS_LEVELS.items()):
        out = F.when(level == word, name).otherwise(out)
    return out


def _cell(cells: Column, i: int) -> Column:
    return strip(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))


def windows_row_fields(cells: Column, time: Column | None = None) -> dict[str, Column]:
    """Record fields of one export row, by position."""
    cell = lambda i: _cell(cells, i)
    return {
        "level": windows_row_level(cell(0)),
        "timestamp": normalize_timestamp(cell(1)) if time is None else time,
        "source": blank_to_null(cell(2)),
        "event_id": safe_int(cell(3)),
        "category": blank_to_null(cell(4)),
        "message": blank_to_null(cell(5)),
    }


def windows_row_raw(cells: Column) -> Column:
    """The row's cells joined again, padded to six."""
    padding = F.array_repeat(F.lit(""), F.greatest(F.lit(6) - F.size(cells), F.lit(0)))
    return F.array_join(F.concat(cells, padding), ",")


def _windows_stages(value: Column) -> list[Stage]:
    line = strip(value)
    is_event = F.startswith(line, F.lit("<Event"))
    xml_shape = is_event & F.contains(line, F.lit("</Event>"))
    cells = F.when(~xml_shape & F.contains(line, F.lit(",")), csv_cells(line))
    c = F.col("_cells")
    header = has_cell(c, WINDOWS_HEADER_CELLS)
    fourth = strip(F.get(c, F.lit(3)))
    row_shape = (F.size(c) >= 4) & (header | fourth.rlike(r"(?U)^\d*$"))
    return [
        {
            "_xml": F.when(xml_shape, F.from_xml(line, WINDOWS_XML_SCHEMA, {"mode": "PERMISSIVE"})),
            "_xml_shape": xml_shape,
            # A line that opens an event but never closes it is never read as a row.
            "_cells": cells,
            "_event_start": is_event,
        },
        {
            "_header": F.coalesce(header, F.lit(False)),
            "_row_shape": F.coalesce(row_shape, F.lit(False)),
            "_event_text": F.when(
                F.col("_xml_shape"),
                # Spark keeps microseconds.
                F.regexp_replace(F.col("_xml")["System"]["TimeCreated"]["_SystemTime"], r"(\.\d{6})\d+", "$1"),
            ).otherwise(_cell(c, 1)),
        },
        {"_event_time": normalize_timestamp(F.col("_event_text"))},
    ]


def _windows_fields() -> dict[str, Column]:
    xml, cells = F.col("_xml"), F.col("_cells")
    time = F.col("_event_time")
    row = windows_row_fields(cells, time)
    number = safe_int(xml["System"]["Level"])
    xml_level = F.lit("INFO")
    for n, name in WINDOWS_XML_LEVELS.items():
        xml_level = F.when(number == n, name).otherwise(xml_level)
    data = F.transform(
        xml["EventData"]["Data"],
        lambda d: F.when(
            blank_to_null(d["_Name"]).isNotNull(),
            F.concat(d["_Name"], F.lit("="), F.coalesce(d["_VALUE"], F.lit(""))),
        ).otherwise(F.coalesce(d["_VALUE"], F.lit(""))),
    )
    event = {
        "timestamp": time,
        "level": xml_level,
        "source": xml["System"]["Provider"]["_Name"],
        "event_id": safe_int(xml["System"]["EventID"]),
        "category": xml["System"]["Task"],
        "message": blank_to_null(F.array_join(data, "; ")),
    }
    shape = F.col("_xml_shape")
    return {name: F.when(shape, event[name]).otherwise(row[name]) for name in row}


def _windows_parsed() -> Column:
    """Well shaped, not a header, and at least one of time, source and event id is there."""
    f = _windows_fields()
    some = f["timestamp"].isNotNull() | f["source"].isNotNull() | f["event_id"].isNotNull()
    row = F.col("_row_shape") & ~F.col("_header") & ~F.col("_event_start")
    return (F.col("_xml_shape") | row) & some


def _windows_raw(value: Column) -> Column:
    return F.when(F.col("_row_shape") & ~F.col("_header"), windows_row_raw(F.col("_cells"))).otherwise(strip(value))


# -- user formats --------------------------------------------------------------------------------

# Captured fields that are numbers.
NUMERIC_FIELDS = ("status_code", "status", "size", "bytes_sent", "body_bytes_sent", "event_id")


def _column_of(prefix: str, name: str) -> str:
    """A column of a user format; any name can be registered, so what is not a word character is spelled out."""
    return prefix + re.sub(r"[^A-Za-z0-9]", lambda m: f"_{ord(m.group()):x}_", name)


def regex_format(
    name: str,
    pattern: str,
    timestamp_field: str | None = None,
    timestamp_format: str | None = None,
    priority: int = 50,
    extensions: tuple[str, ...] = (),
) -> Format:
    """A format from a regular expression with named groups.

    Groups named after record fields fill them; the others go to ``attrs``.
    """
    try:
        compiled = re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"Invalid regex pattern: {exc}") from exc
    if not compiled.groupindex:
        raise ValueError("Custom pattern must contain at least one named group (?P<name>...)")
    names = dict(compiled.groupindex)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m.group(1)]}", plain)
    # The pattern may sit anywhere in the line; the wrapper spans the line and keeps the leftmost match.
    spanning = rf"(?Ud)^(?s:.*?)(?:{plain})(?s:.*)$"
    column = _column_of("_re_", name)

    timed = timestamp_field if timestamp_field in names else ("timestamp" if "timestamp" in names else None)

    def stages(value: Column) -> list[Stage]:
        out = [{column: captures(value, spanning, compiled.groups)}]
        if timed:
            fmt = timestamp_format if timed == timestamp_field else None
            out.append({f"{column}_time": normalize_timestamp(raw_group(F.col(column), names[timed]), fmt)})
        return out

    def fields() -> dict[str, Column]:
        g = F.col(column)
        value = lambda n: safe_int(group(g, names[n])) if n in NUMERIC_FIELDS else group(g, names[n])
        out: dict[str, Column] = {}
        loose: list[Column] = []
        for n in names:
            if n == "timestamp":
                continue
            if n in RECORD_FIELDS and n not in ("attrs", "raw", "format", "parse_error"):
                kind = RECORD_FIELDS[n]
                out[n] = safe_int(group(g, names[n])) if isinstance(kind, T.LongType) else value(n)
            else:
                loose += [F.lit(n), value(n).cast("string")]
        if timed:
            out["timestamp"] = F.col(f"{column}_time")
        if loose:
            out["attrs"] = F.when(matched(g), F.create_map(*loose))
        return out

    return Format(
        name=name, description=f"Custom format: {name}", priority=priority, extensions=extensions,
        stages=stages, fields=fields, parsed=lambda: matched(F.col(column)), matches=lambda value: matched(F.col(column)),
        raw=lambda value: value, weight=0.95,
    )


def python_format(
    name: str,
    parse: Callable[[str], dict | None],
    description: str = "",
    priority: int = 50,
    extensions: tuple[str, ...] = (),
) -> Format:
    """A format from a Python function ``line -> dict`` (None for a bad line), run in Arrow batches.

    The slow path, for layouts that no expression can read.
    """
    column = _column_of("_py_", name)

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def read(lines: pd.Series) -> pd.Series:
        def one(line):
            found = parse(line) if line is not None else None
            return None if found is None else {k: None if v is None else str(v) for k, v in found.items()}

        return lines.map(one)

    def fields() -> dict[str, Column]:
        m = F.col(column)
        out = map_fields(m, skip=("format", "parse_error", "raw", "attrs", "timestamp"))
        out["timestamp"] = normalize_timestamp(m["timestamp"])
        out["attrs"] = F.map_filter(m, lambda k, v: ~k.isin(*RECORD_FIELDS))
        return out

    present = lambda: F.col(column).isNotNull()
    return Format(
        name=name, description=description or f"Custom format: {name}", priority=priority,
        extensions=extensions, stages=lambda value: [{column: read(value)}], fields=fields,
        parsed=present, matches=lambda value: present(), raw=lambda value: value, weight=0.95,
    )


# -- registry ------------------------------------------------------------------------------------

#: Year given to BSD syslog times unless a caller passes another.
DEFAULT_YEAR = 2024


def builtin_formats(year: int = DEFAULT_YEAR) -> dict[str, Format]:
    formats = [
        Format(
            name="json", description="JSON Lines Log Parser", priority=90, extensions=(".json", ".jsonl"),
            stages=_json_stages, fields=_json_fields, parsed=lambda: F.col("_json").isNotNull(),
            matches=_json_matches, weight=0.95,
        ),
        _access("nginx", "Nginx", 80, (".log", ".txt")),
        _access("apache", "Apache", 75, (".log", ".txt", ".conf")),
        Format(
            name="django", description="Django / Python Logging Parser", priority=65,
            extensions=(".log", ".txt"), stages=_app_stages, fields=_app_fields, parsed=_app_parsed,
            matches=lambda value: _app_parsed(), weight=0.85,
        ),
        syslog_format(year),
        Format(
            name="windows", description="Windows Event Log (CSV / XML)", priority=55,
            extensions=(".csv", ".xml"), stages=_windows_stages, fields=_windows_fields,
            parsed=_windows_parsed, matches=lambda value: F.col("_xml_shape") | F.col("_row_shape"),
            raw=_windows_raw, scoring="tabular",
            declared=("timestamp", "level", "source", "event_id", "category", "message"),
            numeric=("event_id",),
        ),
    ]
    return {f.name: f for f in formats}


_user_formats: dict[str, Format] = {}


def register_format(
    name: str, pattern: str, timestamp_field: str | None = None, timestamp_format: str | None = None
) -> Format:
    """Register a regex format by name; a second registration replaces the first."""
    return add_format(regex_format(name, pattern, timestamp_field, timestamp_format))


def add_format(fmt: Format) -> Format:
    _user_formats[fmt.name] = fmt
    return fmt


def unregister_format(name: str) -> None:
    _user_formats.pop(name, None)


def known_formats(year: int = DEFAULT_YEAR) -> dict[str, Format]:
    """Built-in and registered formats, by priority then name."""
    merged = {**builtin_formats(year), **_user_formats}
    return dict(sorted(merged.items(), key=lambda kv: (-kv[1].priority, kv[0])))
