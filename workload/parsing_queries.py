"""Sources, sinks, parsing and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlog.operators.detection import (
    detect, detect_formats, format_match_rates, format_quality, format_scores, list_formats, rank_formats, sample_head,
)
from cinderlog.operators.exports import export_files
from cinderlog.operators.formats import python_format, regex_format
from cinderlog.operators.parsing import explode_log_text, parse_auto, parse_lines, split_errors
from cinderlog.session import scratch_dir, through_table
from cinderlog.sources.exports import json_line, write_csv, write_json_lines
from cinderlog.sources.files import (
    extension_filter, list_files, read_heads, read_log_lines, read_windows_csv, size_guard,
)

from .catalog import access, duck_stamp, flag, joined, json_records, log_sql, query, r6, stamp, table
from .demo_log import demo_events, demo_lines, spread_events, written_once

# -- sources and sinks ---------------------------------------------------------------------------------


def _write_text(df, spark, label, parts=None):
    """Write the ``value`` column (and partition columns) as text files; gives the folder."""
    path = scratch_dir(spark, label)
    writer = df.write
    (writer.partitionBy(*parts) if parts else writer).text(path)
    return path


@query("read_log_lines", log_sql("SELECT raw_access AS value FROM demo"))
def _(spark, sf):
    # Every line is followed by a blank one; half of the files are gzip.
    events = demo_events(spark, sf).select(
        F.explode(F.array(F.col("raw_access"), F.lit("   "))).alias("value"), (F.col("line_id") % 2).alias("half")
    )
    plain = _write_text(events.where("half = 0").select("value"), spark, "plain")
    packed = scratch_dir(spark, "packed")
    events.where("half = 1").select("value").write.option("compression", "gzip").text(packed)
    return read_log_lines(spark, [plain, packed]).select("value")


_DOC_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS value FROM documents
)"""


@query("latin1_fallback", _DOC_LINES + r"""
SELECT regexp_replace(value, '[^\x00-\xff]', '?', 'g') AS value FROM lines
WHERE regexp_replace(value, '\s', '', 'g') <> ''""")
def _(spark, sf):
    # Two of four folders are written as Latin-1 bytes.
    docs = table(spark, sf, "documents").select(
        (F.col("doc_id") % 4).alias("bucket"), F.regexp_replace("text", r"[^\x00-\xff]", "?").alias("value")
    )
    latin = F.encode(F.col("value"), "ISO-8859-1").cast("string")
    coded = docs.withColumn("value", F.when(F.col("bucket") < 2, latin).otherwise(F.col("value")))
    path = _write_text(coded, spark, "latin1", ["bucket"])
    return read_log_lines(spark, path, latin1="file").select("value")


@query("explode_log_text", r"""
WITH split AS (
  SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS value, unnest(range(1, len(parts) + 1)) AS line_no FROM split
)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, value FROM lines WHERE regexp_replace(value, '\s', '', 'g') <> ''""")
def _(spark, sf):
    return explode_log_text(table(spark, sf, "documents"), "text", ["doc_id"])


@query("read_windows_csv", log_sql(f"""
SELECT {duck_stamp('seen')} AS seen,
  CASE etype WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' WHEN 'click' THEN 'AUDIT_FAILURE' ELSE 'INFO' END AS level,
  host AS source, line_id AS event_id, etype AS category,
  'The "' || msg || '"' || chr(10) || 'as told, on line two' AS message
FROM demo"""))
def _(spark, sf):
    e = demo_events(spark, sf)
    told = F.concat(F.lit('The "'), F.col("msg"), F.lit('"\nas told, on line two'))
    level = "CASE etype WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Warning' WHEN 'click' THEN 'Audit Failure' ELSE 'Information' END"
    path = scratch_dir(spark, "winexport")
    e.select(
        F.expr(level).alias("Level"), stamp("seen").alias("Date and Time"), F.col("host").alias("Source"),
        F.col("line_id").alias("Event ID"), F.col("etype").alias("Task Category"), told.alias("Description"),
    ).write.csv(path, header=True, quoteAll=True, escape='"')
    return read_windows_csv(spark, path).select(
        stamp("timestamp").alias("seen"), "level", "source", "event_id", "category", "message"
    )


@query("write_json_lines", log_sql(
    "SELECT line_id, source_ip, method, path, status_code, size FROM access WHERE NOT parse_error"))
def _(spark, sf):
    good, _bad = split_errors(access(spark, sf))
    path = scratch_dir(spark, "jsonl")
    write_json_lines(good.select("line_id", "source_ip", "method", "path", "status_code", "size"), path)
    schema = "line_id bigint, source_ip string, method string, path string, status_code bigint, size bigint"
    return spark.read.schema(schema).json(path)


@query("json_line", log_sql("""
SELECT line_id, json_extract_string(j, '$.source_ip') AS source_ip, CAST(json_extract(j, '$.status_code') AS BIGINT) AS status_code
FROM (SELECT line_id, json_object('source_ip', source_ip, 'status_code', status_code) AS j FROM access)"""))
def _(spark, sf):
    lines = access(spark, sf).select("line_id", json_line(access(spark, sf), ["source_ip", "status_code", "method"]).alias("j"))
    return lines.select(
        "line_id", F.get_json_object("j", "$.source_ip").alias("source_ip"),
        F.get_json_object("j", "$.status_code").cast("bigint").alias("status_code"),
    )


@query("write_csv", log_sql("""
SELECT '"' || CAST(line_id AS VARCHAR) || '","' || replace(COALESCE(raw, ''), '"', '""') || '","' || COALESCE(path, '')
  || '","' || COALESCE(CAST(size AS VARCHAR), '') || '"' AS line
FROM access"""))
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    write_csv(access(spark, sf), path, ["line_id", "raw", "path", "size"])
    return spark.read.text(path).where("value <> '\"line_id\",\"raw\",\"path\",\"size\"' AND value <> 'line_id,raw,path,size'").select(
        F.col("value").alias("line"))


_GUARD_BYTES = 40_000


@query("size_guard", log_sql(f"""
SELECT 'b' || CAST(line_id % 5 * (line_id % 3) AS VARCHAR) AS bucket,
  CASE WHEN SUM(octet_length(encode(raw_access)) + 1) > {_GUARD_BYTES} THEN 'too_large' ELSE 'ok' END AS verdict,
  CAST(SUM(octet_length(encode(raw_access)) + 1) AS BIGINT) AS bytes
FROM demo GROUP BY 1"""))
def _(spark, sf):
    e = demo_events(spark, sf).select(
        F.concat(F.lit("b"), (F.col("line_id") % 5 * (F.col("line_id") % 3)).cast("string")).alias("bucket"),
        F.col("raw_access").alias("value"),
    )
    path = scratch_dir(spark, "guard")
    e.repartition("bucket").write.partitionBy("bucket").text(path)
    return size_guard(list_files(spark, path), max_bytes=_GUARD_BYTES).select(
        F.regexp_extract("source_file", "bucket=([^/]+)", 1).alias("bucket"), "verdict", "bytes"
    )


@query("unpacked_size_guard", log_sql(f"""
SELECT 'b' || CAST(line_id % 5 * (line_id % 3) AS VARCHAR) AS bucket,
  CAST(SUM(octet_length(encode(raw_access)) + 1) AS BIGINT) AS unpacked_bytes,
  CASE WHEN SUM(octet_length(encode(raw_access)) + 1) > {_GUARD_BYTES} THEN 'unpacks_too_large' ELSE 'ok' END AS verdict
FROM demo GROUP BY 1"""))
def _(spark, sf):
    e = demo_events(spark, sf).select(
        F.concat(F.lit("b"), (F.col("line_id") % 5 * (F.col("line_id") % 3)).cast("string")).alias("bucket"),
        F.col("raw_access").alias("value"),
    )
    path = scratch_dir(spark, "bombs")
    e.repartition("bucket").write.partitionBy("bucket").option("compression", "gzip").text(path)
    lines = read_log_lines(spark, path, latin1="off")
    guarded = size_guard(list_files(spark, path), lines, max_unpacked_bytes=_GUARD_BYTES)
    return guarded.select(
        F.regexp_extract("source_file", "bucket=([^/]+)", 1).alias("bucket"), "unpacked_bytes", "verdict"
    )


_SUFFIX = ".log,.txt,.json,.csv,.gz,.exe,.LOG,.conf".split(",")
_SUFFIX_CASES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIX))


@query("extension_filter", f"""
WITH files AS (SELECT DISTINCT user_id % 5 AS folder, event_id % 8 AS kind, CASE event_id % 8 {_SUFFIX_CASES} END AS suffix FROM events)
SELECT 'f' || CAST(folder AS VARCHAR) || '_' || CAST(kind AS VARCHAR) || suffix AS name FROM files
WHERE regexp_matches(lower(suffix), '\\.(log|txt|json|csv|gz)$')""")
def _(spark, sf):
    # A folder of files whose names are given by the events; it is listed, nothing is read.
    names = table(spark, sf, "events").selectExpr(
        f"'f' || CAST(user_id % 5 AS STRING) || '_' || CAST(event_id % 8 AS STRING) || CASE event_id % 8 {_SUFFIX_CASES} END AS name"
    ).distinct()
    root = scratch_dir(spark, "suffixes")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in names.collect():  # forty names at most
        out = fs.create(fs_path(f"{root}/{row.name}"))
        out.write(10)  # Spark does not list empty files
        out.close()
    return extension_filter(list_files(spark, root)).select(F.substring_index("source_file", "/", -1).alias("name"))


# -- parsing ---------------------------------------------------------------------------------------------


@query("parse_access", log_sql(f"""
SELECT line_id, CAST(parse_error AS BIGINT) AS parse_error, raw, {duck_stamp('seen')} AS seen, source_ip, remote_user, method,
  path, protocol, request, status_code, size, referer, user_agent
FROM access"""))
def _(spark, sf):
    return access(spark, sf).select(
        "line_id", flag("parse_error").alias("parse_error"), "raw", stamp("timestamp").alias("seen"), "source_ip",
        "remote_user", "method", "path", "protocol", "request", "status_code", "size", "referer", "user_agent",
    )


_LEVEL_OF_PRI = "list_extract(['CRITICAL','CRITICAL','CRITICAL','ERROR','WARNING','NOTICE','INFO','DEBUG'], CAST({p} % 8 + 1 AS INTEGER))"
_LEVEL_OF_MSG = "CASE WHEN etype = 'error' THEN 'ERROR' WHEN etype = 'view' THEN 'WARNING' WHEN etype = 'click' THEN 'NOTICE' ELSE 'INFO' END"


@query("parse_syslog_3164", log_sql(f"""
SELECT line_id, CAST(bad AS BIGINT) AS parse_error, CASE WHEN NOT bad THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad THEN host END AS hostname, CASE WHEN NOT bad THEN proc END AS process, CASE WHEN NOT bad THEN pid END AS pid,
  CASE WHEN NOT bad THEN pri END AS priority, CASE WHEN NOT bad THEN msg END AS message,
  CASE WHEN NOT bad THEN '3164' END AS version
FROM demo"""))
def _(spark, sf):
    return parse_lines(demo_lines(spark, sf, "raw_syslog3164"), "syslog", 2024).select(
        "line_id", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "hostname", "process", "pid",
        "priority", "message", F.col("syslog_version").alias("version"),
    )


@query("parse_syslog_5424", log_sql(f"""
SELECT line_id, CASE WHEN NOT bad THEN {duck_stamp('seen')} END AS seen, CASE WHEN NOT bad THEN host END AS hostname,
  CASE WHEN NOT bad THEN pid END AS pid, CASE WHEN NOT bad THEN COALESCE(pri, 14) END AS priority,
  CASE WHEN NOT bad AND line_id % 2 <> 0 THEN 'ID' || CAST(line_id % 9 AS VARCHAR) END AS msgid,
  CASE WHEN NOT bad AND line_id % 3 <> 0 THEN '[a@1 u="' || CAST(uid AS VARCHAR) || '"]' END AS structured_data,
  CASE WHEN NOT bad THEN msg END AS message, CASE WHEN NOT bad THEN '5424' END AS version
FROM demo"""))
def _(spark, sf):
    return parse_lines(demo_lines(spark, sf, "raw_syslog5424"), "syslog", 2024).select(
        "line_id", stamp("timestamp").alias("seen"), "hostname", "pid", "priority", "msgid", "structured_data", "message",
        F.col("syslog_version").alias("version"),
    )


@query("syslog_level", log_sql(f"""
SELECT CASE WHEN pri IS NULL THEN {_LEVEL_OF_MSG} ELSE {_LEVEL_OF_PRI.format(p='pri')} END AS level,
  CAST(pri IS NULL AS BIGINT) AS by_words, COUNT(*) AS lines
FROM demo WHERE NOT bad GROUP BY 1, 2"""))
def _(spark, sf):
    records = parse_lines(demo_lines(spark, sf, "raw_syslog3164"), "syslog", 2024)
    return records.where("NOT parse_error").groupBy(
        "level", flag(F.col("priority").isNull()).alias("by_words")).agg(F.count(F.lit(1)).alias("lines"))


@query("parse_app_log", log_sql(f"""
SELECT line_id, CAST(bad AS BIGINT) AS parse_error, CASE WHEN NOT bad THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad THEN CASE lvl WHEN 'WARN' THEN 'WARNING' ELSE lvl END END AS level,
  CASE WHEN NOT bad THEN 'app.' || etype END AS logger, CASE WHEN NOT bad THEN msg END AS message
FROM demo"""))
def _(spark, sf):
    return parse_lines(demo_lines(spark, sf, "raw_django"), "django").select(
        "line_id", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "level", "logger", "message"
    )


@query("parse_json", log_sql(f"""
SELECT line_id, CAST(parse_error AS BIGINT) AS parse_error, {duck_stamp('seen')} AS seen, level, message, source_ip, method,
  path, status_code, size, user_agent, CAST(latency_ms AS VARCHAR) AS latency_ms,
  CASE WHEN NOT parse_error THEN '{{"k": ' || CAST(line_id % 100 AS VARCHAR) || '}}' END AS ctx
FROM jsonlog"""))
def _(spark, sf):
    # Nested objects keep their JSON; spacing is laid out as in the source for the comparison.
    return json_records(spark, sf).select(
        "line_id", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "level", "message", "source_ip",
        "method", "path", "status_code", "size", "user_agent", F.col("attrs")["latency_ms"].alias("latency_ms"),
        F.replace(F.col("attrs")["ctx"], F.lit('":'), F.lit('": ')).alias("ctx"),
    )


@query("parse_json_columns", """
SELECT event_id AS line_id, 0 AS parse_error, json_extract_string(props, '$.k') AS k FROM events""")
def _(spark, sf):
    lines = table(spark, sf, "events").select(
        F.col("event_id").alias("line_id"), F.lit("props").alias("source_file"), F.col("props").alias("value"))
    return parse_lines(lines, "json").select(
        "line_id", F.col("parse_error").cast("int").alias("parse_error"), F.col("attrs")["k"].alias("k"))


@query("json_level", log_sql("""
SELECT line_id, CASE line_id % 5
  WHEN 0 THEN CASE lvl WHEN 'WARN' THEN 'WARNING' ELSE lvl END
  WHEN 1 THEN CASE lvl WHEN 'WARN' THEN 'WARNING' ELSE lvl END
  WHEN 2 THEN 'NONE'
  WHEN 3 THEN CASE WHEN lvl IN ('INFO', 'ERROR', 'DEBUG') THEN lvl WHEN lvl = 'WARN' THEN 'WARNING' END
  ELSE NULL END AS level
FROM demo"""))
def _(spark, sf):
    e = demo_events(spark, sf).selectExpr(
        "line_id", "'levels' AS source_file",
        """CASE line_id % 5
             WHEN 0 THEN '{"lvl": "' || lower(lvl) || '", "severity": "x"}'
             WHEN 1 THEN '{"severity": "' || lvl || '", "note": "INFO"}'
             WHEN 2 THEN '{"level": null, "note": "INFO"}'
             WHEN 3 THEN '{"note": "hello", "kind": "' || lower(lvl) || '"}'
             ELSE '{"note": 5, "kind": ["INFO"]}' END AS value""",
    )
    return parse_lines(e, "json").select("line_id", "level")


_WIN_LEVEL = "CASE etype WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' WHEN 'click' THEN 'AUDIT_FAILURE' ELSE 'INFO' END"


@query("parse_windows_csv_row", log_sql(f"""
SELECT line_id, CAST(bad AS BIGINT) AS parse_error, CASE WHEN NOT bad THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad THEN {_WIN_LEVEL} END AS level, CASE WHEN NOT bad THEN host END AS source,
  CASE WHEN NOT bad THEN line_id % 5000 END AS event_id, CASE WHEN NOT bad THEN etype END AS category,
  CASE WHEN NOT bad THEN 'The "' || msg || '", as told' END AS message
FROM demo"""))
def _(spark, sf):
    return parse_lines(demo_lines(spark, sf, "raw_win_csv"), "windows").select(
        "line_id", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "level", "source", "event_id",
        "category", "message",
    )


@query("parse_windows_xml", log_sql(f"""
SELECT line_id, CAST(bad AS BIGINT) AS parse_error, CASE WHEN NOT bad THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad THEN CASE line_id % 6 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'WARNING' ELSE 'INFO' END END AS level,
  CASE WHEN NOT bad THEN host END AS source, CASE WHEN NOT bad THEN line_id % 5000 END AS event_id,
  CASE WHEN NOT bad THEN CAST(uid % 50 AS VARCHAR) END AS category,
  CASE WHEN NOT bad THEN 'User=u' || CAST(uid AS VARCHAR) || '; ' || msg END AS message
FROM demo"""))
def _(spark, sf):
    return parse_lines(demo_lines(spark, sf, "raw_win_xml"), "windows").select(
        "line_id", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "level", "source", "event_id",
        "category", "message",
    )


def _custom():
    return regex_format(
        "statuslog", r"^(?P<time>\S+) (?P<level>\w+) status=(?P<status>\d+) (?P<message>.+)$", "time", "%Y-%m-%dT%H:%M:%S"
    )


_CUSTOM_SQL = log_sql(f"""
SELECT line_id, CAST(bad AS BIGINT) AS parse_error, CASE WHEN NOT bad THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad THEN lvl END AS level, CASE WHEN NOT bad THEN CAST(status AS VARCHAR) END AS status,
  CASE WHEN NOT bad THEN msg END AS message
FROM demo""")


def _custom_columns(records):
    return records.select(
        "line_id", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "level",
        F.col("attrs")["status"].alias("status"), "message",
    )


@query("parse_custom", _CUSTOM_SQL)
def _(spark, sf):
    return _custom_columns(parse_lines(demo_lines(spark, sf, "raw_custom"), _custom()))


@query("pandas_format", _CUSTOM_SQL)
def _(spark, sf):
    def read(line):
        parts = line.split(" ", 3)
        if len(parts) < 4 or not parts[2].startswith("status="):
            return None
        return {"timestamp": parts[0], "level": parts[1], "status": parts[2][7:], "message": parts[3]}

    return _custom_columns(parse_lines(demo_lines(spark, sf, "raw_custom"), python_format("statuspy", read)))


# -- many files, several formats ---------------------------------------------------------------------------

# Twenty files: the number of a file decides its format, and a few files hold nothing readable.
_FILE = "line_id % 20"
_KIND = (
    "CASE WHEN {f} < 5 THEN 'nginx' WHEN {f} < 8 THEN 'json' WHEN {f} < 11 THEN 'syslog' WHEN {f} < 14 THEN 'django' "
    "WHEN {f} < 16 THEN 'windows' ELSE 'unknown' END"
)
_SUFFIX_OF = "CASE WHEN {f} = 0 THEN '.dat' WHEN {f} BETWEEN 5 AND 7 THEN '.json' WHEN {f} BETWEEN 14 AND 15 THEN '.csv' ELSE '.log' END"
_MIXED = (
    "CASE WHEN {f} < 5 THEN raw_access WHEN {f} < 8 THEN raw_json WHEN {f} < 11 THEN raw_syslog3164 WHEN {f} < 14 THEN raw_django "
    "WHEN {f} < 16 THEN raw_win_csv ELSE broken END"
)
_MIXED_CTE = f"""
mixed AS (
  SELECT *, 'file' || CAST({_FILE} AS STRING) || {_SUFFIX_OF.format(f=_FILE)} AS source_file, {_KIND.format(f=_FILE)} AS kind,
    {_MIXED.format(f=_FILE)} AS line
  FROM demo
),
head AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_id) AS line_no FROM mixed) WHERE line_no <= 50
)"""


def mixed_lines(spark, sf):
    return written_once(spark, sf, "mixed", lambda: demo_events(spark, sf).selectExpr(
        "line_id", f"'file' || CAST({_FILE} AS STRING) || {_SUFFIX_OF.format(f=_FILE)} AS source_file",
        f"{_MIXED.format(f=_FILE)} AS value",
    ))


@query("sample_head", log_sql("SELECT source_file, CAST(line_no AS BIGINT) AS line_no, line AS value FROM head", _MIXED_CTE))
def _(spark, sf):
    return sample_head(mixed_lines(spark, sf))


@query("read_heads", log_sql("""
SELECT 'p' || CAST(uid % 12 AS VARCHAR) AS part, COUNT(*) FILTER (WHERE NOT bad) > 0 AS some_good,
  LEAST(COUNT(*), 50) AS lines FROM demo GROUP BY 1"""))
def _(spark, sf):
    e = demo_events(spark, sf).selectExpr("'p' || CAST(uid % 12 AS STRING) AS part", "raw_access AS value")
    path = scratch_dir(spark, "heads")
    e.repartition("part").write.partitionBy("part").text(path)
    heads = read_heads(list_files(spark, path))
    return heads.groupBy(F.regexp_extract("source_file", "part=([^/]+)", 1).alias("part")).agg(
        (F.count_if(~F.startswith("value", F.lit("corrupted"))) > 0).alias("some_good"), F.count(F.lit(1)).alias("lines"))


# What each format makes of a sampled line of each kind.
_QUALITY_CTE = """
formats(format, priority) AS (
  VALUES ('json', 90), ('nginx', 80), ('apache', 75), ('django', 65), ('syslog', 60), ('windows', 55)
),
quality AS (
  SELECT h.source_file, f.format, f.priority, COUNT(*) AS lines,
    COUNT(*) FILTER (WHERE NOT bad AND (kind = f.format OR (kind = 'nginx' AND f.format = 'apache'))) AS matched
  FROM head h CROSS JOIN formats f GROUP BY ALL
),
access_parts AS (
  SELECT source_file,
    AVG((6 + CAST(NOT spaced AS INT) * 3 - CAST(bytes IS NULL AS INT) - CAST(ruser = '-' AS INT)
      + CAST(NOT short AND ref <> '-' AS INT) + CAST(NOT short AND agent <> '-' AS INT)
      - 1) / 10.0::DOUBLE) AS extraction
  FROM head WHERE kind = 'nginx' AND NOT bad GROUP BY 1
),
scored AS (
  SELECT q.source_file, q.format, q.priority, matched, lines, a.extraction,
    CASE q.format WHEN 'json' THEN 0.95::DOUBLE * matched / lines WHEN 'syslog' THEN 0.90::DOUBLE * matched / lines
      WHEN 'django' THEN 0.85::DOUBLE * matched / lines
      WHEN 'windows' THEN CASE WHEN matched > 0 THEN
        CASE WHEN first_bad THEN LEAST(1.0, 0.30::DOUBLE * matched / lines + 0.25::DOUBLE * matched / lines + 0.25 + 0.15 + 0.05)
        ELSE 0.90::DOUBLE END ELSE 0.0 END
      ELSE CASE WHEN matched > 0 THEN LEAST(1.0, 0.30::DOUBLE * matched / lines + 0.25::DOUBLE * matched / lines
        + 0.25::DOUBLE * a.extraction + 0.15 + 0.05) ELSE 0.0 END END AS base_score
  FROM quality q LEFT JOIN access_parts a USING (source_file)
    JOIN (SELECT source_file, bool_or(bad AND line_no = 1) AS first_bad FROM head GROUP BY 1) USING (source_file)
),
boosted AS (
  SELECT *, CASE WHEN base_score > 0 AND (
      (source_file LIKE '%.log' AND format IN ('nginx', 'apache', 'django', 'syslog'))
      OR (source_file LIKE '%.json' AND format = 'json') OR (source_file LIKE '%.csv' AND format = 'windows'))
    THEN LEAST(1.0::DOUBLE, base_score + 0.05::DOUBLE) ELSE base_score END AS confidence
  FROM scored
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY confidence DESC, priority DESC, format) AS rank,
    max(confidence) OVER (PARTITION BY source_file) AS top
  FROM boosted WHERE confidence > 0
),
winner AS (
  SELECT s.source_file, CASE WHEN MAX(top) >= 0.6 THEN MAX(CASE WHEN rank = 1 THEN format END) ELSE 'unknown' END AS format,
    CASE WHEN MAX(top) >= 0.6 THEN MAX(top) ELSE 0.0 END AS confidence,
    CASE WHEN MAX(top) >= 0.6 THEN COUNT(*) FILTER (WHERE rank > 1 AND top - confidence <= 0.02) ELSE 0 END AS close_ones,
    CASE WHEN MAX(top) >= 0.6 THEN COALESCE(string_agg(format, '|' ORDER BY rank) FILTER (WHERE rank > 1 AND top - confidence <= 0.02), '') ELSE '' END AS alternatives
  FROM (SELECT DISTINCT source_file FROM head) s LEFT JOIN ranked USING (source_file) GROUP BY 1
)"""


def _quality(spark, sf):
    return format_quality(sample_head(mixed_lines(spark, sf)), 2024)


@query("format_match_rates", log_sql(
    "SELECT source_file, format, lines, matched, ROUND(matched / lines, 6) AS match_rate FROM quality", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    return format_match_rates(_quality(spark, sf)).withColumn("match_rate", r6("match_rate"))


@query("format_scores", log_sql(
    "SELECT source_file, format, ROUND(base_score, 6) AS score FROM scored", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    return format_scores(_quality(spark, sf)).select("source_file", "format", r6("base_score").alias("score"))


@query("extension_boost", log_sql(
    "SELECT source_file, format, ROUND(confidence - base_score, 6) AS bonus, ROUND(confidence, 6) AS confidence FROM boosted",
    _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    return format_scores(_quality(spark, sf)).select(
        "source_file", "format", r6(F.col("confidence") - F.col("base_score")).alias("bonus"), r6("confidence").alias("confidence"))


@query("confidence_breakdown", log_sql("""
SELECT source_file, ROUND(0.30::DOUBLE * matched / lines, 4) AS match_score, ROUND(0.25::DOUBLE * matched / lines, 4) AS parse_quality,
  ROUND(0.25::DOUBLE * extraction, 4) AS extraction, 0.15::DOUBLE AS timestamp_quality, 0.05::DOUBLE AS numeric_valid
FROM scored WHERE format = 'nginx' AND matched > 0""", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    parts = ["match_score", "parse_quality", "extraction", "timestamp_quality", "numeric_valid"]
    return format_scores(_quality(spark, sf)).where("format = 'nginx' AND match_score > 0").select("source_file", *parts)


@query("rank_formats", log_sql(
    "SELECT source_file, format, CAST(rank AS BIGINT) AS rank FROM ranked", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    return rank_formats(format_scores(_quality(spark, sf))).select("source_file", "format", F.col("rank").cast("bigint").alias("rank"))


@query("detect_format", log_sql(
    "SELECT source_file, format, ROUND(confidence, 6) AS confidence FROM winner", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    return detect_formats(format_scores(_quality(spark, sf))).select("source_file", "format", r6("confidence").alias("confidence"))


@query("detect_from_heads", log_sql("SELECT DISTINCT source_file, kind AS format FROM mixed", _MIXED_CTE))
def _(spark, sf):
    # Only the first lines of each file are read.
    path = scratch_dir(spark, "in-heads")
    mixed_lines(spark, sf).select("source_file", "value").repartition("source_file").write.partitionBy("source_file").text(path)
    found = detect(read_heads(list_files(spark, path)), year=2024)
    return found.select(F.regexp_extract("source_file", "source_file=([^/]+)", 1).alias("source_file"), "format")


@query("format_ambiguity", log_sql(
    "SELECT source_file, CAST(close_ones > 0 AS BIGINT) AS ambiguous, alternatives FROM winner", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    return detect_formats(format_scores(_quality(spark, sf))).select(
        "source_file", flag("ambiguous").alias("ambiguous"), joined("alternatives").alias("alternatives"))


@query("list_formats", log_sql("""
SELECT f.format AS name, f.priority, COUNT(w.source_file) AS files
FROM formats f LEFT JOIN winner w ON w.format = f.format GROUP BY 1, 2""", _MIXED_CTE, _QUALITY_CTE))
def _(spark, sf):
    # The catalogue with the number of files each format won.
    won = detect(sample_head(mixed_lines(spark, sf)), year=2024).groupBy(F.col("format").alias("name")).agg(
        F.count(F.lit(1)).alias("files"))
    return list_formats(spark).join(won, "name", "left").select("name", "priority", F.coalesce("files", F.lit(0)).alias("files"))


_AUTO_SQL = log_sql(f"""
SELECT line_id, kind AS format, CAST(bad OR kind = 'unknown' AS BIGINT) AS parse_error,
  CASE WHEN NOT bad AND kind <> 'unknown' THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad THEN CASE kind WHEN 'json' THEN msg WHEN 'syslog' THEN msg WHEN 'django' THEN msg
    WHEN 'windows' THEN 'The "' || msg || '", as told' END END AS message,
  CASE WHEN NOT bad AND kind IN ('nginx', 'json') THEN status END AS status_code,
  CASE WHEN NOT bad AND kind = 'syslog' THEN host END AS hostname
FROM mixed""", _MIXED_CTE)


def auto_records(spark, sf):
    lines = mixed_lines(spark, sf)
    winners = through_table(detect(sample_head(lines), year=2024), "winners")
    return parse_auto(lines, winners, 2024)


@query("parse_auto", _AUTO_SQL)
def _(spark, sf):
    return auto_records(spark, sf).select(
        "line_id", "format", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "message",
        "status_code", "hostname")


# A folder of access logs and of exports whose messages run over lines; the messages hold blank lines, quotes and lines that look
# like records of their own.
_EXPORT_MESSAGE = """CASE line_id % 4 WHEN 0 THEN msg WHEN 1 THEN 'Said "' || msg || '",' || {nl} || {nl} || 'twice.'
  WHEN 2 THEN 'Copy:' || {nl} || 'Error,2024-01-01 00:00:00,' || host || ',7,none,"' || msg ELSE '"' || msg || '"' || {nl} || '"' END"""


_EVENTS_PER_FILE = 500_000
#: Bytes of the least and the largest block, and the blocks of a folder between them.
_LEAST_BLOCK, _LARGEST_BLOCK, _BLOCKS = 20_000, 64 << 20, 1024


def export_block(total: int) -> int:
    """Bytes of a block of a folder of ``total`` bytes."""
    return min(max(_LEAST_BLOCK, total // _BLOCKS), _LARGEST_BLOCK)


@query("parse_auto_exports", log_sql(f"""
SELECT 'windows' AS format, {duck_stamp('seen')} AS seen, {_WIN_LEVEL} AS level, host AS source, line_id AS event_id, etype AS category,
  {_EXPORT_MESSAGE.format(nl='chr(10)')} AS message, NULL AS path, 0 AS parse_error
FROM demo WHERE uid % 3 = 0
UNION ALL
SELECT 'nginx', {duck_stamp('seen')}, NULL, NULL, NULL, NULL, NULL, path, CAST(parse_error AS BIGINT) FROM access
WHERE line_id IN (SELECT line_id FROM demo WHERE uid % 3 <> 0)"""))
def _(spark, sf):
    e = spread_events(spark, sf, _EVENTS_PER_FILE)
    path = scratch_dir(spark, "exports")
    word = "CASE etype WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Warning' WHEN 'click' THEN 'Audit Failure' ELSE 'Information' END"
    e.where("uid % 3 = 0").selectExpr(
        f"{word} AS `Level`", "date_format(seen, 'yyyy-MM-dd HH:mm:ss') AS `Date and Time`", "host AS `Source`",
        "line_id AS `Event ID`", "etype AS `Task Category`", f"{_EXPORT_MESSAGE.format(nl='char(10)')} AS `Description`",
    ).repartition(max(3, demo_events(spark, sf).count() // _EVENTS_PER_FILE), "Event ID").write.csv(f"{path}/windows", header=True, quoteAll=True, escape='"')
    e.where("uid % 3 <> 0").select("raw_access").write.text(f"{path}/web")
    folders = [f"{path}/windows", f"{path}/web"]
    files = list_files(spark, folders)
    heads = read_heads(files)
    winners = through_table(detect(heads, year=2024), "winners")
    # Small blocks, so that a file is read by several tasks and records cross their borders; they grow with the folder, as a block is
    # a task.
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(export_block(files.agg(F.sum("bytes")).first()[0] or 0)))
    try:
        lines = through_table(read_log_lines(spark, folders, blanks=True), "lines")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    records = parse_auto(lines, winners, 2024, exports=export_files(heads, winners))
    return records.select(
        "format", stamp("timestamp").alias("seen"), "level", "source", "event_id", "category", "message", "path",
        flag("parse_error").alias("parse_error"))


@query("parsed_by_format", log_sql("""
SELECT kind AS format, COUNT(*) AS records, COUNT(*) FILTER (WHERE bad OR kind = 'unknown') AS parse_errors
FROM mixed GROUP BY 1""", _MIXED_CTE))
def _(spark, sf):
    from cinderlog.operators.statistics import parsed_by_format

    return parsed_by_format(auto_records(spark, sf))


@query("type_numeric_fields", log_sql("""
SELECT COUNT(status_code) AS with_status, CAST(SUM(status_code) AS BIGINT) AS status_sum, COUNT(size) AS with_size,
  CAST(SUM(size) AS BIGINT) AS size_sum FROM access"""))
def _(spark, sf):
    return access(spark, sf).agg(
        F.count("status_code").alias("with_status"), F.sum("status_code").alias("status_sum"),
        F.count("size").alias("with_size"), F.sum("size").alias("size_sum"))


@query("parse_error_quarantine", log_sql("SELECT line_id, raw FROM access WHERE parse_error"))
def _(spark, sf):
    return split_errors(access(spark, sf))[1].select("line_id", "raw")


@query("register_format", _CUSTOM_SQL)
def _(spark, sf):
    # A registered format takes part in detection and wins its file.
    from cinderlog.operators.formats import register_format, unregister_format

    register_format("my.status-log", r"^(?P<time>\S+) (?P<level>\w+) status=(?P<status>\d+) (?P<message>.+)$", "time", "%Y-%m-%dT%H:%M:%S")
    try:
        lines = demo_lines(spark, sf, "raw_custom")
        winners = through_table(detect(sample_head(lines)), "winners")
        return _custom_columns(parse_auto(lines, winners))
    finally:
        unregister_format("my.status-log")
