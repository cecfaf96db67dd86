"""Streaming jobs run over the derived log until it is used up, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlog.operators.rules import Rule
from cinderlog.session import scratch_dir
from cinderlog.streaming import jobs
from cinderlog.streaming.rules import run_window_rules, window_facts

from .catalog import duck_stamp, flag, log_sql, query, r6, stamp
from .demo_log import demo_lines
from .parsing_queries import _MIXED_CTE, mixed_lines
from .rule_queries import CTES as RULE_CTES, HOURLY, TIMED
from .session_queries import SECURITY_CTE, SESSION_CTE


def _folder(spark, sf, raw="raw_access"):
    path = scratch_dir(spark, f"in-{raw}")
    demo_lines(spark, sf, raw).select("value").write.text(path)
    return path


def _run(spark, df, start):
    """Start a job, wait until its input is used up, give what it wrote."""
    out, checkpoint = scratch_dir(spark, "out"), scratch_dir(spark, "progress")
    job = start(df, out, checkpoint)
    job.awaitTermination()
    return out


def _table(spark, df, schema=None):
    out = _run(spark, df, jobs.run_to_table)
    return spark.read.schema(df.schema if schema is None else schema).parquet(out)


@query("stream_parse", log_sql(f"""
SELECT raw, CAST(parse_error AS BIGINT) AS parse_error, {duck_stamp('seen')} AS seen, source_ip, path, status_code, size FROM access"""))
def _(spark, sf):
    records = jobs.stream_parse(spark, _folder(spark, sf), "nginx", files_per_trigger=3)
    return _table(spark, records).select(
        "raw", flag("parse_error").alias("parse_error"), stamp("timestamp").alias("seen"), "source_ip", "path", "status_code", "size")


@query("stream_json_sink", log_sql("SELECT raw, source_ip, path, status_code FROM access WHERE NOT parse_error"))
def _(spark, sf):
    records = jobs.stream_parse(spark, _folder(spark, sf), "nginx").where("NOT parse_error")
    out = _run(spark, records.select("raw", "source_ip", "path", "status_code"), jobs.run_json_sink)
    return spark.read.schema("raw string, source_ip string, path string, status_code bigint").json(out)


@query("stream_chunks", log_sql("SELECT status_code, COUNT(*) AS records FROM access GROUP BY 1"))
def _(spark, sf):
    records = jobs.stream_parse(spark, _folder(spark, sf), "nginx", files_per_trigger=2)
    out = _run(spark, records, lambda df, out, cp: jobs.run_chunks(df, jobs.write_chunk(out), cp))
    return spark.read.parquet(out).groupBy("status_code").agg(F.count(F.lit(1)).alias("records"))


# Windows that the watermark (newest time minus ten minutes) has passed.
_CLOSED = """
win AS (
  SELECT to_timestamp(epoch(seen)::BIGINT // 300 * 300) AT TIME ZONE 'UTC' AS w, * FROM jsonlog WHERE seen IS NOT NULL
),
closed AS (SELECT * FROM win WHERE w + INTERVAL 5 MINUTES <= (SELECT MAX(seen) FROM jsonlog) - INTERVAL 10 MINUTES)"""


def _json_stream(spark, sf):
    return jobs.stream_parse(spark, _folder(spark, sf, "raw_json"), "json")


@query("stream_window_metrics", log_sql(f"""
SELECT {duck_stamp('w')} AS window_start, COUNT(*) AS total_requests, COUNT(*) FILTER (WHERE level = 'ERROR') AS total_errors,
  COUNT(*) FILTER (WHERE status_code // 100 = 5) AS status_5xx, CAST(COALESCE(SUM(size), 0) AS BIGINT) AS total_bytes,
  list_extract(list_sort(list(CAST(latency_ms AS DOUBLE)) FILTER (WHERE latency_ms IS NOT NULL)), CAST(ceil(0.95::DOUBLE * COUNT(latency_ms)) AS INT)) AS p95_ms
FROM closed GROUP BY 1""", _CLOSED))
def _(spark, sf):
    return _table(spark, jobs.window_metrics(_json_stream(spark, sf))).select(
        stamp("window_start").alias("window_start"), "total_requests", "total_errors", "status_5xx", "total_bytes", "p95_ms")


@query("stream_bursts", log_sql(f"""
SELECT {duck_stamp('w')} AS window_start, ROUND(SUM(n) / 300.0::DOUBLE, 6) AS average_rps, MAX(n)::DOUBLE AS peak_rps,
  CAST(MAX(n) / (SUM(n) / 300.0::DOUBLE) > 3 AND MAX(n) >= 5 AS BIGINT) AS is_bursting
FROM (SELECT w, seen, COUNT(*) AS n FROM closed GROUP BY 1, 2) GROUP BY 1""", _CLOSED))
def _(spark, sf):
    return _table(spark, jobs.window_bursts(_json_stream(spark, sf))).select(
        stamp("window_start").alias("window_start"), r6("average_rps").alias("average_rps"), "peak_rps", flag("is_bursting").alias("is_bursting"))


@query("stream_sessions", log_sql(f"""
SELECT client_ip, {duck_stamp('start_time')} AS start_time, {duck_stamp('end_time')} AS end_time, request_count, failed_logins, login_posts
FROM session WHERE client_ip <> '-' AND session.end_time + INTERVAL 30 MINUTES <= (SELECT MAX(seen) FROM access WHERE source_ip <> '-') - INTERVAL 10 MINUTES""", SESSION_CTE))
def _(spark, sf):
    records = jobs.stream_parse(spark, _folder(spark, sf), "nginx")
    return _table(spark, jobs.closed_sessions(records)).select(
        "client_ip", stamp("start_time").alias("start_time"), stamp("end_time").alias("end_time"), "request_count", "failed_logins", "login_posts")


@query("stream_unnamed_visits", log_sql(f"SELECT client_ip, {duck_stamp('start_time')} AS start_time FROM session WHERE client_ip = '-'", SESSION_CTE))
def _(spark, sf):
    records = jobs.stream_parse(spark, _folder(spark, sf), "nginx")
    return _table(spark, jobs.unnamed_visits(records)).select("client_ip", stamp("start_time").alias("start_time"))


@query("stream_rule_alerts", log_sql(f"""
SELECT {duck_stamp('w')} AS window_start, 'high-error-ratio' AS rule_id, ROUND(COUNT(*) FILTER (WHERE level = 'ERROR') / COUNT(*)::DOUBLE, 4) AS observed_value
FROM closed GROUP BY 1 HAVING observed_value > 0.05
UNION ALL SELECT {duck_stamp('w')}, 'high-5xx-rate', ROUND(COUNT(*) FILTER (WHERE status_code // 100 = 5) / COUNT(*)::DOUBLE, 4) AS o FROM closed GROUP BY 1 HAVING o > 0.02
UNION ALL SELECT {duck_stamp('w')}, 'busy', COUNT(*)::DOUBLE AS o FROM closed GROUP BY 1 HAVING o >= 5""", _CLOSED))
def _(spark, sf):
    rules = [
        Rule("high-error-ratio", "Errors", "reliability", "high", "error.error_ratio", "gt", 0.05, "{value}"),
        Rule("high-5xx-rate", "5xx", "reliability", "critical", "status.http_5xx_rate", "gt", 0.02, "{value}"),
        Rule("busy", "Busy", "traffic", "low", "traffic.total_requests", "gte", 5.0, "{value}"),
    ]
    windows = jobs.window_metrics(_json_stream(spark, sf))
    out = _run(spark, windows, lambda df, out, cp: jobs.run_rule_alerts(df, out, cp, rules))
    return spark.read.parquet(out).select(stamp("window_start").alias("window_start"), "rule_id", "observed_value")


@query("stream_builtin_rules", log_sql(f"""
SELECT {duck_stamp('h')} AS window_start, rule_id, category, severity, confidence, ROUND(value, 4) AS observed_value FROM insight
WHERE {TIMED} AND h + INTERVAL 1 HOUR <= (SELECT MAX(seen) FROM jsonlog) - INTERVAL 10 MINUTES""", *RULE_CTES))
def _(spark, sf):
    # All built-in rules over the closed hours: the same insights as the batch analysis of these hours.
    facts = window_facts(_json_stream(spark, sf), HOURLY)
    out = _run(spark, facts, lambda df, out, cp: run_window_rules(df, out, cp, ctx=HOURLY))
    return spark.read.parquet(f"{out}/insights").select(
        stamp("window_start").alias("window_start"), "rule_id", "category", "severity", "confidence", "observed_value")


@query("stream_parse_auto", log_sql(f"""
SELECT line AS raw, kind AS format, CAST(bad OR kind = 'unknown' AS BIGINT) AS parse_error,
  CASE WHEN NOT bad AND kind <> 'unknown' THEN {duck_stamp('seen')} END AS seen,
  CASE WHEN NOT bad AND kind IN ('nginx', 'json') THEN status END AS status_code,
  CASE WHEN NOT bad AND kind = 'syslog' THEN host END AS hostname
FROM mixed WHERE kind <> 'windows'
UNION ALL SELECT NULL, kind, CAST(bad AS BIGINT), CASE WHEN NOT bad THEN {duck_stamp('seen')} END, NULL, NULL FROM mixed WHERE kind = 'windows'""", _MIXED_CTE))
def _(spark, sf):
    path = scratch_dir(spark, "in-mixed")
    mixed_lines(spark, sf).select("source_file", "value").repartition("source_file").write.partitionBy("source_file").text(path)
    files = jobs.stream_files(spark, path, files_per_trigger=7)
    out = _run(spark, files, lambda df, out, cp: jobs.run_parse_auto(df, out, cp, 2024))
    return spark.read.parquet(f"{out}/records").select(
        F.when(F.col("format") != "windows", F.col("raw")).alias("raw"), "format", flag("parse_error").alias("parse_error"),
        stamp("timestamp").alias("seen"), "status_code", "hostname")


@query("stream_security_hits", log_sql(f"""
SELECT {duck_stamp('seen')} AS seen, source_ip AS client_ip, COALESCE(path, '') AS path, unnest(list_filter([CASE WHEN sqli THEN 'sqli' END,
  CASE WHEN xss THEN 'xss' END, CASE WHEN traversal THEN 'traversal' END, CASE WHEN rce THEN 'rce' END, CASE WHEN probe THEN 'probe' END],
  lambda x: x IS NOT NULL)) AS signal FROM signal""", SECURITY_CTE))
def _(spark, sf):
    records = jobs.stream_parse(spark, _folder(spark, sf), "nginx")
    return _table(spark, jobs.security_hits(records)).select(stamp("time").alias("seen"), "client_ip", "path", "signal")


@query("late_data_policy", log_sql(f"""
SELECT {duck_stamp('w')} AS window_start, COUNT(*) AS total_requests FROM closed GROUP BY 1""", _CLOSED))
def _(spark, sf):
    # The log again a batch later, all of it behind the watermark by then: closed windows must not change.
    path = _folder(spark, sf, "raw_json")
    out, checkpoint = scratch_dir(spark, "late"), scratch_dir(spark, "progress")
    run = lambda: jobs.run_to_table(jobs.window_metrics(jobs.stream_parse(spark, path, "json")), out, checkpoint).awaitTermination()
    run()
    early = demo_lines(spark, sf, "raw_json").where("value LIKE '%\"2024-01-01T0%'")
    early.select("value").write.mode("append").text(path)
    run()
    return spark.read.schema("window_start timestamp, total_requests bigint").parquet(out).select(
        stamp("window_start").alias("window_start"), "total_requests")
