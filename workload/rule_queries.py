"""Metrics, rules, incidents and health per hour of the JSON log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cinderlog.operators import explore, incidents as inc, members as mb, metrics as mt, rules as rl, security as sec
from cinderlog.operators.context import AnalysisContext
from cinderlog.plans.analyze import insights_per_window, measure, window_end, with_window
from cinderlog.session import through_table

from .catalog import duck_stamp, flag, joined, log_sql, query, r6, stamp, stored_json
from .demo_log import written_once
from .session_queries import SECURITY_CTE, SMALL
from .statistics_queries import stage_sql

HOURLY = AnalysisContext(window_minutes=60, failed_logins=SMALL.failed_logins, distinct_paths=4, bot_requests=8, bot_requests_per_minute=1.0)
KEYS = ["window_start"]


def hourly_records(spark, sf):
    return with_window(stored_json(spark, sf), 60)


def hourly_metrics(spark, sf):
    """The long metric table, measured once per session and input folder."""
    return written_once(spark, sf, "hourly", lambda: measure(hourly_records(spark, sf), KEYS, HOURLY))


def hourly_insights(spark, sf):
    return rl.evaluate_rules(hourly_metrics(spark, sf), rl.rules_table(spark), KEYS)


def hourly_incidents(spark, sf, ips=False):
    listed = inc.affected_ips(hourly_records(spark, sf), KEYS) if ips else None
    return inc.correlate_incidents(hourly_insights(spark, sf), hourly_metrics(spark, sf), KEYS, window_end(60), listed)


# -- the same measures in SQL ------------------------------------------------------------------------------------

_LOGIN = "(contains(lower(path), 'login') OR contains(lower(path), 'auth') OR contains(lower(path), 'signin'))"
_STAGES = ("Landing", "Products", "Product", "Cart", "Checkout", "Other")
_TARGETS = ("/wp-admin", "/.env", "/.git", "/api/v1/auth/login", "/config.php", "backup.zip")

_N_IF = "CAST(COUNT(*) FILTER (WHERE {c}) AS DOUBLE)"
_FLAT = {
    "traffic.total_requests": "COUNT(*)::DOUBLE",
    "traffic.volume_bytes": "SUM(CASE WHEN COALESCE(size, 0) <> 0 THEN size ELSE length(raw) END)::DOUBLE",
    "error.total_errors": _N_IF.format(c="level = 'ERROR'"),
    "error.error_ratio": "COUNT(*) FILTER (WHERE level = 'ERROR') / COUNT(*)::DOUBLE",
    **{f"status.status_categories.{d}xx": _N_IF.format(c=f"status_code // 100 = {d}") for d in range(1, 6)},
    "status.http_5xx_rate": "COUNT(*) FILTER (WHERE status_code // 100 = 5) / COUNT(*)::DOUBLE",
    "latency.avg_ms": "AVG(latency_ms)", "latency.min_ms": "MIN(latency_ms)::DOUBLE", "latency.max_ms": "MAX(latency_ms)::DOUBLE",
    **{f"latency.p{p}_ms": f"quantile_cont(CAST(latency_ms AS DOUBLE), {p / 100})" for p in (50, 90, 95, 99)},
    "distribution.request_sizes.count": "0::DOUBLE",
    "distribution.response_sizes.count": "COUNT(size)::DOUBLE", "distribution.response_sizes.average": "AVG(size)",
    "distribution.response_sizes.minimum": "MIN(size)::DOUBLE", "distribution.response_sizes.maximum": "MAX(size)::DOUBLE",
    **{f"distribution.response_sizes.p{p}": f"quantile_cont(CAST(size AS DOUBLE), {p / 100})" for p in (50, 95)},
    "bandwidth.total_bytes_sent": "COALESCE(SUM(size), 0)::DOUBLE", "bandwidth.bytes_per_second": "COALESCE(SUM(size), 0)::DOUBLE / 3600",
    **{f"journey.stage_counts.{s}": _N_IF.format(c=f"stage = '{s}'") for s in _STAGES},
    "security.enumeration.error_404_ratio": "ROUND(COUNT(*) FILTER (WHERE status_code = 404) / COUNT(*)::DOUBLE * 100.0, 2)",
    "security.bot_metrics.missing_user_agent_count": _N_IF.format(c="user_agent = '-'"),
    "security.bot_metrics.headless_fingerprints_count": _N_IF.format(
        c="regexp_matches(user_agent, 'headlesschrome|phantomjs|puppeteer|selenium|playwright', 'i')"),
    "security.scanner_metrics.scanner_hits_count": _N_IF.format(c="probe"),
    "security.injection_metrics.sql_injection_count": _N_IF.format(c="sqli"),
    "security.injection_metrics.xss_injection_count": _N_IF.format(c="xss"),
    "security.injection_metrics.path_traversal_count": _N_IF.format(c="traversal"),
    "security.injection_metrics.rce_cmd_injection_count": _N_IF.format(c="rce"),
    "metadata.analyzed_records": "COUNT(*)::DOUBLE", "metadata.skipped_records": _N_IF.format(c="parse_error"),
    "metadata.missing_latency_fields": _N_IF.format(c="latency_ms IS NULL"),
    "profile.nikto": _N_IF.format(c="contains(user_agent, 'Nikto')"),
    "profile.playwright": _N_IF.format(c="contains(user_agent, 'Playwright') OR contains(user_agent, 'Headless')"),
    "profile.go_http_client": _N_IF.format(c="contains(user_agent, 'Go-http-client')"),
    "profile.curl": _N_IF.format(c="contains(lower(user_agent), 'curl')"),
    **{f"profile.target{i}": _N_IF.format(c=f"path = '{t}'") for i, t in enumerate(_TARGETS)},
}
_SESSION = {
    "session.average_session_duration_seconds": "ROUND(AVG(duration), 2)",
    "session.bounce_rate": "ROUND(COUNT(*) FILTER (WHERE n = 1) / COUNT(*)::DOUBLE * 100.0, 2)",
    "session.pages_per_session": "ROUND(AVG(paths), 2)", "session.requests_per_session": "ROUND(AVG(n), 2)",
    "session.active_sessions_count": "COUNT(*)::DOUBLE", "session.longest_session_duration_seconds": "ROUND(MAX(duration), 2)",
    "session.possible_bot_count": _N_IF.format(c="n > 8 OR (duration > 10 AND n / (duration / 60.0::DOUBLE) > 1.0)"),
    "session.credential_stuffing_count": _N_IF.format(c="failures > 1"),
    "session.endpoint_enumeration_count": _N_IF.format(c="paths > 4"),
    **{f"journey.funnel.{s}": _N_IF.format(c=f"saw_{s}") for s in _STAGES[:5]},
    "security.brute_force.failure_ratio":
        "ROUND(COALESCE(SUM(failures) FILTER (WHERE ip <> '-'), 0)::DOUBLE / NULLIF(SUM(posts) FILTER (WHERE ip <> '-'), 0)::DOUBLE * 100.0, 2)",
    "security.brute_force.lockout_candidates_count": "COUNT(DISTINCT CASE WHEN ip <> '-' AND failures > 1 THEN ip END)::DOUBLE",
    "security.brute_force.failing_ip_count": "COUNT(DISTINCT CASE WHEN ip <> '-' AND failures > 0 THEN ip END)::DOUBLE",
}
_SESSION["security.brute_force.failure_ratio"] = f"COALESCE({_SESSION['security.brute_force.failure_ratio']}, 0.0)"


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())


def _unpivot(cte: str, names) -> str:
    return f'SELECT h, selector, value FROM (UNPIVOT {cte} ON {", ".join(chr(34) + n + chr(34) for n in names)} INTO NAME selector VALUE value)'


METRIC_CTES = (
    SECURITY_CTE.replace("FROM access WHERE NOT parse_error", "FROM jsonlog"),
    # Records without a time are a window of their own, written as the start of 1970 here so that joins meet it.
    f"""
hourly AS (
  SELECT *, COALESCE(date_trunc('hour', seen), TIMESTAMP '1970-01-01') AS h, CASE WHEN seen IS NOT NULL THEN {stage_sql('path')} END AS stage,
    {_LOGIN} AS login_path FROM signal
)""",
    f"flat AS (SELECT h, {_columns(_FLAT)} FROM hourly GROUP BY h)",
    'share AS (SELECT h, MAX(n) / SUM(n)::DOUBLE * 100.0 AS "endpoint.top_endpoint_share" FROM (SELECT h, path, COUNT(*) AS n FROM hourly GROUP BY 1, 2) GROUP BY h)',
    """
burst AS (
  SELECT h, a AS "traffic_burst.average_rps", p AS "traffic_burst.peak_rps", p / a AS "traffic_burst.burst_ratio",
    CAST(p / a > 3 AND p >= 5 AS INT)::DOUBLE AS "traffic_burst.is_bursting"
  FROM (SELECT h, SUM(n)::DOUBLE / 3600.0::DOUBLE AS a, COALESCE(MAX(n) FILTER (WHERE seen IS NOT NULL), 0)::DOUBLE AS p FROM (SELECT h, seen, COUNT(*) AS n FROM hourly GROUP BY 1, 2) GROUP BY 1)
)""",
    f"""
gaps AS (
  SELECT *, CASE WHEN date_diff('second', lag(seen) OVER (PARTITION BY h, source_ip ORDER BY seen, line_id), seen) > 1800 THEN 1 ELSE 0 END AS opens FROM hourly WHERE seen IS NOT NULL
),
joined_up AS (
  SELECT *, CASE WHEN source_ip = '-' THEN 'l' || CAST(line_id AS VARCHAR)
    ELSE CAST(SUM(opens) OVER (PARTITION BY h, source_ip ORDER BY seen, line_id) AS VARCHAR) END AS sid FROM gaps
),
hour_session AS (
  SELECT h, source_ip AS ip, sid, COUNT(*) AS n, date_diff('second', MIN(seen), MAX(seen))::DOUBLE AS duration, COUNT(DISTINCT path) AS paths,
    COUNT(*) FILTER (WHERE status_code IN (401, 403) OR (method = 'POST' AND login_path AND status_code >= 400)) AS failures,
    COUNT(*) FILTER (WHERE method = 'POST' AND login_path) AS posts,
    {", ".join(f"bool_or(stage = '{s}') AS saw_{s}" for s in _STAGES[:5])}
  FROM joined_up GROUP BY 1, 2, 3
)""",
    f"sess AS (SELECT h, {_columns(_SESSION)} FROM hour_session GROUP BY h)",
    f"""
metric AS (
  {_unpivot('flat', _FLAT)} UNION ALL {_unpivot('share', ['endpoint.top_endpoint_share'])}
  UNION ALL {_unpivot('burst', ['traffic_burst.' + n for n in ('average_rps', 'peak_rps', 'burst_ratio', 'is_bursting')])}
  UNION ALL {_unpivot('sess', _SESSION)}
)""",
)

# Written out apart from the library's table on purpose: the two must agree.
_RULES = """
rule(rule_id, name, category, severity, selector, op, threshold, weight) AS (VALUES
  ('high-latency-p99', 'High P99 Latency', 'performance', 'high', 'latency.p99_ms', 'gt', 500.0::DOUBLE, 1.0::DOUBLE),
  ('high-latency-p95', 'High P95 Latency', 'performance', 'medium', 'latency.p95_ms', 'gt', 300.0, 0.8),
  ('high-error-ratio', 'High Error Ratio', 'reliability', 'high', 'error.error_ratio', 'gt', 0.05, 1.0),
  ('high-5xx-rate', 'High HTTP 5xx Rate', 'reliability', 'critical', 'status.http_5xx_rate', 'gt', 0.02, 1.2),
  ('traffic-burst', 'Traffic Burst Detection', 'traffic', 'medium', 'traffic_burst.is_bursting', 'eq', 1.0, 0.9),
  ('bandwidth-spike', 'Bandwidth Spike', 'traffic', 'medium', 'bandwidth.bytes_per_second', 'gt', 10000.0, 0.8),
  ('endpoint-overload', 'Endpoint Overload', 'traffic', 'medium', 'endpoint.top_endpoint_share', 'gt', 50.0, 0.7),
  ('sec-bot-01', 'Suspected Bot Activity', 'security', 'high', 'security.bot_metrics.headless_fingerprints_count', 'gt', 0.0, 1.0),
  ('sec-cs-02', 'Credential Stuffing Attack', 'security', 'critical', 'security.brute_force.lockout_candidates_count', 'gt', 0.0, 1.0),
  ('sec-enum-03', 'Directory Enumeration Scan', 'security', 'high', 'security.enumeration.error_404_ratio', 'gt', 10.0, 1.0),
  ('sec-scan-04', 'Vulnerability Scanning Probe', 'security', 'high', 'security.scanner_metrics.scanner_hits_count', 'gt', 0.0, 1.0),
  ('sec-inj-05', 'SQL Injection Attempt', 'security', 'critical', 'security.injection_metrics.sql_injection_count', 'gt', 0.0, 1.0),
  ('sec-inj-06', 'XSS Injection Attempt', 'security', 'critical', 'security.injection_metrics.xss_injection_count', 'gt', 0.0, 1.0),
  ('sec-inj-07', 'Path Traversal Attempt', 'security', 'critical', 'security.injection_metrics.path_traversal_count', 'gt', 0.0, 1.0)
),
insight AS (
  SELECT m.h, r.*, m.value, LEAST(1.0, ROUND(LEAST(1.0, t.n / 100.0::DOUBLE) * r.weight, 4)) AS confidence
  FROM metric m JOIN rule r USING (selector) JOIN (SELECT h, COUNT(*) AS n FROM hourly GROUP BY 1) t ON t.h = m.h
  WHERE (op = 'gt' AND m.value > threshold) OR (op = 'eq' AND m.value = threshold)
),
groups AS (
  SELECT h, CASE WHEN category = 'security' OR rule_id = 'traffic-burst' THEN 'security' WHEN category IN ('performance', 'reliability') THEN 'performance' END AS kind,
    CASE WHEN bool_or(severity = 'critical') THEN 'CRITICAL' WHEN bool_or(severity = 'high') THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    COUNT(*) AS n, string_agg(rule_id, '' ORDER BY rule_id) AS ids, string_agg(rule_id, '|' ORDER BY rule_id) AS id_list
  FROM insight GROUP BY 1, 2 HAVING kind IS NOT NULL
),
wide AS (
  SELECT h, MAX(value) FILTER (WHERE selector = 'security.bot_metrics.headless_fingerprints_count') AS headless,
    MAX(value) FILTER (WHERE selector = 'security.scanner_metrics.scanner_hits_count') AS probes,
    MAX(value) FILTER (WHERE selector = 'security.enumeration.error_404_ratio') AS missing,
    MAX(value) FILTER (WHERE selector = 'security.brute_force.failing_ip_count') AS failing,
    MAX(value) FILTER (WHERE selector = 'security.brute_force.lockout_candidates_count') AS locked,
    MAX(value) FILTER (WHERE selector = 'security.brute_force.failure_ratio') AS failure_ratio,
    MAX(value) FILTER (WHERE selector = 'profile.nikto') AS nikto,
    MAX(value) FILTER (WHERE selector = 'latency.p99_ms') AS p99, MAX(value) FILTER (WHERE selector = 'latency.p95_ms') AS p95,
    MAX(value) FILTER (WHERE selector = 'latency.avg_ms') AS avg_ms,
    MAX(value) FILTER (WHERE selector = 'error.total_errors') AS errors, MAX(value) FILTER (WHERE selector = 'error.error_ratio') AS error_ratio,
    MAX(value) FILTER (WHERE selector = 'status.http_5xx_rate') AS fives, MAX(value) FILTER (WHERE selector = 'traffic_burst.is_bursting') AS bursting,
    MAX(value) FILTER (WHERE selector = 'security.injection_metrics.sql_injection_count') AS sqli,
    SUM(value) FILTER (WHERE selector LIKE 'security.injection_metrics.%') AS injections
  FROM metric GROUP BY 1
),
evidence AS (
  SELECT g.*, CASE WHEN kind = 'security' THEN
    CAST(headless > 0 AS INT) + CAST(probes > 0 AS INT) + CAST(missing > 0 AS INT) + CAST(failing > 0 AS INT) + CAST(nikto > 0 AS INT)
    ELSE CAST(COALESCE(p99, 0) <> 0 AS INT) + CAST(errors > 0 AS INT) END AS n_evidence, w.* EXCLUDE (h)
  FROM groups g JOIN wide w USING (h)
),
domain AS (
  SELECT w.h,
    GREATEST(0, LEAST(100, 100 - COALESCE(MAX(CASE g.severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 15 END), 0) - 5 * MAX(i.sec))) AS security_score,
    GREATEST(0, LEAST(100, 100 - MAX(CASE WHEN fives > 0.05 THEN 40 WHEN fives > 0.02 THEN 20 ELSE 0 END)
      - MAX(CASE WHEN error_ratio > 0.10 THEN 30 WHEN error_ratio > 0.05 THEN 15 ELSE 0 END) - 10 * MAX(i.rel))) AS reliability_score,
    GREATEST(0, LEAST(100, 100 - MAX(CASE WHEN p99 > 1000 THEN 40 WHEN p99 > 500 THEN 25 ELSE 0 END) - MAX(CASE WHEN p95 > 300 THEN 15 ELSE 0 END)
      - 10 * MAX(i.perf))) AS performance_score,
    GREATEST(0, LEAST(100, 100 - MAX(CASE WHEN bursting = 1 THEN 20 ELSE 0 END) - 10 * MAX(i.traf))) AS traffic_score
  FROM wide w LEFT JOIN groups g ON g.h = w.h AND g.kind = 'security'
    JOIN (SELECT wide.h, COUNT(*) FILTER (WHERE category = 'security') AS sec, COUNT(*) FILTER (WHERE category = 'reliability') AS rel,
      COUNT(*) FILTER (WHERE category = 'performance') AS perf, COUNT(*) FILTER (WHERE category = 'traffic') AS traf
      FROM wide LEFT JOIN insight USING (h) GROUP BY 1) i ON i.h = w.h
  GROUP BY 1
),
health AS (
  SELECT *, CAST(LEAST(floor(security_score * 0.35::DOUBLE + reliability_score * 0.30::DOUBLE + performance_score * 0.20::DOUBLE
    + traffic_score * 0.15::DOUBLE), security_score, reliability_score) AS BIGINT) AS overall_score FROM domain
)"""
CTES = (*METRIC_CTES, _RULES)
TIMED = "h > TIMESTAMP '1970-01-01'"
_H = f"CASE WHEN {TIMED} THEN {duck_stamp('h')} END AS window_start"


@query("metrics_long", log_sql(f"SELECT {_H}, selector, ROUND(value, 6) AS value FROM metric WHERE value IS NOT NULL", *METRIC_CTES))
def _(spark, sf):
    return mt.metrics_long(hourly_records(spark, sf), KEYS, HOURLY).select(
        stamp("window_start").alias("window_start"), "selector", r6("value").alias("value"))


@query("metrics_overall", log_sql(
    f"SELECT ROUND(SUM(\"traffic.total_requests\"), 6) AS total_requests, ROUND(SUM(\"traffic.volume_bytes\"), 6) AS volume_bytes, "
    "ROUND(SUM(\"error.total_errors\"), 6) AS total_errors FROM flat", *METRIC_CTES))
def _(spark, sf):
    # Without keys: additive measures are the sums of the hourly ones.
    long = mt.metrics_long(hourly_records(spark, sf).drop("window_start"), [], HOURLY)
    return mt.metrics_wide(long).select(
        *[F.col(f"`{c}`").alias(c.split(".")[1]) for c in ("traffic.total_requests", "traffic.volume_bytes", "error.total_errors")])


@query("metrics_bundle", log_sql(f"""
SELECT {_H}, ROUND("latency.p95_ms", 6) AS p95_ms, "status.status_categories.4xx" AS c4xx, ROUND("session.bounce_rate", 6) AS bounce_rate
FROM flat LEFT JOIN sess USING (h)""", *METRIC_CTES))
def _(spark, sf):
    nested = mt.bundle(mt.metrics_wide(hourly_metrics(spark, sf), KEYS), KEYS)
    return nested.select(
        stamp("window_start").alias("window_start"), r6("latency.p95_ms").alias("p95_ms"),
        F.col("status.status_categories.4xx").alias("c4xx"), r6("session.bounce_rate").alias("bounce_rate"))


_SCALARS = [s for s in mt.SELECTORS if not s.startswith("profile.")]


@query("metrics_bundle_all", log_sql(f"""
SELECT {_H}, {', '.join(f'ROUND(MAX(value) FILTER (WHERE selector = {chr(39)}{s}{chr(39)}), 6) AS "{s.replace('.', '__')}"' for s in _SCALARS)}
FROM metric GROUP BY h""", *METRIC_CTES))
def _(spark, sf):
    nested = mt.bundle(mt.metrics_wide(hourly_metrics(spark, sf), KEYS), KEYS)
    return nested.select(stamp("window_start").alias("window_start"), *[r6(s).alias(s.replace(".", "__")) for s in _SCALARS])


@query("bundle_members", log_sql(f"""
SELECT {_H}, member, name, value, ROUND(share, 6) AS share, CAST(rank AS INT) AS rank FROM (
  SELECT h, 'error.errors_by_level' AS member, level AS name, COUNT(*)::DOUBLE AS value, NULL::DOUBLE AS share, NULL AS rank FROM hourly WHERE level IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT h, 'status.status_codes', CAST(status_code AS VARCHAR), COUNT(*), NULL, NULL FROM hourly WHERE status_code IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT h, 'endpoint.top_endpoints', name, n, n * 100.0::DOUBLE / total, by_n FROM listed WHERE by_n <= 5
  UNION ALL SELECT h, 'bandwidth.top_bandwidth_endpoints', name, b, CASE WHEN total_b > 0 THEN b * 100.0::DOUBLE / total_b ELSE 0 END, by_b FROM listed WHERE by_b <= 5
  UNION ALL (SELECT h, 'distribution.top_ips', source_ip, COUNT(*), NULL, row_number() OVER (PARTITION BY h ORDER BY COUNT(*) DESC, source_ip) AS r
    FROM hourly WHERE source_ip <> '-' GROUP BY h, source_ip QUALIFY r <= 3)
  UNION ALL SELECT h, 'distribution.response_sizes.histogram', CAST(size // 500 * 500 AS VARCHAR) || '-' || CAST(size // 500 * 500 + 499 AS VARCHAR), COUNT(*), NULL, NULL
    FROM hourly WHERE size IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT h, 'traffic_burst.burst_windows', {duck_stamp('seen')}, n, n / a, NULL FROM (
    SELECT h, seen, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY h) / 3600.0::DOUBLE AS a FROM hourly GROUP BY 1, 2) WHERE seen IS NOT NULL AND n >= GREATEST(3 * a, 2)
  UNION ALL SELECT h, 'security.scanner_metrics.scanned_ips', source_ip, COUNT(*), NULL, NULL FROM hourly WHERE probe GROUP BY 1, 3
  UNION ALL SELECT h, 'security.brute_force.failed_logins_per_ip', ip, SUM(failures), NULL, NULL FROM hour_session WHERE ip <> '-' GROUP BY 1, 3 HAVING SUM(failures) > 0
  UNION ALL SELECT h, 'security.enumeration.distinct_endpoints_per_ip', source_ip, COUNT(DISTINCT path), NULL, NULL FROM hourly WHERE source_ip <> '-' GROUP BY 1, 3)""",
    *METRIC_CTES, """
listed AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, name) AS by_n, row_number() OVER (PARTITION BY h ORDER BY b DESC, name) AS by_b,
    SUM(n) OVER (PARTITION BY h) AS total, SUM(b) OVER (PARTITION BY h) AS total_b
  FROM (SELECT h, COALESCE(path, 'unknown') AS name, COUNT(*) AS n, SUM(COALESCE(size, 0)) AS b FROM hourly GROUP BY 1, 2)
)"""))
def _(spark, sf):
    ctx = replace(HOURLY, top_ips_limit=3, histogram_bucket_size=500)
    counts = through_table(mb.member_counts(hourly_records(spark, sf), KEYS, ctx), "member-counts")
    return mb.bundle_members(counts, KEYS, ctx).select(
        stamp("window_start").alias("window_start"), "member", "name", "value", r6("share").alias("share"), "rank")


@query("threat_level", log_sql(f"""
SELECT {_H}, CASE WHEN injections > 0 OR locked > 0 THEN 'Critical Security Alert' WHEN probes > 0 OR missing > 15 THEN 'High Scanning Activity'
  WHEN headless > 0 OR failure_ratio > 20 THEN 'Suspicious Bot Behavior' ELSE 'Low Risk Profile' END AS threat FROM wide""", *CTES))
def _(spark, sf):
    wide = mt.metrics_wide(hourly_metrics(spark, sf), KEYS)
    return wide.select(stamp("window_start").alias("window_start"), sec.threat_level(wide).alias("threat"))


_INSIGHT_SQL = log_sql(
    f"SELECT {_H}, rule_id, category, severity, confidence, ROUND(value, 4) AS observed_value, threshold FROM insight", *CTES)


def _insight_columns(df):
    return df.select(stamp("window_start").alias("window_start"), "rule_id", "category", "severity", "confidence", "observed_value", "threshold")


@query("evaluate_rules", _INSIGHT_SQL)
def _(spark, sf):
    return _insight_columns(hourly_insights(spark, sf))


@query("insights_per_window", _INSIGHT_SQL)
def _(spark, sf):
    return _insight_columns(insights_per_window(stored_json(spark, sf), 60, [], HOURLY))


@query("insight_confidence", log_sql(f"SELECT {_H}, rule_id, confidence FROM insight", *CTES))
def _(spark, sf):
    return hourly_insights(spark, sf).select(stamp("window_start").alias("window_start"), "rule_id", "confidence")


_NUM = "CASE WHEN t LIKE '%.00' THEN left(t, length(t) - 1) WHEN t LIKE '%0' THEN left(t, length(t) - 1) ELSE t END"


@query("insight_text", log_sql(f"""
SELECT window_start, rule_id, 'Error ratio ' || {_NUM} || ' exceeds 0.05' AS description
FROM (SELECT {_H}, rule_id, printf('%.2f', ROUND(value, 2)) AS t FROM insight WHERE rule_id = 'high-error-ratio')""", *CTES))
def _(spark, sf):
    return hourly_insights(spark, sf).where("rule_id = 'high-error-ratio'").select(
        stamp("window_start").alias("window_start"), "rule_id", "description")


@query("recommendations", log_sql(f"""
SELECT {_H}, rule_id, CASE category || severity WHEN 'performancemedium' THEN 'Review slow endpoints and consider query optimization.'
  WHEN 'performancehigh' THEN 'Investigate slow endpoints immediately — latency is impacting users.'
  WHEN 'reliabilityhigh' THEN 'Elevated error rate detected — review recent deployments.'
  WHEN 'reliabilitycritical' THEN 'Critical failure rate — initiate incident response.'
  WHEN 'trafficmedium' THEN 'Traffic spike detected — verify auto-scaling is active.'
  WHEN 'securityhigh' THEN 'Block the offending source and alert the security team.'
  WHEN 'securitycritical' THEN 'Active attack detected — engage incident response immediately.' END AS recommendation FROM insight""", *CTES))
def _(spark, sf):
    return hourly_insights(spark, sf).select(stamp("window_start").alias("window_start"), "rule_id", "recommendation")


def _rules_with_hits(spark, sf):
    hits = hourly_insights(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("triggered"))
    return rl.rules_table(spark).withColumn("description", F.col("template")).join(hits, "rule_id", "left").withColumn(
        "triggered", F.coalesce("triggered", F.lit(0)))


@query("builtin_rules", log_sql("""
SELECT r.rule_id, r.category, r.severity, r.selector, r.op AS operator, r.threshold, r.weight, COUNT(i.h) AS triggered
FROM rule r LEFT JOIN insight i ON i.rule_id = r.rule_id GROUP BY ALL""", *CTES))
def _(spark, sf):
    return _rules_with_hits(spark, sf).select("rule_id", "category", "severity", "selector", "operator", "threshold", "weight", "triggered")


@query("filter_rules", log_sql("""
SELECT r.rule_id, COUNT(i.h) AS triggered FROM rule r LEFT JOIN insight i ON i.rule_id = r.rule_id
WHERE r.category = 'security' AND (contains(lower(r.name), 'inj') OR contains(r.rule_id, 'inj')) GROUP BY 1""", *CTES))
def _(spark, sf):
    return explore.filter_rules(_rules_with_hits(spark, sf), "INJ", "security").select("rule_id", "triggered")


@query("custom_rules", log_sql(f"""
SELECT {_H}, rule_id, ROUND(value, 4) AS observed_value FROM (
  SELECT h, 'few-requests' AS rule_id, value FROM metric WHERE selector = 'traffic.total_requests' AND value < 30
  UNION ALL SELECT h, 'long-bounce', value FROM metric WHERE selector = 'session.bounce_rate' AND value >= 40
  UNION ALL SELECT h, 'fast', value FROM metric WHERE selector = 'latency.p50_ms' AND value <= 500)""", *METRIC_CTES))
def _(spark, sf):
    rules = [
        rl.Rule("few-requests", "Few", "traffic", "low", "traffic.total_requests", "lt", 30.0, "{value} requests"),
        rl.Rule("long-bounce", "Bounce", "traffic", "low", "session.bounce_rate", "gte", 40.0, "{value}% bounce"),
        rl.Rule("fast", "Fast", "performance", "low", "latency.p50_ms", "lte", 500.0, "{value}ms"),
        rl.Rule("off", "Off", "traffic", "low", "traffic.total_requests", "gte", 0.0, "{value}", enabled=False),
    ]
    return rl.evaluate_rules(hourly_metrics(spark, sf), rl.rules_table(spark, rules), KEYS).select(
        stamp("window_start").alias("window_start"), "rule_id", "observed_value")


@query("register_metric", log_sql(f"""
SELECT {_H}, 'admin.requests' AS selector, CAST(COUNT(*) FILTER (WHERE contains(path, 'admin')) AS DOUBLE) AS value FROM hourly GROUP BY h""", *METRIC_CTES))
def _(spark, sf):
    from cinderlog.plans.plugins import extra_metrics, register_metric, unregister_metric

    register_metric(
        "admin", lambda records, keys, ctx: records.groupBy(*keys).agg(F.count_if(F.contains("path", F.lit("admin"))).alias("admin.requests")),
        produces=("admin.requests",), dependencies=("traffic",))
    try:
        return extra_metrics(hourly_records(spark, sf), KEYS, HOURLY)[0].withColumn("window_start", stamp("window_start"))
    finally:
        unregister_metric("admin")


@query("register_metric_on_sessions", log_sql(f"""
SELECT {_H}, 'visits.longest' AS selector, MAX(n)::DOUBLE AS value FROM hour_session GROUP BY h
UNION ALL SELECT {_H}, 'visits.many', CAST(MAX(n) >= 3 AS INT)::DOUBLE FROM hour_session GROUP BY h""", *METRIC_CTES))
def _(spark, sf):
    # A metric reads the session table, another one what the first made of it; requests are put into sessions once.
    from cinderlog.plans.plugins import register_metric, unregister_metric

    register_metric(
        "longest", lambda records, keys, ctx, tables: tables["session"].groupBy(*keys).agg(F.max("request_count").alias("visits.longest")),
        produces=("visits.longest",), dependencies=("session",))
    register_metric(
        "many", lambda records, keys, ctx, tables: tables["longest"].select(*keys, (F.col("`visits.longest`") >= 3).alias("visits.many")),
        produces=("visits.many",), dependencies=("longest",))
    try:
        long = measure(hourly_records(spark, sf), KEYS, HOURLY)
        return long.where("selector LIKE 'visits.%'").withColumn("window_start", stamp("window_start"))
    finally:
        unregister_metric("many")
        unregister_metric("longest")


@query("insight_rollup", log_sql("SELECT rule_id, severity, category, COUNT(*) AS triggered FROM insight GROUP BY 1, 2, 3", *CTES))
def _(spark, sf):
    return rl.insight_rollup(hourly_insights(spark, sf))


# -- incidents ----------------------------------------------------------------------------------------------------


@query("correlate_incidents", log_sql(f"SELECT {_H}, kind AS incident_class, severity, n AS insight_count, id_list AS rule_ids FROM groups", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf).select(
        stamp("window_start").alias("window_start"), "incident_class", "severity", "insight_count", joined("rule_ids").alias("rule_ids"))


@query("incident_severity", log_sql(f"SELECT {_H}, kind AS incident_class, severity FROM groups", *CTES))
def _(spark, sf):
    return inc.incident_groups(hourly_insights(spark, sf), KEYS).select(stamp("window_start").alias("window_start"), "incident_class", "severity")


@query("incident_confidence", log_sql(f"""
SELECT {_H}, kind AS incident_class, CASE WHEN kind = 'security' THEN LEAST(0.99::DOUBLE, ROUND(0.70::DOUBLE + LEAST(GREATEST(n_evidence, 1), 5) * 0.05::DOUBLE, 2))
  ELSE 0.90::DOUBLE END AS confidence FROM evidence""", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf).select(stamp("window_start").alias("window_start"), "incident_class", "confidence")


@query("incident_evidence", log_sql(f"""
SELECT {_H}, kind AS incident_class, concat_ws('|',
  CASE WHEN kind = 'security' AND headless > 0 THEN '[+] Headless browser fingerprint footprint detected' END,
  CASE WHEN kind = 'security' AND probes > 0 THEN '[+] Sensitive probe paths (.env, wp-admin, config) accessed' END,
  CASE WHEN kind = 'security' AND missing > 0 THEN '[+] Abnormally high 404 response ratio (' || printf('%.1f', ROUND(missing, 1)) || '%)' END,
  CASE WHEN kind = 'security' AND failing > 0 THEN '[+] Multiple failed authentication attempts (' || CAST(failing AS BIGINT) || ' source IPs)' END,
  CASE WHEN kind = 'security' AND nikto > 0 THEN '[+] Known security scanner User-Agent (Nikto)' END,
  CASE WHEN kind = 'performance' AND p99 <> 0 THEN '[+] High P99 Latency (' || printf('%.1f', ROUND(p99, 1)) || 'ms)' END,
  CASE WHEN kind = 'performance' AND errors > 0 THEN '[+] Elevated error rate (' || printf('%.1f', ROUND(error_ratio * 100.0, 1)) || '%)' END,
  CASE WHEN n_evidence = 0 AND kind = 'security' THEN '[+] ' || n || ' correlated security rule alerts co-occurring' END,
  CASE WHEN n_evidence = 0 AND kind = 'performance' THEN '[+] ' || n || ' performance/reliability SLA threshold breaches' END) AS evidence FROM evidence""", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf).select(stamp("window_start").alias("window_start"), "incident_class", joined("evidence").alias("evidence"))


@query("incident_title", log_sql(f"""
SELECT {_H}, kind AS incident_class, CASE WHEN kind = 'performance' THEN 'System Performance & Reliability Degradation'
  WHEN failing > 0 THEN 'Credential Stuffing & Authentication Attack Campaign' WHEN probes > 0 THEN 'Automated Reconnaissance & Probe Campaign'
  WHEN headless > 0 THEN 'Automated Bot Threat Campaign' ELSE 'Security Anomaly & Threat Incident' END AS title FROM evidence""", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf).select(stamp("window_start").alias("window_start"), "incident_class", "title")


@query("threat_profile", log_sql(f"""
SELECT {_H}, concat_ws('|', CASE WHEN probes > 0 THEN 'Admin & Sensitive File Discovery' END, CASE WHEN headless > 0 THEN 'Automated Browser Emulation' END,
    CASE WHEN failing > 0 THEN 'Credential Stuffing / Brute Force' END, CASE WHEN missing > 0 THEN 'Endpoint Directory Enumeration' END,
    CASE WHEN probes = 0 AND headless = 0 AND failing = 0 AND missing = 0 THEN 'Web Probing' END) AS capabilities,
  COALESCE(tools, 'Automated Script / Bot') AS tools, COALESCE(targets, 'General Web Endpoints') AS targets
FROM evidence LEFT JOIN (
  SELECT h, string_agg(DISTINCT tool, '|' ORDER BY tool) AS tools FROM (
    SELECT h, CASE WHEN contains(user_agent, 'Nikto') THEN 'Nikto' WHEN contains(user_agent, 'Playwright') OR contains(user_agent, 'Headless') THEN 'Playwright (headless)'
      WHEN contains(user_agent, 'Go-http') THEN 'Go-http-client' WHEN contains(user_agent, 'curl') THEN 'curl' END AS tool FROM hourly) GROUP BY 1) USING (h)
LEFT JOIN (SELECT h, string_agg(DISTINCT path, '|' ORDER BY path) AS targets FROM hourly WHERE path IN ('/wp-admin', '/.env', '/config.php') GROUP BY 1) USING (h)
WHERE kind = 'security'""", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf).where("incident_class = 'security'").select(
        stamp("window_start").alias("window_start"), joined("capabilities").alias("capabilities"), joined("suspected_tools").alias("tools"),
        joined("observed_targets").alias("targets"))


@query("affected_ips", log_sql(f"SELECT DISTINCT {_H}, source_ip AS ip FROM hourly WHERE source_ip IS NOT NULL", *METRIC_CTES))
def _(spark, sf):
    return inc.affected_ips(hourly_records(spark, sf), KEYS).select(stamp("window_start").alias("window_start"), "ip")


@query("incident_advice", log_sql(f"""
SELECT {_H}, 'Block offending IP address(es): ' || string_agg(ip, ', ' ORDER BY ip) AS advice FROM (
  SELECT h, ip FROM (SELECT DISTINCT h, source_ip AS ip FROM hourly WHERE source_ip IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY h ORDER BY ip) <= 3)
WHERE h IN (SELECT h FROM groups WHERE kind = 'security') GROUP BY h""", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf, ips=True).where("incident_class = 'security'").select(
        stamp("window_start").alias("window_start"), F.get("recommendations", F.lit(0)).alias("advice"))


@query("incident_id", log_sql(f"""
SELECT {_H}, kind AS incident_class, CASE WHEN kind = 'security' THEN 'INC-' ELSE 'INC-PERF-' END || strftime(h + INTERVAL 1 HOUR, '%Y%m%d-%H%M%S') || '-'
  || upper(left(md5(ids), 4)) AS incident_id FROM groups""", *CTES))
def _(spark, sf):
    return hourly_incidents(spark, sf).select(stamp("window_start").alias("window_start"), "incident_class", "incident_id")


@query("incident_timeline", log_sql(f"""
SELECT {_H}, rule_id, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, split_part(rule_id, '-', 1) AS event_type, upper(severity) AS severity
FROM insight WHERE category <> 'traffic' OR rule_id = 'traffic-burst'""", *CTES))
def _(spark, sf):
    return inc.incident_timeline(hourly_insights(spark, sf), KEYS, window_end(60)).select(
        stamp("window_start").alias("window_start"), "rule_id", "timestamp", "event_type", "severity")


@query("incident_rollup", log_sql("SELECT severity, kind AS category, COUNT(*) AS incidents FROM groups GROUP BY 1, 2", *CTES))
def _(spark, sf):
    return inc.incident_rollup(hourly_incidents(spark, sf))


# -- health -------------------------------------------------------------------------------------------------------

_STATUS = "CASE WHEN {c} >= 85 THEN 'HEALTHY' WHEN {c} >= 60 THEN 'WARNING' ELSE 'CRITICAL' END"
_DOMAINS = ("security", "reliability", "performance", "traffic")


@query("health_scores", log_sql(
    f"SELECT {_H}, " + ", ".join(
        f"CAST({d}_score AS BIGINT) AS {d}_score, {_STATUS.format(c=d + '_score')} AS {d}_status" for d in _DOMAINS) + " FROM health", *CTES))
def _(spark, sf):
    df = inc.health_scores(hourly_metrics(spark, sf), hourly_insights(spark, sf), KEYS)
    return df.select(stamp("window_start").alias("window_start"), *[c for d in _DOMAINS for c in (f"{d}_score", f"{d}_status")])


_OVERALL_SQL = log_sql(f"SELECT {_H}, overall_score, {_STATUS.format(c='overall_score')} AS status FROM health", *CTES)


@query("health_overall", _OVERALL_SQL)
def _(spark, sf):
    df = inc.health_scores(hourly_metrics(spark, sf), hourly_insights(spark, sf), KEYS)
    return df.select(stamp("window_start").alias("window_start"), "overall_score", "status")


@query("health_per_hour", _OVERALL_SQL)
def _(spark, sf):
    # End to end, nothing reused: parse, measure, evaluate, score.
    from cinderlog.plans.analyze import analyze
    from cinderlog.session import through_table

    from .catalog import json_records

    records = with_window(through_table(json_records(spark, sf), "flagship"), 60)
    return analyze(records, KEYS, HOURLY, at=window_end(60)).health.select(
        stamp("window_start").alias("window_start"), "overall_score", "status")


@query("diagnosis", log_sql(f"""
SELECT {_H}, CASE WHEN sqli > 0 THEN 'sqli' WHEN failing > 0 THEN 'brute_force' WHEN probes > 0 THEN 'scanner' WHEN error_ratio > 0.05 THEN 'errors'
  WHEN avg_ms > 400 THEN 'latency' ELSE 'healthy' END AS finding FROM wide""", *CTES))
def _(spark, sf):
    return inc.diagnosis(hourly_metrics(spark, sf), KEYS).select(stamp("window_start").alias("window_start"), "finding")
