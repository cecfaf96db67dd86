"""Sessions, journeys and security."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlog.operators import security as sec, sessions as ss
from cinderlog.operators.context import AnalysisContext

from .catalog import duck_stamp, flag, log_sql, query, r6, stamp, stored_access
from .statistics_queries import stage_sql

# Thresholds small enough to fire on the derived log.
SMALL = AnalysisContext(bot_requests=8, bot_requests_per_minute=1.0, failed_logins=1, distinct_paths=4)

#: Sessions the plain way: order each client's requests and look at the gaps.
SESSION_CTE = f"""
visit AS (
  SELECT line_id, source_ip AS ip, seen, COALESCE(method, 'GET') AS method, COALESCE(path, '/') AS path, status_code, COALESCE(size, 0) AS size
  FROM access WHERE NOT parse_error
),
marked AS (
  SELECT *, CASE WHEN date_diff('second', lag(seen) OVER (PARTITION BY ip ORDER BY seen, line_id), seen) > 1800 THEN 1 ELSE 0 END AS opens
  FROM visit WHERE ip <> '-'
),
numbered AS (
  SELECT *, 'session_' || replace(ip, '.', '_') || '_' || CAST(SUM(opens) OVER (PARTITION BY ip ORDER BY seen, line_id) AS BIGINT) AS session_id FROM marked
),
request AS (
  SELECT session_id, line_id, ip, seen, method, path, status_code, size FROM numbered
  UNION ALL SELECT 'session_anon_' || CAST(line_id AS VARCHAR), line_id, ip, seen, method, path, status_code, size FROM visit WHERE ip = '-'
),
login AS (
  SELECT *, method = 'POST' AND (contains(lower(path), 'login') OR contains(lower(path), 'auth') OR contains(lower(path), 'signin')) AS login_post,
    status_code IN (401, 403) OR (method = 'POST' AND (contains(lower(path), 'login') OR contains(lower(path), 'auth') OR contains(lower(path), 'signin'))
      AND status_code >= 400) AS failed,
    {stage_sql('path')} AS stage
  FROM request
),
session AS (
  SELECT session_id, ip AS client_ip, MIN(seen) AS start_time, MAX(seen) AS end_time, CAST(date_diff('second', MIN(seen), MAX(seen)) AS DOUBLE) AS duration,
    COUNT(*) AS request_count, COUNT(*) FILTER (WHERE failed) AS failed_logins, COUNT(*) FILTER (WHERE login_post) AS login_posts,
    COUNT(*) FILTER (WHERE status_code IN (401, 403)) AS refused, COUNT(DISTINCT path) AS distinct_paths
  FROM login GROUP BY 1, 2
)"""


def _sessions(spark, sf):
    return ss.sessions_with_paths(stored_access(spark, sf))


@query("sessionize", log_sql(f"SELECT line_id, session_id, stage FROM login", SESSION_CTE))
def _(spark, sf):
    return ss.session_requests(stored_access(spark, sf)).select("line_id", "session_id", F.col("journey_stage").alias("stage"))


@query("session_table", log_sql(f"""
SELECT session_id, client_ip, {duck_stamp('start_time')} AS start_time, {duck_stamp('end_time')} AS end_time, duration AS duration_seconds,
  request_count, failed_logins, login_posts, refused FROM session""", SESSION_CTE))
def _(spark, sf):
    return ss.session_table(stored_access(spark, sf)).select(
        "session_id", "client_ip", stamp("start_time").alias("start_time"), stamp("end_time").alias("end_time"), "duration_seconds",
        "request_count", "failed_logins", "login_posts", "refused")


@query("session_requests", log_sql(f"""
SELECT session_id, {duck_stamp('seen')} AS seen, method, path, status_code, size, stage FROM login""", SESSION_CTE))
def _(spark, sf):
    return ss.session_requests(stored_access(spark, sf)).select(
        "session_id", stamp("time").alias("seen"), "method", "path", "status_code", "size", F.col("journey_stage").alias("stage"))


@query("session_metrics", log_sql("""
SELECT COUNT(*) AS active_sessions_count, ROUND(AVG(duration), 2) AS average_session_duration_seconds,
  ROUND(MAX(duration), 2) AS longest_session_duration_seconds, ROUND(COUNT(*) FILTER (WHERE request_count = 1) / COUNT(*) * 100.0, 2) AS bounce_rate,
  ROUND(AVG(distinct_paths), 2) AS pages_per_session, ROUND(AVG(request_count), 2) AS requests_per_session,
  COUNT(*) FILTER (WHERE request_count > 8 OR (duration > 10 AND request_count / (duration / 60.0::DOUBLE) > 1.0)) AS possible_bot_count,
  COUNT(*) FILTER (WHERE failed_logins > 1) AS credential_stuffing_count, COUNT(*) FILTER (WHERE distinct_paths > 4) AS endpoint_enumeration_count
FROM session""", SESSION_CTE))
def _(spark, sf):
    return ss.session_metrics(_sessions(spark, sf), [], SMALL)


@query("session_metrics_by_client", log_sql("""
SELECT client_ip, COUNT(*) AS active_sessions_count, ROUND(AVG(duration), 2) AS average_session_duration_seconds,
  ROUND(AVG(distinct_paths), 2) AS pages_per_session FROM session GROUP BY 1""", SESSION_CTE))
def _(spark, sf):
    return ss.session_metrics(_sessions(spark, sf), ["client_ip"], SMALL).select(
        "client_ip", "active_sessions_count", "average_session_duration_seconds", "pages_per_session")


@query("bot_sessions", log_sql("""
SELECT session_id, request_count FROM session
WHERE request_count > 8 OR (duration > 10 AND request_count / (duration / 60.0::DOUBLE) > 1.0)""", SESSION_CTE))
def _(spark, sf):
    return ss.bot_sessions(ss.session_table(stored_access(spark, sf)), SMALL).select("session_id", "request_count")


@query("credential_stuffing_sessions", log_sql("SELECT session_id, failed_logins FROM session WHERE failed_logins > 1", SESSION_CTE))
def _(spark, sf):
    return ss.credential_stuffing_sessions(ss.session_table(stored_access(spark, sf)), SMALL).select("session_id", "failed_logins")


@query("endpoint_enumeration_sessions", log_sql("SELECT session_id, distinct_paths FROM session WHERE distinct_paths > 4", SESSION_CTE))
def _(spark, sf):
    return ss.endpoint_enumeration_sessions(_sessions(spark, sf), SMALL).select("session_id", "distinct_paths")


@query("session_alerts", log_sql("""
SELECT session_id, CAST(request_count > 8 AS BIGINT) AS bot_risk, CAST(refused > 1 AS BIGINT) AS stuffing_risk, CAST(distinct_paths > 4 AS BIGINT) AS enumeration_risk
FROM session WHERE request_count > 8 OR refused > 1 OR distinct_paths > 4""", SESSION_CTE))
def _(spark, sf):
    return ss.session_alerts(_sessions(spark, sf), SMALL).select(
        "session_id", *[flag(c).alias(c) for c in ("bot_risk", "stuffing_risk", "enumeration_risk")])


@query("journeys", log_sql("""
SELECT session_id, stage, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seen, line_id) AS BIGINT) AS step
FROM (SELECT *, lag(stage) OVER (PARTITION BY session_id ORDER BY seen, line_id) AS before FROM login)
WHERE before IS DISTINCT FROM stage""", SESSION_CTE))
def _(spark, sf):
    return ss.journey_steps(stored_access(spark, sf)).select("session_id", "stage", "step")


@query("stage_counts", log_sql("""
SELECT s.stage, COUNT(l.line_id) AS requests
FROM (VALUES ('Landing'), ('Products'), ('Product'), ('Cart'), ('Checkout'), ('Other')) s(stage) LEFT JOIN login l USING (stage) GROUP BY 1""", SESSION_CTE))
def _(spark, sf):
    return ss.stage_counts(stored_access(spark, sf))


_REACH = """
reach AS (
  SELECT s.stage, COUNT(DISTINCT l.session_id) AS sessions
  FROM (VALUES ('Landing'), ('Products'), ('Product'), ('Cart'), ('Checkout')) s(stage) LEFT JOIN login l USING (stage) GROUP BY 1
)"""


@query("funnel_reach", log_sql("SELECT stage, sessions FROM reach", SESSION_CTE, _REACH))
def _(spark, sf):
    return ss.funnel_reach(ss.session_table(stored_access(spark, sf))).select("stage", "sessions")


@query("funnel_conversion", log_sql("""
SELECT stage, sessions, ROUND(sessions / GREATEST((SELECT MAX(sessions) FROM reach), 1) * 100.0, 6) AS pct_of_fullest,
  ROUND(sessions / (SELECT sessions FROM reach WHERE stage = 'Landing') * 100.0, 6) AS pct_of_landing FROM reach""", SESSION_CTE, _REACH))
def _(spark, sf):
    return ss.funnel_conversion(ss.session_table(stored_access(spark, sf))).withColumns(
        {c: r6(c) for c in ("pct_of_fullest", "pct_of_landing")})


@query("recent_sessions", log_sql(f"""
SELECT session_id, {duck_stamp('start_time')} AS start_time FROM session ORDER BY session.start_time DESC, session_id LIMIT 25""", SESSION_CTE))
def _(spark, sf):
    return ss.recent_sessions(ss.session_table(stored_access(spark, sf)), 25).select("session_id", stamp("start_time").alias("start_time"))


# -- security -----------------------------------------------------------------------------------------------------

SECURITY_CTE = r"""
payload AS (
  SELECT *, url_decode(COALESCE(path, '') || '  ' || COALESCE(raw, '')) AS text FROM access WHERE NOT parse_error
),
signal AS (
  SELECT *, regexp_matches(text, 'union\s+select|union\s+all\s+select|or\s+1\s*=\s*1|or\s+''1''\s*=\s*''1''', 'i') AS sqli,
    regexp_matches(text, '<script|javascript:|onerror\s*=|onload\s*=', 'i') AS xss,
    regexp_matches(text, '\.\./|\.\.\\|%2e%2e', 'i') AS traversal,
    regexp_matches(text, '\$\{jndi:|cmd\s*=|powershell|base64', 'i') AS rce,
    COALESCE(regexp_matches(path, '\.env|\.git|wp-admin|wp-login\.php|config\.php|backup\.zip|phpinfo|cgi-bin|setup\.php|admin/config', 'i'), false) AS probe
  FROM payload
)"""


@query("injection_counts", log_sql("""
SELECT COUNT(*) FILTER (WHERE sqli) AS sql_injection_count, COUNT(*) FILTER (WHERE xss) AS xss_injection_count,
  COUNT(*) FILTER (WHERE traversal) AS path_traversal_count, COUNT(*) FILTER (WHERE rce) AS rce_cmd_injection_count FROM signal""", SECURITY_CTE))
def _(spark, sf):
    return sec.injection_counts(stored_access(spark, sf))


@query("injection_hits", log_sql("""
SELECT line_id, source_ip AS client_ip, COALESCE(path, '') AS path, unnest(list_filter([CASE WHEN sqli THEN 'sqli' END, CASE WHEN xss THEN 'xss' END,
  CASE WHEN traversal THEN 'traversal' END, CASE WHEN rce THEN 'rce' END], lambda x: x IS NOT NULL)) AS signature FROM signal""", SECURITY_CTE))
def _(spark, sf):
    return sec.injection_hits(stored_access(spark, sf))


@query("document_signatures", r"""
SELECT doc_id, regexp_matches(text, 'union\s+select|union\s+all\s+select|or\s+1\s*=\s*1|or\s+''1''\s*=\s*''1''', 'i')::INT AS sqli,
  regexp_matches(text, '\$\{jndi:|cmd\s*=|powershell|base64', 'i')::INT AS rce,
  regexp_matches(text, '<script|javascript:|onerror\s*=|onload\s*=', 'i')::INT AS xss,
  regexp_matches(text, '\.\./|\.\.\\|%2e%2e', 'i')::INT AS traversal
FROM (SELECT doc_id, url_decode('  ' || text) AS text FROM documents)""")
def _(spark, sf):
    from .catalog import table

    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    return sec.security_signals(docs, [], {"doc_id": F.col("doc_id")}).select(
        "doc_id", *[F.col(c).cast("int").alias(c) for c in ("sqli", "rce", "xss", "traversal")])


@query("scanner_hits", log_sql("SELECT source_ip AS client_ip, COUNT(*) AS hits FROM signal WHERE probe GROUP BY 1", SECURITY_CTE))
def _(spark, sf):
    return sec.scanner_hits(stored_access(spark, sf))


@query("top_scanners", log_sql("SELECT source_ip AS client_ip, COUNT(*) AS hits FROM signal WHERE probe GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", SECURITY_CTE))
def _(spark, sf):
    return sec.top_scanners(stored_access(spark, sf))


@query("distinct_endpoints_per_ip", log_sql("""
SELECT source_ip AS client_ip, COUNT(DISTINCT COALESCE(path, '')) AS distinct_endpoints FROM access WHERE NOT parse_error AND source_ip <> '-' GROUP BY 1"""))
def _(spark, sf):
    return sec.distinct_endpoints_per_ip(stored_access(spark, sf))


@query("error_404_ratio", log_sql("SELECT ROUND(COUNT(*) FILTER (WHERE status_code = 404) / COUNT(*) * 100.0, 2) AS error_404_ratio FROM access"))
def _(spark, sf):
    return sec.error_404_ratio(stored_access(spark, sf))


@query("bot_user_agents", log_sql("""
SELECT COUNT(*) FILTER (WHERE user_agent IS NULL) AS missing_user_agent_count,
  COUNT(*) FILTER (WHERE regexp_matches(user_agent, 'headlesschrome|phantomjs|puppeteer|selenium|playwright', 'i')) AS headless_fingerprints_count
FROM access WHERE NOT parse_error"""))
def _(spark, sf):
    return sec.bot_user_agents(stored_access(spark, sf))


@query("failed_logins_per_ip", log_sql("""
SELECT client_ip, CAST(SUM(failed_logins) AS BIGINT) AS failed_logins FROM session WHERE client_ip <> '-' GROUP BY 1 HAVING SUM(failed_logins) > 0""", SESSION_CTE))
def _(spark, sf):
    return sec.failed_logins_per_ip(ss.session_table(stored_access(spark, sf)))


@query("lockout_candidates", log_sql("SELECT DISTINCT client_ip FROM session WHERE client_ip <> '-' AND failed_logins > 1", SESSION_CTE))
def _(spark, sf):
    return sec.lockout_candidates(ss.session_table(stored_access(spark, sf)), [], SMALL)


@query("login_failure_ratio", log_sql("""
SELECT ROUND(SUM(failed_logins)::DOUBLE / SUM(login_posts)::DOUBLE * 100.0, 2) AS failure_ratio FROM session WHERE client_ip <> '-'""", SESSION_CTE))
def _(spark, sf):
    return sec.login_failure_ratio(ss.session_table(stored_access(spark, sf)))


@query("requests_per_minute_per_ip", log_sql("""
SELECT client_ip, ROUND(MAX(request_count / GREATEST(duration / 60.0::DOUBLE, 0.05::DOUBLE)), 2) AS requests_per_minute
FROM session WHERE client_ip <> '-' GROUP BY 1""", SESSION_CTE))
def _(spark, sf):
    return sec.requests_per_minute_per_ip(ss.session_table(stored_access(spark, sf)))


@query("suspected_tools", log_sql("""
SELECT DISTINCT source_ip AS client_ip, unnest(list_filter([CASE WHEN contains(user_agent, 'Nikto') THEN 'Nikto' END,
  CASE WHEN contains(user_agent, 'Playwright') OR contains(user_agent, 'Headless') THEN 'Playwright (headless)' END,
  CASE WHEN contains(user_agent, 'Go-http-client') THEN 'Go-http-client' END,
  CASE WHEN contains(lower(user_agent), 'curl') THEN 'curl' END], lambda x: x IS NOT NULL)) AS tool FROM access WHERE user_agent IS NOT NULL"""))
def _(spark, sf):
    return sec.suspected_tools(stored_access(spark, sf))


@query("observed_targets", log_sql("""
SELECT path AS target, COUNT(*) AS requests FROM access
WHERE path IN ('/wp-admin', '/.env', '/.git', '/api/v1/auth/login', '/config.php', 'backup.zip') GROUP BY 1"""))
def _(spark, sf):
    return sec.observed_targets(stored_access(spark, sf))
