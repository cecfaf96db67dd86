"""Logs derived from the ``events`` table, as SQL both Spark and DuckDB can run.

Every layer is a list of ``(column, expression)``. Spark applies them with ``selectExpr``; DuckDB runs
them as nested selects. The raw lines hold the columns they were built from, so parsing them must give
those columns back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.session import through_table

URLS = (
    "/", "/home", "/products", "/products/7", "/product/12", "/item/9", "/search?q=a", "/cart", "/shop/cart",
    "/checkout", "/pay", "/billing", "/login", "/api/auth", "/signin", "/wp-admin", "/.env", "/config.php",
    "/q?id=1%20UNION%20SELECT%201", "/q?s=<script>x", "/f?p=../../etc/passwd", "/f?p=%2e%2e/x", "/x?cmd=ls", "/about/",
)
_POSTED = ("/cart", "/shop/cart", "/checkout", "/login", "/api/auth", "/signin")
_PROBED = ("/wp-admin", "/.env", "/config.php")
_AGENTS = (
    "Mozilla/5.0", "HeadlessChrome/114", "Nikto/2.1.6", "curl/7.68.0", "Go-http-client/2.0", "Playwright/1.39", "-",
)
_ERROR_STATUS = (500, 401, 404, 403)
EPOCH = 1704067200  # 2024-01-01
#: Events that a task makes lines of.
EVENTS = 50_000


def _pick(index: str, values) -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted))
    return f"CASE {index} {cases} END"


def _positions(urls) -> str:
    return ", ".join(str(URLS.index(u)) for u in urls)


def _layers(micros: str, from_seconds: str, clf: str, iso: str, bsd: str) -> list[list[tuple[str, str]]]:
    """The dialect differences are the five time expressions; ``{c}`` in them is a column."""
    clf_at, iso_at, bsd_at = clf.format(c="seen"), iso.format(c="seen"), bsd.format(c="seen")
    base = [
        ("line_id", "event_id"),
        ("sec", f"{EPOCH} + CAST(floor(({micros} - {EPOCH}000000) / 25000000) AS BIGINT)"),
        ("uid", "user_id"),
        ("etype", "event_type"),
        ("val", "value"),
        ("bad", "event_id % 97 = 0"),
        ("spaced", "event_id % 89 = 0"),
        ("short", "event_id % 11 = 0"),
    ]
    fields = [
        ("seen", from_seconds.format(c="sec")),
        ("ip", "CASE WHEN line_id % 101 = 0 THEN '-' ELSE '10.' || CAST(CAST(floor(uid / 65536) AS BIGINT) AS STRING) "
               "|| '.' || CAST(CAST(floor(uid / 256) AS BIGINT) % 256 AS STRING) || '.' || CAST(uid % 256 AS STRING) END"),
        ("url", _pick("line_id % 24", URLS)),
        ("verb", f"CASE WHEN line_id % 24 IN ({_positions(_POSTED)}) THEN 'POST' ELSE 'GET' END"),
        ("status", f"CAST(CASE WHEN etype = 'error' THEN {_pick('line_id % 4', _ERROR_STATUS)} "
                   f"WHEN line_id % 24 IN ({_positions(_PROBED)}) THEN 404 ELSE 200 END AS BIGINT)"),
        ("bytes", "CASE WHEN line_id % 53 = 0 THEN NULL WHEN line_id % 59 = 0 THEN 0 "
                  "ELSE CAST(floor(val * 100) AS BIGINT) END"),
        ("agent", _pick("uid % 7", _AGENTS)),
        ("lvl", "CASE etype WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'NOTICE' "
                "WHEN 'click' THEN 'DEBUG' ELSE 'WARN' END"),
        ("latency", "CASE WHEN line_id % 10 = 3 THEN NULL ELSE CAST(floor(val * 10) AS BIGINT) END"),
        ("ruser", "CASE WHEN uid % 3 = 0 THEN '-' ELSE 'u' || CAST(uid AS STRING) END"),
        ("ref", "CASE WHEN line_id % 4 = 0 THEN '-' ELSE 'https://shop.example/' END"),
        ("host", "'host' || CAST(uid % 10 AS STRING)"),
        ("proc", _pick("line_id % 3", ("sshd", "cron", "kernel"))),
        ("pid", "CASE WHEN line_id % 7 = 0 THEN NULL ELSE uid + 100 END"),
        ("pri", "CASE WHEN line_id % 5 = 0 THEN NULL ELSE (line_id % 24) * 8 + line_id % 8 END"),
        ("msg", "CASE etype WHEN 'error' THEN 'connection failed for user ' WHEN 'view' THEN 'disk warning for user ' "
                "WHEN 'click' THEN 'Notice: quota of user ' ELSE 'session opened for user ' END || CAST(uid AS STRING)"),
        ("broken", "'corrupted line ' || CAST(event_id AS STRING)"),
    ]
    target = "CASE WHEN spaced THEN url || ' b' ELSE url END"
    size = "COALESCE(CAST(bytes AS STRING), '-')"
    raw = [
        ("raw_access",
         f"CASE WHEN bad THEN broken ELSE ip || ' - ' || ruser || ' [' || {clf_at} || ' +0000] \"' || verb || ' ' || "
         f"{target} || ' HTTP/1.1\" ' || CAST(status AS STRING) || ' ' || {size} || "
         f"CASE WHEN short THEN '' ELSE ' \"' || ref || '\" \"' || agent || '\"' END END"),
        ("raw_json",
         f"CASE WHEN bad THEN broken ELSE '{{\"time\": \"' || {iso_at} || 'Z\", \"level\": \"' || lower(lvl) || "
         "'\", \"msg\": \"' || msg || '\", \"source_ip\": \"' || ip || '\", \"method\": \"' || verb || "
         "'\", \"path\": \"' || url || '\", \"status_code\": ' || CAST(status AS STRING) || "
         "CASE WHEN bytes IS NULL THEN '' ELSE ', \"size\": ' || CAST(bytes AS STRING) END || "
         "', \"user_agent\": \"' || agent || '\"' || "
         "CASE WHEN latency IS NULL THEN '' ELSE ', \"latency_ms\": ' || CAST(latency AS STRING) END || "
         "', \"ctx\": {\"k\": ' || CAST(line_id % 100 AS STRING) || '}}' END"),
        ("raw_syslog3164",
         f"CASE WHEN bad THEN broken ELSE CASE WHEN pri IS NULL THEN '' ELSE '<' || CAST(pri AS STRING) || '>' END || "
         f"{bsd_at} || ' ' || host || ' ' || proc || CASE WHEN pid IS NULL THEN '' ELSE '[' || CAST(pid AS STRING) || ']' END "
         "|| ': ' || msg END"),
        ("raw_syslog5424",
         f"CASE WHEN bad THEN broken ELSE '<' || CAST(COALESCE(pri, 14) AS STRING) || '>1 ' || {iso_at} || 'Z ' || host || ' ' "
         "|| proc || ' ' || COALESCE(CAST(pid AS STRING), '-') || ' ' || CASE WHEN line_id % 2 = 0 THEN '-' ELSE 'ID' || "
         "CAST(line_id % 9 AS STRING) END || ' ' || CASE WHEN line_id % 3 = 0 THEN '-' ELSE '[a@1 u=\"' || CAST(uid AS STRING) "
         "|| '\"]' END || ' ' || msg END"),
        ("raw_django",
         f"CASE WHEN bad THEN broken WHEN line_id % 2 = 0 THEN '[' || {iso.format(c='seen')} || '] ' || lvl || ' app.' || etype "
         f"|| ': ' || msg ELSE replace({iso.format(c='seen')}, 'T', ' ') || ',000 - app.' || etype || ' - ' || lvl || ' - ' || msg END"),
        ("raw_win_csv",
         "CASE WHEN bad THEN broken ELSE '\"' || CASE etype WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Warning' WHEN 'click' "
         f"THEN 'Audit Failure' ELSE 'Information' END || '\",\"' || replace({iso_at}, 'T', ' ') || '\",\"' || host || '\",' || "
         "CAST(line_id % 5000 AS STRING) || ',\"' || etype || '\",\"The \"\"' || msg || '\"\", as told\"' END"),
        ("raw_win_xml",
         "CASE WHEN bad THEN broken ELSE '<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System>"
         "<Provider Name=\"' || host || '\"/><EventID>' || CAST(line_id % 5000 AS STRING) || '</EventID><TimeCreated SystemTime=\"' "
         f"|| {iso_at} || '.000000000Z\"/><Level>' || CAST(line_id % 6 AS STRING) || '</Level><Task>' || CAST(uid % 50 AS STRING) "
         "|| '</Task></System><EventData><Data Name=\"User\">u' || CAST(uid AS STRING) || '</Data><Data>' || msg "
         "|| '</Data></EventData></Event>' END"),
        ("raw_custom",
         f"CASE WHEN bad THEN broken ELSE {iso_at} || ' ' || lvl || ' status=' || CAST(status AS STRING) || ' ' || msg END"),
    ]
    return [base, fields, raw]


_SPARK = _layers(
    "unix_micros(CAST(ts AS TIMESTAMP))", "timestamp_seconds({c})",
    "date_format({c}, 'dd/MMM/yyyy:HH:mm:ss')", "date_format({c}, 'yyyy-MM-dd\\'T\\'HH:mm:ss')",
    "date_format({c}, 'MMM d HH:mm:ss')",
)
_DUCK = _layers(
    "epoch_us(ts)", "make_timestamp({c} * 1000000)", "strftime({c}, '%d/%b/%Y:%H:%M:%S')",
    "strftime({c}, '%Y-%m-%dT%H:%M:%S')", "strftime({c}, '%b %-d %H:%M:%S')",
)


def demo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layers as columns; Spark prunes what a query does not use."""
    return _with_layers(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _with_layers(df: DataFrame) -> DataFrame:
    for layer in _SPARK:
        df = df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in layer])
    return df


_written: dict[tuple[str, str, str], DataFrame] = {}


def written_once(spark: SparkSession, sf_dir: str, label: str, build) -> DataFrame:
    """``build()`` written to the shared folder, once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written:
        _written[key] = through_table(build(), label)
    return _written[key]


def spread_events(spark: SparkSession, sf_dir: str, most: int = EVENTS) -> DataFrame:
    """``demo_events`` dealt evenly to tasks of about ``most`` events. The table may hold a million rows in one row group, which is one
    task; making and parsing a line costs far more than reading its event."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = -(-table.count() // most)
    return _with_layers(table.repartition(parts) if parts > 1 else table)


def demo_lines(spark: SparkSession, sf_dir: str, raw: str = "raw_access") -> DataFrame:
    """Lines of one format, as a source would give them."""

    def build() -> DataFrame:
        return spread_events(spark, sf_dir).select(
            "line_id", F.lit(f"{raw}.log").alias("source_file"), F.col(raw).alias("value")
        )

    return written_once(spark, sf_dir, raw, build)


def _nested() -> str:
    inner = "events"
    for layer in _DUCK:
        columns = ", ".join(f"{expr} AS {name}" for name, expr in layer)
        inner = f"(SELECT *, {columns} FROM {inner}) AS t"
    return inner


#: ``demo``: every derived column. ``access`` and ``jsonlog``: what parsing must give back.
DUCK_LOG = f"""
demo AS (SELECT * FROM {_nested()}),
access AS (
  SELECT line_id, bad AS parse_error, raw_access AS raw,
    CASE WHEN NOT bad THEN seen END AS seen,
    CASE WHEN NOT bad THEN ip END AS source_ip,
    CASE WHEN NOT bad AND ruser <> '-' THEN ruser END AS remote_user,
    CASE WHEN NOT bad AND NOT spaced THEN verb END AS method,
    CASE WHEN NOT bad AND NOT spaced THEN url END AS path,
    CASE WHEN NOT bad AND NOT spaced THEN 'HTTP/1.1' END AS protocol,
    CASE WHEN NOT bad AND spaced THEN verb || ' ' || url || ' b HTTP/1.1' END AS request,
    CASE WHEN NOT bad THEN status END AS status_code,
    CASE WHEN NOT bad THEN bytes END AS size,
    CASE WHEN NOT bad AND NOT short AND ref <> '-' THEN ref END AS referer,
    CASE WHEN NOT bad AND NOT short AND agent <> '-' THEN agent END AS user_agent
  FROM demo
),
jsonlog AS (
  SELECT line_id, bad AS parse_error, raw_json AS raw,
    CASE WHEN NOT bad THEN seen END AS seen,
    CASE WHEN NOT bad THEN CASE lvl WHEN 'WARN' THEN 'WARNING' ELSE lvl END END AS level,
    CASE WHEN NOT bad THEN msg END AS message,
    CASE WHEN NOT bad THEN ip END AS source_ip,
    CASE WHEN NOT bad THEN verb END AS method,
    CASE WHEN NOT bad THEN url END AS path,
    CASE WHEN NOT bad THEN status END AS status_code,
    CASE WHEN NOT bad THEN bytes END AS size,
    CASE WHEN NOT bad THEN agent END AS user_agent,
    CASE WHEN NOT bad THEN latency END AS latency_ms
  FROM demo
)"""
