"""Scalar normalisers, record explorer and flat statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cinderlog.functions.fields import (
    Fields, is_error_level, journey_stage, normalize_level, record_id, safe_int, severity_rank, template_path,
)
from cinderlog.functions.text import url_decode_lenient
from cinderlog.functions.times import normalize_timestamp
from cinderlog.operators import explore, statistics as st
from cinderlog.operators.context import AnalysisContext
from cinderlog.operators.quantiles import exact_percentiles
from cinderlog.session import through_table

from .catalog import duck_stamp, flag, log_sql, query, r6, stamp, stored_access, stored_json, table
from .demo_log import demo_events

# -- scalar normalisers ------------------------------------------------------------------------------------


@query("normalize_timestamp", log_sql(f"""
SELECT line_id, CASE WHEN line_id % 8 IN (6, 7) THEN NULL WHEN line_id % 8 = 5 THEN strftime(seen, '%Y-%m-%d') || ' 00:00:00'
  ELSE {duck_stamp('seen')} END AS parsed FROM demo"""))
def _(spark, sf):
    text = """CASE line_id % 8
      WHEN 0 THEN '[' || date_format(seen, 'dd/MMM/yyyy:HH:mm:ss') || ' +0000]'
      WHEN 1 THEN '"' || date_format(seen, "yyyy-MM-dd'T'HH:mm:ss") || 'Z"'
      WHEN 2 THEN date_format(seen, 'yyyy-MM-dd HH:mm:ss') || ',000'
      WHEN 3 THEN date_format(seen, 'MMM d HH:mm:ss')
      WHEN 4 THEN date_format(seen, 'M/d/yyyy h:mm:ss a')
      WHEN 5 THEN date_format(seen, 'yyyy-MM-dd')
      WHEN 6 THEN '-' ELSE 'not a time' END"""
    rows = demo_events(spark, sf).select("line_id", F.expr(text).alias("text"))
    return rows.select("line_id", stamp(normalize_timestamp(F.col("text"), year=2024)).alias("parsed"))


@query("safe_int", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE event_id END AS n
FROM events""")
def _(spark, sf):
    text = """CASE event_id % 5 WHEN 0 THEN ' "' || event_id || '" ' WHEN 1 THEN '-' || event_id WHEN 2 THEN '-'
      WHEN 3 THEN event_id || '.5' ELSE '''' || event_id || '''' END"""
    rows = table(spark, sf, "events").select("event_id", F.expr(text).alias("text"))
    return rows.select("event_id", safe_int(F.col("text")).alias("n"))


@query("extract_numeric", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN 7.5::DOUBLE ELSE NULL END AS latency FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN '-' WHEN 2 THEN 'fast' ELSE 'slow' END AS latency",
        "CASE event_id % 4 WHEN 1 THEN CAST(value AS STRING) WHEN 2 THEN '7.5' END AS duration_ms",
    )
    return rows.select("event_id", Fields(rows).latency().alias("latency"))


@query("normalize_endpoint", log_sql("""
SELECT line_id, CASE WHEN parse_error THEN 'unknown' WHEN path IS NOT NULL THEN path ELSE split_part(request, ' ', 2) END AS endpoint
FROM access"""))
def _(spark, sf):
    a = stored_access(spark, sf)
    return a.select("line_id", Fields(a).endpoint().alias("endpoint"))


@query("client_ip", log_sql("SELECT line_id, COALESCE(source_ip, '-') AS client_ip FROM access"))
def _(spark, sf):
    a = stored_access(spark, sf)
    return a.select("line_id", Fields(a).client_ip().alias("client_ip"))


def stage_sql(path: str) -> str:
    p = f"rtrim(split_part(lower({path}), '?', 1), '/')"
    return f"""CASE WHEN {p} IN ('', '/home', '/index.html', '/index.htm', '/index') THEN 'Landing'
  WHEN regexp_matches({p}, '^/(products|catalog|category|search)') THEN 'Products'
  WHEN regexp_matches({p}, '^/(product|item|details)') THEN 'Product'
  WHEN {p} = '/cart' OR {p} LIKE '%/cart' OR {p} LIKE '%/shopping-cart' THEN 'Cart'
  WHEN regexp_matches({p}, '^/(checkout|pay|billing|purchase)') THEN 'Checkout' ELSE 'Other' END"""


@query("journey_stage", log_sql(f"SELECT line_id, {stage_sql('path')} AS stage FROM access WHERE path IS NOT NULL"))
def _(spark, sf):
    return stored_access(spark, sf).where("path IS NOT NULL").select("line_id", journey_stage(F.col("path")).alias("stage"))


_URL_PATH = r"regexp_replace(url, '^https?://[^/]+', '')"


@query("journey_stage_pages", f"SELECT page_id, {stage_sql(_URL_PATH)} AS stage FROM pages")
def _(spark, sf):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return table(spark, sf, "pages").select("page_id", journey_stage(path).alias("stage"))


@query("url_decode_lenient", log_sql("""
SELECT line_id, url_decode(url || CASE line_id % 3 WHEN 0 THEN '+%zz' WHEN 1 THEN '%41%' ELSE '' END) AS decoded FROM demo"""))
def _(spark, sf):
    rows = demo_events(spark, sf).selectExpr(
        "line_id", "url || CASE line_id % 3 WHEN 0 THEN '+%zz' WHEN 1 THEN '%41%' ELSE '' END AS text")
    return rows.select("line_id", url_decode_lenient(F.col("text")).alias("decoded"))


@query("url_decode_pages", "SELECT page_id, url_decode(url) AS decoded FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_decode_lenient(F.col("url")).alias("decoded"))


@query("normalize_level", log_sql("""
SELECT line_id, lvl AS level, CAST(lvl = 'ERROR' AS BIGINT) AS is_error FROM demo"""))
def _(spark, sf):
    rows = demo_events(spark, sf).selectExpr("line_id", "'  ' || lower(lvl) || ' ' AS level")
    level = normalize_level(F.col("level"))
    return rows.select("line_id", level.alias("level"), flag(is_error_level(level)).alias("is_error"))


@query("template_path_ids", """
SELECT CASE WHEN event_id % 3 = 0 THEN '/api/v1/tasks/{task_id}' WHEN event_id % 3 = 1 THEN '/api/v1/tasks/' || event_id || '/log'
  ELSE '/health' END AS path, COUNT(*) AS requests FROM events GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN '/api/v1/tasks/t' || event_id WHEN event_id % 3 = 1 THEN '/api/v1/tasks/' || event_id || '/log' "
        "ELSE '/health' END AS path")
    return rows.groupBy(template_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("requests"))


@query("severity_rank", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END AS rank FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "elt(event_id % 6 + 1, 'critical', 'HIGH', 'Medium', 'low', 'info', 'other') AS severity")
    return rows.select("event_id", severity_rank(F.col("severity")).alias("rank"))


_WRAP = "((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query("record_id", log_sql(f"""
SELECT line_id, COALESCE(strftime(seen, '%Y-%m-%dT%H:%M:%SZ'), '') || '_' || COALESCE(source_ip, '') || '_' || CAST(line_id AS VARCHAR) || '_'
  || CAST(abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(raw, ''), lambda x: unicode(x)::BIGINT)), lambda a, c: {_WRAP})) AS VARCHAR)
  AS record_id FROM access"""))
def _(spark, sf):
    a = stored_access(spark, sf)
    return a.select("line_id", record_id(Fields(a), F.col("line_id")).alias("record_id"))


# -- record explorer -----------------------------------------------------------------------------------------


@query("search_all_columns", """
SELECT o_orderkey FROM orders WHERE contains(lower(CAST(o_orderkey AS VARCHAR)), '4-n') OR contains(lower(CAST(o_custkey AS VARCHAR)), '4-n')
  OR contains(lower(o_orderstatus), '4-n') OR contains(lower(o_orderpriority), '4-n')""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return explore.search_all_columns(orders, " 4-N ").select("o_orderkey")


@query("filter_columns", log_sql("SELECT line_id FROM access WHERE contains(lower(path), 'prod') AND contains(lower(user_agent), 'moz')"))
def _(spark, sf):
    return explore.filter_columns(stored_access(spark, sf), {"path": "PROD", "user_agent": "moz"}).select("line_id")


@query("filter_levels", log_sql("SELECT line_id FROM jsonlog WHERE level IN ('WARNING', 'ERROR')"))
def _(spark, sf):
    return explore.filter_levels(stored_json(spark, sf), ["warn", "ERROR"]).select("line_id")


@query("filter_status_class", log_sql("SELECT line_id FROM access WHERE status_code BETWEEN 400 AND 599"))
def _(spark, sf):
    return explore.filter_status_class(stored_access(spark, sf), ["4xx", "5xx"]).select("line_id")


@query("filter_time_range", log_sql(
    "SELECT line_id FROM access WHERE seen BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-01 12:00:00'"))
def _(spark, sf):
    return explore.filter_time_range(stored_access(spark, sf), "2024-01-01 06:00:00", "2024-01-01 12:00:00").select("line_id")


@query("sort_records", log_sql("""
SELECT line_id, size, CAST(row_number() OVER (ORDER BY size DESC NULLS LAST, line_id) AS BIGINT) AS place FROM access"""))
def _(spark, sf):
    # The place of every row in the sorted table: its place in its partition, after all rows of the partitions before.
    ordered = explore.sort_records(stored_access(spark, sf), "size", "desc")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = through_table(ordered.select("line_id", "size", F.spark_partition_id().alias("part"), place.alias("inside")), "sorted")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return placed.join(parts, "part").select("line_id", "size", (F.col("before") + F.col("inside") + 1).alias("place"))


@query("paginate", "SELECT o_orderkey FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("line_id", F.col("o_orderkey"))
    return explore.paginate(orders, "o_totalprice", "asc", page=3, rows_per_page=50).select("o_orderkey")


@query("next_page", "SELECT o_orderkey FROM orders WHERE o_totalprice < 250000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("line_id", F.col("o_orderkey"))
    return explore.next_page(orders, "o_totalprice", 250000.0, 1 << 60, "desc", 50).select("o_orderkey")


@query("page_count", "SELECT COUNT(*) AS total_rows, CAST(ceil(COUNT(*) / 50) AS BIGINT) AS total_pages FROM orders")
def _(spark, sf):
    return explore.page_count(table(spark, sf, "orders"), 50)


@query("project_columns", log_sql("SELECT line_id, path, CAST(latency_ms AS VARCHAR) AS latency_ms FROM jsonlog"))
def _(spark, sf):
    return explore.project_columns(stored_json(spark, sf), ["line_id", "path", "latency_ms"])


@query("head_tail", log_sql("""
SELECT 'head' AS part, line_id FROM (SELECT line_id FROM access ORDER BY line_id LIMIT 20)
UNION ALL SELECT 'tail', line_id FROM (SELECT line_id FROM access ORDER BY line_id DESC LIMIT 20)"""))
def _(spark, sf):
    a = stored_access(spark, sf)
    return explore.head(a, 20).select(F.lit("head").alias("part"), "line_id").unionByName(
        explore.tail(a, 20).select(F.lit("tail").alias("part"), "line_id"))


# -- flat statistics -------------------------------------------------------------------------------------------


@query("stats_summary", log_sql(f"""
SELECT COUNT(*) AS total_lines, ROUND(COUNT(*) FILTER (WHERE parse_error) / COUNT(*), 4) AS error_rate,
  ROUND(COUNT(*) FILTER (WHERE status_code >= 500 AND status_code < 600) / COUNT(*), 4) AS http_5xx_rate,
  {duck_stamp('MIN(seen)')} AS first_time, {duck_stamp('MAX(seen)')} AS last_time,
  CAST(COALESCE(SUM(size), 0) AS BIGINT) AS bytes_transferred
FROM access"""))
def _(spark, sf):
    return st.stats_summary(stored_access(spark, sf)).withColumns(
        {"first_time": stamp("first_time"), "last_time": stamp("last_time")})


@query("stats_summary_by_method", log_sql("""
SELECT method, COUNT(*) AS total_lines, ROUND(COUNT(*) FILTER (WHERE status_code BETWEEN 500 AND 599) / COUNT(*), 4) AS http_5xx_rate
FROM access GROUP BY 1"""))
def _(spark, sf):
    return st.stats_summary(stored_access(spark, sf), ["method"]).select("method", "total_lines", "http_5xx_rate")


@query("traffic_volume", log_sql("""
SELECT COUNT(*) AS total_requests, CAST(SUM(CASE WHEN size <> 0 THEN size ELSE length(raw) END) AS BIGINT) AS volume_bytes FROM
  (SELECT COALESCE(size, 0) AS size, raw FROM access)"""))
def _(spark, sf):
    return st.traffic_volume(stored_access(spark, sf))


@query("error_summary", log_sql("""
SELECT COUNT(*) FILTER (WHERE level = 'ERROR') AS total_errors, ROUND(COUNT(*) FILTER (WHERE level = 'ERROR') / COUNT(*), 6) AS error_ratio
FROM jsonlog"""))
def _(spark, sf):
    return st.error_summary(stored_json(spark, sf)).withColumn("error_ratio", r6("error_ratio"))


@query("error_levels", log_sql("SELECT level, COUNT(*) AS records FROM jsonlog WHERE level IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return st.error_levels(stored_json(spark, sf))


@query("status_codes", log_sql("SELECT status_code, COUNT(*) AS records FROM access WHERE status_code IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return st.status_codes(stored_access(spark, sf))


@query("status_categories", log_sql("""
SELECT COUNT(*) FILTER (WHERE status_code // 100 = 1) AS status_1xx, COUNT(*) FILTER (WHERE status_code // 100 = 2) AS status_2xx,
  COUNT(*) FILTER (WHERE status_code // 100 = 3) AS status_3xx, COUNT(*) FILTER (WHERE status_code // 100 = 4) AS status_4xx,
  COUNT(*) FILTER (WHERE status_code // 100 = 5) AS status_5xx,
  ROUND(COUNT(*) FILTER (WHERE status_code // 100 = 5) / COUNT(*), 6) AS http_5xx_rate
FROM access"""))
def _(spark, sf):
    return st.status_categories(stored_access(spark, sf)).withColumn("http_5xx_rate", r6("http_5xx_rate"))


_ENDPOINT = "CASE WHEN parse_error THEN 'unknown' WHEN path IS NOT NULL THEN path ELSE split_part(request, ' ', 2) END"


@query("endpoint_shares", log_sql(f"""
SELECT {_ENDPOINT} AS endpoint, COUNT(*) AS requests, ROUND(COUNT(*) / (SELECT COUNT(*) FROM access) * 100.0, 6) AS share_pct
FROM access GROUP BY 1"""))
def _(spark, sf):
    return st.endpoint_shares(stored_access(spark, sf)).withColumn("share_pct", r6("share_pct"))


@query("top_endpoints", log_sql(f"""
SELECT {_ENDPOINT} AS endpoint, COUNT(*) AS requests, ROUND(COUNT(*) / (SELECT COUNT(*) FROM access) * 100.0, 6) AS share_pct
FROM access GROUP BY 1 ORDER BY requests DESC, endpoint LIMIT 5"""))
def _(spark, sf):
    return st.top_endpoints(stored_access(spark, sf)).withColumn("share_pct", r6("share_pct"))


@query("top_endpoints_by_client", log_sql("""
SELECT source_ip, CASE WHEN path IS NOT NULL THEN path WHEN request IS NOT NULL THEN split_part(request, ' ', 2) ELSE 'unknown' END AS endpoint,
  COUNT(*) AS requests FROM access GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY COUNT(*) DESC, endpoint) <= 3"""))
def _(spark, sf):
    return st.top_endpoints(stored_access(spark, sf), ["source_ip"], 3).select("source_ip", "endpoint", "requests")


@query("top_paths", log_sql("SELECT path, COUNT(*) AS requests FROM access WHERE path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def _(spark, sf):
    return st.top_paths(stored_access(spark, sf))


@query("top_ips", log_sql("""
SELECT source_ip AS ip, COUNT(*) AS requests FROM access WHERE source_ip <> '-' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""))
def _(spark, sf):
    return st.top_ips(stored_access(spark, sf))


@query("methods", log_sql("SELECT method, COUNT(*) AS requests FROM access WHERE method IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return st.methods(stored_access(spark, sf))


@query("latency_percentiles", log_sql("""
SELECT ROUND(quantile_cont(v, 0.5), 6) AS p50_ms, ROUND(quantile_cont(v, 0.9), 6) AS p90_ms, ROUND(quantile_cont(v, 0.95), 6) AS p95_ms,
  ROUND(quantile_cont(v, 0.99), 6) AS p99_ms FROM (SELECT CAST(latency_ms AS DOUBLE) AS v FROM jsonlog)"""))
def _(spark, sf):
    df = st.latency_percentiles(stored_json(spark, sf))
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query("latency_percentiles_by_status", log_sql("""
SELECT status_code, ROUND(quantile_cont(v, 0.5), 6) AS p50_ms, ROUND(quantile_cont(v, 0.9), 6) AS p90_ms,
  ROUND(quantile_cont(v, 0.95), 6) AS p95_ms, ROUND(quantile_cont(v, 0.99), 6) AS p99_ms
FROM (SELECT status_code, CAST(latency_ms AS DOUBLE) AS v FROM jsonlog) GROUP BY 1 HAVING COUNT(v) > 0"""))
def _(spark, sf):
    df = st.latency_percentiles(stored_json(spark, sf), ["status_code"])
    return df.select("status_code", *[r6(c).alias(c) for c in df.columns if c != "status_code"])


@query("latency_range", log_sql("""
SELECT ROUND(AVG(latency_ms), 6) AS avg_ms, CAST(MIN(latency_ms) AS DOUBLE) AS min_ms, CAST(MAX(latency_ms) AS DOUBLE) AS max_ms FROM jsonlog"""))
def _(spark, sf):
    return st.latency_range(stored_json(spark, sf)).withColumn("avg_ms", r6("avg_ms"))


@query("exact_percentiles_lineitem", """
SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS p50, ROUND(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem GROUP BY 1""")
def _(spark, sf):
    df = exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), {"p50": 50.0, "p95": 95.0})
    return df.select("l_returnflag", r6("p50").alias("p50"), r6("p95").alias("p95"))


@query("size_distribution", log_sql("""
SELECT COUNT(size) AS count, ROUND(AVG(size), 6) AS average, MIN(size) AS minimum, MAX(size) AS maximum,
  ROUND(quantile_cont(CAST(size AS DOUBLE), 0.5), 6) AS p50, ROUND(quantile_cont(CAST(size AS DOUBLE), 0.95), 6) AS p95 FROM access"""))
def _(spark, sf):
    a = stored_access(spark, sf)
    p = st.size_percentiles(a)
    return st.size_range(a).select(
        "count", r6("average").alias("average"), "minimum", "maximum",
        F.round(p.select("p50").scalar(), 6).alias("p50"), F.round(p.select("p95").scalar(), 6).alias("p95"))


@query("size_histogram", log_sql("""
SELECT size // 100 * 100 AS bin_start, CAST(size // 100 * 100 AS VARCHAR) || '-' || CAST(size // 100 * 100 + 99 AS VARCHAR) AS bin,
  COUNT(*) AS records FROM access WHERE size IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    return st.size_histogram(stored_access(spark, sf))


@query("size_histogram_lineitem", """
SELECT l_linestatus, CAST(floor(l_extendedprice / 1000) * 1000 AS BIGINT) AS bin_start, COUNT(*) AS records FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("size"))
    return st.size_histogram(rows, ["l_linestatus"], width=1000).drop("bin")


@query("bandwidth_summary", log_sql("""
SELECT CAST(SUM(size) AS BIGINT) AS total_bytes_sent, ROUND(SUM(size) / 300.0::DOUBLE, 6) AS bytes_per_second FROM access"""))
def _(spark, sf):
    return st.bandwidth_summary(stored_access(spark, sf)).withColumn("bytes_per_second", r6("bytes_per_second"))


@query("top_bandwidth_endpoints", log_sql(f"""
SELECT {_ENDPOINT} AS endpoint, CAST(SUM(COALESCE(size, 0)) AS BIGINT) AS bytes_sent,
  ROUND(SUM(COALESCE(size, 0)) / (SELECT SUM(size)::DOUBLE FROM access) * 100.0, 6) AS percentage
FROM access GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(spark, sf):
    return st.top_bandwidth_endpoints(stored_access(spark, sf)).withColumn("percentage", r6("percentage"))


@query("burst_per_second", log_sql(f"SELECT {duck_stamp('seen')} AS second, COUNT(*) AS requests FROM access GROUP BY 1"))
def _(spark, sf):
    return st.requests_per_second(stored_access(spark, sf)).withColumn("second", stamp("second"))


_BURST = """
seconds AS (SELECT date_trunc('hour', seen) AS h, seen, COUNT(*) AS n FROM access WHERE seen IS NOT NULL GROUP BY 1, 2),
hours AS (SELECT h, SUM(n) / 3600.0::DOUBLE AS average_rps, MAX(n)::DOUBLE AS peak_rps FROM seconds GROUP BY 1)"""
_HOUR = AnalysisContext(window_minutes=60)


def _hourly(spark, sf):
    return stored_access(spark, sf).where("timestamp IS NOT NULL").withColumn("h", F.date_trunc("hour", "timestamp"))


@query("burst_summary", log_sql(f"""
SELECT {duck_stamp('h')} AS h, ROUND(average_rps, 6) AS average_rps, peak_rps, ROUND(peak_rps / average_rps, 6) AS burst_ratio,
  CAST(peak_rps / average_rps > 3 AND peak_rps >= 5 AS BIGINT) AS is_bursting FROM hours""", _BURST))
def _(spark, sf):
    return st.burst_summary(_hourly(spark, sf), ["h"], _HOUR).select(
        stamp("h").alias("h"), r6("average_rps").alias("average_rps"), "peak_rps", r6("burst_ratio").alias("burst_ratio"),
        flag("is_bursting").alias("is_bursting"))


@query("burst_windows", log_sql(f"""
SELECT {duck_stamp('h')} AS h, {duck_stamp('seen')} AS second, n::DOUBLE AS requests_per_second, ROUND(n / average_rps, 6) AS ratio
FROM seconds JOIN hours USING (h) WHERE n >= GREATEST(3 * average_rps, 2.0)""", _BURST))
def _(spark, sf):
    return st.burst_windows(_hourly(spark, sf), ["h"], _HOUR).select(
        stamp("h").alias("h"), stamp("second").alias("second"), "requests_per_second", r6("ratio").alias("ratio"))


@query("burst_windows_overall", log_sql(f"""
SELECT {duck_stamp('seen')} AS second, COUNT(*)::DOUBLE AS requests_per_second,
  ROUND(COUNT(*) / ((SELECT COUNT(*) FROM access) / 360000.0::DOUBLE), 6) AS ratio FROM access WHERE seen IS NOT NULL
GROUP BY 1 HAVING COUNT(*) >= GREATEST(3.0 * (SELECT COUNT(*) FROM access) / 360000.0, 2.0)"""))
def _(spark, sf):
    return st.burst_windows(stored_access(spark, sf), [], AnalysisContext(window_minutes=6000)).select(
        stamp("second").alias("second"), "requests_per_second", r6("ratio").alias("ratio"))


@query("timeline_series", log_sql("""
SELECT '5-minute' AS bucket, strftime(to_timestamp(epoch(seen)::BIGINT // 300 * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS time, COUNT(*) AS count
  FROM access WHERE seen IS NOT NULL GROUP BY 2
UNION ALL SELECT 'minute', strftime(seen, '%Y-%m-%d %H:%M'), COUNT(*) FROM access WHERE seen IS NOT NULL GROUP BY 2
UNION ALL SELECT '15-minute', strftime(to_timestamp(epoch(seen)::BIGINT // 900 * 900) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M'), COUNT(*) FROM access WHERE seen IS NOT NULL GROUP BY 2
UNION ALL SELECT 'hour', strftime(seen, '%Y-%m-%d %H:00'), COUNT(*) FROM access WHERE seen IS NOT NULL GROUP BY 2
UNION ALL SELECT 'day', strftime(seen, '%Y-%m-%d'), COUNT(*) FROM access WHERE seen IS NOT NULL GROUP BY 2"""))
def _(spark, sf):
    a = stored_access(spark, sf)
    out = None
    for bucket in st.TIMELINE_BUCKETS:
        part = st.timeline_series(a, bucket).select(F.lit(bucket).alias("bucket"), "time", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query("share_of_total", log_sql("""
SELECT source_ip AS ip, COUNT(*) AS requests, ROUND(COUNT(*) / (SELECT COUNT(*) FROM access) * 100.0, 6) AS percentage
FROM access WHERE source_ip <> '-' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""))
def _(spark, sf):
    return st.ip_shares(stored_access(spark, sf)).withColumn("percentage", r6("percentage"))


@query("dashboard_rates", log_sql("""
SELECT COUNT(*) AS total_lines, ROUND(COUNT(*) FILTER (WHERE level = 'ERROR') / COUNT(*) * 100.0, 6) AS error_rate_pct,
  ROUND(COUNT(*) FILTER (WHERE status_code >= 500) / COUNT(*) * 100.0, 6) AS http_5xx_rate_pct, CAST(SUM(size) AS BIGINT) AS bytes_transferred
FROM jsonlog"""))
def _(spark, sf):
    return st.dashboard_rates(stored_json(spark, sf)).withColumns(
        {c: r6(c) for c in ("error_rate_pct", "http_5xx_rate_pct")})


@query("quality_counters", log_sql("""
SELECT COUNT(*) AS analyzed_records, COUNT(*) FILTER (WHERE parse_error) AS skipped_records,
  COUNT(*) FILTER (WHERE latency_ms IS NULL) AS missing_latency_fields FROM jsonlog"""))
def _(spark, sf):
    return st.quality_counters(stored_json(spark, sf))


_LE = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@query("latency_le_buckets", log_sql(
    " UNION ALL ".join(
        f"SELECT '{b}' AS le, COUNT(*) FILTER (WHERE latency_ms / 1000.0::DOUBLE <= {b}) AS records FROM jsonlog" for b in _LE
    ) + " UNION ALL SELECT '+Inf', COUNT(latency_ms) FROM jsonlog"))
def _(spark, sf):
    j = stored_json(spark, sf)
    return st.latency_le_buckets(j, Fields(j).latency() / 1000.0)


@query("register_stats", log_sql("""
SELECT COUNT(*) AS total_lines, COUNT(*) FILTER (WHERE contains(path, 'admin')) AS admin_requests FROM access"""))
def _(spark, sf):
    from cinderlog.plans.plugins import register_stats, stats, unregister_stats

    register_stats("admin", lambda f: {"admin_requests": F.count_if(F.contains(f.text("path"), F.lit("admin")))})
    try:
        return stats(stored_access(spark, sf)).select("total_lines", "admin_requests")
    finally:
        unregister_stats("admin")
