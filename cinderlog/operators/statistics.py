"""Flat statistics: every function takes records and grouping keys and gives one row per key, or a long table.

Without keys the whole table is one group. All aggregates combine before the shuffle, so one key that
holds most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import LATENCY_ALIASES, Fields, is_error_level
from .context import AnalysisContext
from .grouping import Keys, percent, ranked_per_key, ratio, with_totals
from .quantiles import percentile_table


def _count() -> Column:
    return F.count(F.lit(1))


def stats_summary(records: DataFrame, keys: Keys = [], extra: list[Column] = []) -> DataFrame:
    """Lines, parse error rate, 5xx rate, time range and bytes; ``extra`` aggregates (named) join the same pass."""
    f = Fields(records)
    code = f.integer("status_code")
    size_name = next((n for n in ("size", "bytes_sent", "body_bytes_sent") if f.has(n)), "size")
    size = f.number([size_name])
    total = _count()
    return records.groupBy(*keys).agg(
        total.alias("total_lines"),
        F.round(ratio(F.count_if(f.is_bad()), total), 4).alias("error_rate"),
        F.round(ratio(F.count_if((code >= 500) & (code < 600)), total), 4).alias("http_5xx_rate"),
        F.min(f.timestamp()).alias("first_time"),
        F.max(f.timestamp()).alias("last_time"),
        F.coalesce(F.sum(size), F.lit(0.0)).cast("bigint").alias("bytes_transferred"),
        *extra,
    )


def traffic_volume(records: DataFrame, keys: Keys = []) -> DataFrame:
    f = Fields(records)
    return records.groupBy(*keys).agg(
        _count().alias("total_requests"), F.coalesce(F.sum(f.volume()), F.lit(0)).alias("volume_bytes")
    )


def error_summary(records: DataFrame, keys: Keys = []) -> DataFrame:
    errors = F.count_if(is_error_level(Fields(records).level()))
    return records.groupBy(*keys).agg(errors.alias("total_errors"), ratio(errors, _count()).alias("error_ratio"))


def error_levels(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Records per level, levels upper-cased and trimmed."""
    level = Fields(records).level()
    return (
        records.select(*keys, level.alias("level")).where(F.col("level").isNotNull())
        .groupBy(*keys, "level").agg(_count().alias("records"))
    )


def status_codes(records: DataFrame, keys: Keys = []) -> DataFrame:
    code = Fields(records).status()
    return (
        records.select(*keys, code.alias("status_code")).where(F.col("status_code").isNotNull())
        .groupBy(*keys, "status_code").agg(_count().alias("records"))
    )


def _class_count(code: Column, digit: int) -> Column:
    return F.count_if(F.substring(code.cast("string"), 1, 1) == str(digit))


def status_categories(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Counts of 1xx to 5xx, zeros kept, and the 5xx share of all records."""
    code = Fields(records).status()
    return records.groupBy(*keys).agg(
        *[_class_count(code, d).alias(f"status_{d}xx") for d in range(1, 6)],
        F.when(_count() > 0, _class_count(code, 5) / _count()).alias("http_5xx_rate"),
    )


def endpoint_counts(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Requests and bytes per endpoint: the one table the endpoint measures are read from."""
    f = Fields(records)
    return (
        records.select(*keys, f.endpoint().alias("endpoint"), F.coalesce(f.response_size(), F.lit(0)).alias("_bytes"))
        .groupBy(*keys, "endpoint")
        .agg(_count().alias("requests"), F.sum("_bytes").alias("bytes_sent"))
    )


def endpoint_shares(records: DataFrame, keys: Keys = []) -> DataFrame:
    """All endpoints with their share of the requests in percent."""
    totals = records.groupBy(*keys).agg(_count().alias("total"))
    return with_totals(endpoint_counts(records, keys), totals, keys).select(
        *keys, "endpoint", "requests", percent(F.col("requests"), F.col("total")).alias("share_pct")
    )


def top_endpoints(records: DataFrame, keys: Keys = [], n: int = 5) -> DataFrame:
    """Most requested endpoints; equal counts by name."""
    best = ranked_per_key(endpoint_counts(records, keys), keys, [F.desc("requests"), F.asc("endpoint")], n)
    totals = records.groupBy(*keys).agg(_count().alias("total"))
    return with_totals(best, totals, keys).select(
        *keys, "endpoint", "requests", percent(F.col("requests"), F.col("total")).alias("share_pct")
    )


def top_paths(records: DataFrame, keys: Keys = [], n: int = 5) -> DataFrame:
    """Most frequent raw paths, absent paths left out."""
    f = Fields(records)
    name = next((c for c in ("path", "request_path", "uri", "endpoint") if f.has(c)), "path")
    counts = (
        records.select(*keys, f.text(name).alias("path")).where(F.col("path").isNotNull())
        .groupBy(*keys, "path").agg(_count().alias("requests"))
    )
    return ranked_per_key(counts, keys, [F.desc("requests"), F.asc("path")], n)


def ip_counts(records: DataFrame, keys: Keys = []) -> DataFrame:
    return (
        records.select(*keys, Fields(records).listed_ip().alias("ip")).where(F.col("ip").isNotNull())
        .groupBy(*keys, "ip").agg(_count().alias("requests"))
    )


def top_ips(records: DataFrame, keys: Keys = [], n: int = 50) -> DataFrame:
    """Busiest addresses; ``-`` left out, equal counts by address."""
    return ranked_per_key(ip_counts(records, keys), keys, [F.desc("requests"), F.asc("ip")], n)


def methods(records: DataFrame, keys: Keys = []) -> DataFrame:
    return (
        records.where(F.col("method").isNotNull()).groupBy(*keys, "method").agg(_count().alias("requests"))
    )


# Reported percentiles.
LATENCY_PERCENTILES = {"p50_ms": 50.0, "p90_ms": 90.0, "p95_ms": 95.0, "p99_ms": 99.0}
SIZE_PERCENTILES = {"p50": 50.0, "p95": 95.0}


def latency_range(records: DataFrame, keys: Keys = []) -> DataFrame:
    v = Fields(records).latency()
    return records.groupBy(*keys).agg(
        F.avg(v).alias("avg_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms")
    )


def latency_percentiles(records: DataFrame, keys: Keys = [], method: str = "exact") -> DataFrame:
    """p50, p90, p95 and p99 of the first latency field that reads as a number; units are not converted."""
    return percentile_table(records, keys, Fields(records).latency(), LATENCY_PERCENTILES, method)


def _size(records: DataFrame, which: str) -> Column:
    f = Fields(records)
    if which not in ("request", "response"):
        raise ValueError(f"which must be 'request' or 'response', not {which!r}")
    return f.request_size() if which == "request" else f.response_size()


def size_range(records: DataFrame, keys: Keys = [], which: str = "response") -> DataFrame:
    v = _size(records, which)
    return records.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("average"), F.min(v).alias("minimum"), F.max(v).alias("maximum")
    )


def size_percentiles(records: DataFrame, keys: Keys = [], which: str = "response", method: str = "exact") -> DataFrame:
    return percentile_table(records, keys, _size(records, which), SIZE_PERCENTILES, method)


def size_histogram(records: DataFrame, keys: Keys = [], which: str = "response", width: int = 100) -> DataFrame:
    """Records per fixed-width bin: ``bin_start``, label ``start-end``, count."""
    v = _size(records, which)
    start = (F.floor(F.col("_v") / width) * width).cast("bigint")
    label = F.concat_ws("-", F.col("bin_start").cast("string"), (F.col("bin_start") + (width - 1)).cast("string"))
    return (
        records.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(*keys, start.alias("bin_start")).agg(_count().alias("records"))
        .select(*keys, "bin_start", label.alias("bin"), "records")
    )


def bandwidth_summary(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Total bytes and bytes per second of the configured window, not of the observed span."""
    total = F.coalesce(F.sum(Fields(records).response_size()), F.lit(0))
    rate = total / ctx.window_seconds if ctx.window_seconds > 0 else F.lit(0.0)
    return records.groupBy(*keys).agg(
        total.alias("total_bytes_sent"), rate.cast("double").alias("bytes_per_second")
    )


def top_bandwidth_endpoints(records: DataFrame, keys: Keys = [], n: int = 5) -> DataFrame:
    """Endpoints by bytes with their share in percent; equal bytes by name."""
    best = ranked_per_key(endpoint_counts(records, keys), keys, [F.desc("bytes_sent"), F.asc("endpoint")], n)
    totals = records.groupBy(*keys).agg(F.coalesce(F.sum(Fields(records).response_size()), F.lit(0)).alias("total"))
    return with_totals(best, totals, keys).select(
        *keys, "endpoint", "bytes_sent", percent(F.col("bytes_sent"), F.col("total")).alias("percentage")
    )


def requests_per_second(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Records per second; records without a time are counted under NULL, which the averages need."""
    second = F.date_trunc("second", Fields(records).timestamp())
    return records.groupBy(*keys, second.alias("second")).agg(_count().alias("requests"))


def burst_summary(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Average over the window (all records, timed or not), peak second, their ratio, and the verdict."""
    return burst_verdict(requests_per_second(records, keys), keys, ctx)


def burst_verdict(seconds: DataFrame, keys: Keys, ctx: AnalysisContext) -> DataFrame:
    average = F.coalesce(F.sum("requests"), F.lit(0)) / float(ctx.window_seconds)
    peak = F.coalesce(F.max(F.when(F.col("second").isNotNull(), F.col("requests"))), F.lit(0)).cast("double")
    return (
        seconds.groupBy(*keys).agg(average.alias("average_rps"), peak.alias("peak_rps"))
        .withColumn("burst_ratio", ratio(F.col("peak_rps"), F.col("average_rps")))
        .withColumn("is_bursting", (F.col("burst_ratio") > 3.0) & (F.col("peak_rps") >= 5.0))
    )


def burst_windows(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Seconds with at least three times the average and at least two records."""
    seconds = requests_per_second(records, keys)
    averages = seconds.groupBy(*keys).agg((F.sum("requests") / float(ctx.window_seconds)).alias("average_rps"))
    return (
        with_totals(seconds.where(F.col("second").isNotNull()), averages, keys)
        .where(F.col("requests") >= F.greatest(F.col("average_rps") * 3.0, F.lit(2.0)))
        .select(
            *keys, "second", F.col("requests").cast("double").alias("requests_per_second"),
            ratio(F.col("requests"), F.col("average_rps")).alias("ratio"),
        )
    )


# Timeline buckets, their width in seconds and label layout.
TIMELINE_BUCKETS = {
    "minute": (60, "yyyy-MM-dd HH:mm"),
    "5-minute": (300, "yyyy-MM-dd HH:mm"),
    "15-minute": (900, "yyyy-MM-dd HH:mm"),
    "hour": (3600, "yyyy-MM-dd HH:00"),
    "day": (86400, "yyyy-MM-dd"),
}


def timeline_series(records: DataFrame, bucket: str = "hour", keys: Keys = []) -> DataFrame:
    """Records per UTC bucket with its label; records without a time are left out."""
    if bucket not in TIMELINE_BUCKETS:
        raise ValueError(f"bucket must be one of {list(TIMELINE_BUCKETS)}, not {bucket!r}")
    seconds, layout = TIMELINE_BUCKETS[bucket]
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("_t")) / seconds) * seconds)
    return (
        records.select(*keys, Fields(records).timestamp().alias("_t")).where(F.col("_t").isNotNull())
        .groupBy(*keys, start.alias("_start")).agg(_count().alias("count"))
        .select(*keys, F.date_format("_start", layout).alias("time"), "count")
    )


def dashboard_rates(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Summary line: totals, error and 5xx rates in percent, bytes (bandwidth total, else volume)."""
    f = Fields(records)
    code = f.status()
    sent = F.coalesce(F.sum(f.response_size()), F.lit(0))
    total = _count()
    return records.groupBy(*keys).agg(
        total.alias("total_lines"),
        percent(F.count_if(is_error_level(f.level())), total).alias("error_rate_pct"),
        F.when(total > 0, _class_count(code, 5) / total * 100.0).alias("http_5xx_rate_pct"),
        F.when(sent != 0, sent).otherwise(F.coalesce(F.sum(f.volume()), F.lit(0))).alias("bytes_transferred"),
    )


def ip_shares(records: DataFrame, keys: Keys = [], n: int = 50) -> DataFrame:
    """Busiest addresses with their share of all records in percent."""
    totals = records.groupBy(*keys).agg(_count().alias("total"))
    return with_totals(top_ips(records, keys, n), totals, keys).select(
        *keys, "ip", "requests", percent(F.col("requests"), F.col("total")).alias("percentage")
    )


def quality_counters(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Records seen, bad lines, and records that carry no latency key at all."""
    f = Fields(records)
    has_latency = F.lit(False)
    for name in LATENCY_ALIASES:
        has_latency = has_latency | f.present(name)
    return records.groupBy(*keys).agg(
        _count().alias("analyzed_records"),
        F.count_if(f.is_bad()).alias("skipped_records"),
        F.count_if(~has_latency).alias("missing_latency_fields"),
    )


def parsed_by_format(records: DataFrame, keys: Keys = []) -> DataFrame:
    return records.groupBy(*keys, "format").agg(
        _count().alias("records"), F.count_if(Fields(records).is_bad()).alias("parse_errors")
    )


# Upper bounds of the latency histogram in seconds.
LATENCY_BOUNDS = (0.001, 0.005, 0.010, 0.025, 0.050, 0.100, 0.250, 0.500, 1.0, 2.5, 5.0, 10.0)


def latency_le_buckets(df: DataFrame, seconds: Column, keys: Keys = [], bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts at or below each bound and ``+Inf``, from one pass."""
    timed = df.select(*keys, seconds.cast("double").alias("_s")).where(F.col("_s").isNotNull())
    wide = timed.groupBy(*keys).agg(
        *[F.count_if(F.col("_s") <= b).alias(f"le{i}") for i, b in enumerate(bounds)], _count().alias("inf")
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le{i}").alias("records")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("records")))
    return wide.select(*keys, F.inline(F.array(*rows)))
