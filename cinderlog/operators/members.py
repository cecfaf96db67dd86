"""Map and list members of the metric bundle, from one scan of the records.

Every record gives a few ``(kind, name)`` pairs, which are counted together (combined before the shuffle): levels, status codes, endpoints,
addresses, seconds, size bins, probes, refused logins, and the paths of each client. All members are read from that one table of counts.
They come as rows and not as maps, since the number of names has no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import Fields
from .context import AnalysisContext
from .grouping import Keys, percent, ratio, with_totals
from .security import PROBE_PATHS
from .sessions import is_failed_login

#: Endpoints listed by requests and by bytes.
TOP_ENDPOINTS = 5
#: Kinds that are members as they are: their names with their counts.
_PLAIN = {
    "level": "error.errors_by_level", "code": "status.status_codes", "failed": "security.brute_force.failed_logins_per_ip",
    "probe": "security.scanner_metrics.scanned_ips", "request_bin": "distribution.request_sizes.histogram",
    "response_bin": "distribution.response_sizes.histogram",
}


def member_counts(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """``keys``, ``kind``, ``name``, ``part``, ``records``, ``bytes``: the counts that all members are made of."""
    f = Fields(records)
    good, client = ~f.is_bad(), f.client_ip()
    path, time = F.coalesce(f.filled("path"), F.lit("/")), f.timestamp()
    named = good & (client != "-")
    failed = is_failed_login(f.method(), path, f.status_or_200())
    width = ctx.histogram_bucket_size
    bin_of = lambda v: (F.floor(v / width) * width).cast("bigint").cast("string")
    none = F.lit(None).cast("string")
    kinds: dict[str, tuple[Column, Column, Column]] = {
        "level": (f.level().isNotNull(), f.level(), none),
        "code": (f.status().isNotNull(), f.status().cast("string"), none),
        "endpoint": (F.lit(True), f.endpoint(), none),
        "ip": (f.listed_ip().isNotNull(), f.listed_ip(), none),
        "second": (time.isNotNull(), F.unix_seconds(time).cast("string"), none),
        "request_bin": (f.request_size().isNotNull(), bin_of(f.request_size()), none),
        "response_bin": (f.response_size().isNotNull(), bin_of(f.response_size()), none),
        "probe": (good & F.coalesce(f.text("path"), F.lit("")).rlike(PROBE_PATHS), client, none),
        "failed": (named & time.isNotNull() & failed, client, none),
        "client_path": (named, client, F.coalesce(f.text("path"), F.lit(""))),
    }
    rows = [
        F.when(F.coalesce(use, F.lit(False)), F.struct(F.lit(kind).alias("kind"), name.alias("name"), part.alias("part")))
        for kind, (use, name, part) in kinds.items()
    ]
    return (
        records.select(*keys, F.coalesce(f.response_size(), F.lit(0)).alias("_bytes"), F.inline(F.array_compact(F.array(*rows))))
        .groupBy(*keys, "kind", "name", "part").agg(F.count(F.lit(1)).alias("records"), F.sum("_bytes").alias("bytes"))
    )


def bundle_members(counts: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """``keys``, ``member``, ``name``, ``value``, ``share``, ``rank`` from :func:`member_counts` (a written table: it is read for every member).

    ``rank`` numbers the entries of lists from 1. ``share`` is a percentage of all, for burst seconds the multiple of the average.
    """
    of = lambda kind: counts.where(F.col("kind") == kind)
    no_share, no_rank = F.lit(None).cast("double"), F.lit(None).cast("int")

    def rows(df: DataFrame, member: Column | str, value: str, share: Column = no_share, rank: Column = no_rank, name: Column = F.col("name")) -> DataFrame:
        title = F.lit(member) if isinstance(member, str) else member
        return df.select(
            *keys, title.alias("member"), name.alias("name"), F.col(value).cast("double").alias("value"), share.alias("share"),
            rank.cast("int").alias("rank"),
        )

    def first(df: DataFrame, by: str, n: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc(by), "name")
        return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)

    title = F.lit(None).cast("string")
    for kind, member in _PLAIN.items():
        title = F.when(F.col("kind") == kind, member).otherwise(title)
    start = F.col("name").cast("bigint")
    label = F.when(
        F.endswith("kind", F.lit("_bin")),
        F.concat_ws("-", "name", (start + (ctx.histogram_bucket_size - 1)).cast("string")),
    ).otherwise(F.col("name"))
    out = rows(counts.where(F.col("kind").isin(*_PLAIN)), title, "records", name=label)

    totals = of("endpoint").groupBy(*keys).agg(F.sum("records").alias("total"), F.sum("bytes").alias("total_bytes"))
    top = with_totals(first(of("endpoint"), "records", TOP_ENDPOINTS), totals, keys)
    out = out.unionByName(rows(top, "endpoint.top_endpoints", "records", percent(F.col("records"), F.col("total")), F.col("_rank")))
    top = with_totals(first(of("endpoint"), "bytes", TOP_ENDPOINTS), totals, keys)
    out = out.unionByName(rows(top, "bandwidth.top_bandwidth_endpoints", "bytes", percent(F.col("bytes"), F.col("total_bytes")), F.col("_rank")))
    out = out.unionByName(rows(first(of("ip"), "records", ctx.top_ips_limit), "distribution.top_ips", "records", rank=F.col("_rank")))
    seconds = with_totals(of("second"), totals, keys).withColumn("_average", F.col("total") / float(ctx.window_seconds))
    seconds = seconds.where(F.col("records") >= F.greatest(F.col("_average") * 3.0, F.lit(2.0)))
    when = F.date_format(F.timestamp_seconds(F.col("name").cast("bigint")), "yyyy-MM-dd HH:mm:ss")
    out = out.unionByName(rows(seconds, "traffic_burst.burst_windows", "records", ratio(F.col("records"), F.col("_average")), name=when))
    paths = of("client_path").groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("paths"))
    return out.unionByName(rows(paths, "security.enumeration.distinct_endpoints_per_ip", "paths"))
