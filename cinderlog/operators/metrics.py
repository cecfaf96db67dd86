"""All measures per key: one long table of ``(keys, selector, value)`` and its wide form.

Everything that needs only the record itself comes out of one aggregate. Measures over endpoints, seconds
and sessions come from one further aggregate each. The pieces are stacked, not joined, so no key set and
no empty key set needs a cross join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import FUNNEL_STAGES, LATENCY_ALIASES, STAGES, Fields, is_error_level, journey_stage
from .context import AnalysisContext
from .grouping import Keys, ratio
from .quantiles import percentile_table
from .security import WATCHED_TARGETS, security_signals, tool_flags
from .sessions import session_rollup, sessions_with_paths
from .statistics import (
    LATENCY_PERCENTILES, SIZE_PERCENTILES, burst_verdict, endpoint_counts, requests_per_second,
)

# Selectors of single-record measures, in bundle order.
_FLAT = (
    "traffic.total_requests", "traffic.volume_bytes",
    "error.total_errors", "error.error_ratio",
    *[f"status.status_categories.{d}xx" for d in range(1, 6)], "status.http_5xx_rate",
    "latency.avg_ms", "latency.min_ms", "latency.max_ms",
    *[f"distribution.{w}_sizes.{s}" for w in ("request", "response") for s in ("count", "average", "minimum", "maximum")],
    "bandwidth.total_bytes_sent", "bandwidth.bytes_per_second",
    *[f"journey.stage_counts.{s}" for s in STAGES],
    "security.enumeration.error_404_ratio",
    "security.bot_metrics.missing_user_agent_count", "security.bot_metrics.headless_fingerprints_count",
    "security.scanner_metrics.scanner_hits_count",
    *[f"security.injection_metrics.{n}" for n in (
        "sql_injection_count", "xss_injection_count", "path_traversal_count", "rce_cmd_injection_count")],
    "metadata.analyzed_records", "metadata.skipped_records", "metadata.missing_latency_fields",
    "profile.nikto", "profile.playwright", "profile.go_http_client", "profile.curl",
    *[f"profile.target{i}" for i in range(len(WATCHED_TARGETS))],
)

PERCENTILE_SELECTORS = tuple(f"latency.{n}" for n in LATENCY_PERCENTILES) + tuple(
    f"distribution.{w}_sizes.{n}" for w in ("request", "response") for n in SIZE_PERCENTILES
)
BURST_SELECTORS = tuple(f"traffic_burst.{n}" for n in ("average_rps", "peak_rps", "burst_ratio", "is_bursting"))
SESSION_SELECTORS = tuple(f"session.{n}" for n in (
    "average_session_duration_seconds", "bounce_rate", "pages_per_session", "requests_per_session",
    "active_sessions_count", "longest_session_duration_seconds", "possible_bot_count",
    "credential_stuffing_count", "endpoint_enumeration_count",
))
BRUTE_FORCE_SELECTORS = tuple(f"security.brute_force.{n}" for n in (
    "failure_ratio", "lockout_candidates_count", "failing_ip_count",
))
SELECTORS = (
    _FLAT + ("endpoint.top_endpoint_share",) + PERCENTILE_SELECTORS + BURST_SELECTORS + SESSION_SELECTORS
    + tuple(f"journey.funnel.{s}" for s in FUNNEL_STAGES) + BRUTE_FORCE_SELECTORS
)


def record_signals(records: DataFrame, keys: Keys) -> DataFrame:
    """Per record, the inputs of every single-record measure, each computed once."""
    f = Fields(records)
    code = f.status()
    has_latency = F.lit(False)
    for name in LATENCY_ALIASES:
        has_latency = has_latency | f.present(name)
    agent = F.coalesce(f.text("user_agent"), F.lit(""))
    path = f.text("path")
    tools = tool_flags(agent)
    names = ("nikto", "playwright", "go_http_client", "curl")
    good = records.withColumn("_bad", f.is_bad())
    # Bad lines carry no signature; they still count in the totals.
    extra = {
        "bad": F.col("_bad"),
        "volume": f.volume(),
        "is_error": is_error_level(f.level()),
        "status_class": F.substring(code.cast("string"), 1, 1),
        "latency": f.latency(),
        "request_size": f.request_size(),
        "response_size": f.response_size(),
        "has_latency": has_latency,
        "stage": F.when(f.timestamp().isNotNull(), journey_stage(F.coalesce(f.filled("path"), F.lit("/")))),
        **{f"tool_{n}": F.coalesce(t, F.lit(False)) for n, t in zip(names, tools.values())},
        **{f"target{i}": F.coalesce(path == t, F.lit(False)) for i, t in enumerate(WATCHED_TARGETS)},
    }
    return security_signals(good.drop("parse_error"), keys, extra)


def flat_metrics(records: DataFrame, keys: Keys, ctx: AnalysisContext) -> DataFrame:
    """Every measure that needs only the record itself: one scan, one aggregate, one row per key."""
    total = F.count(F.lit(1))
    ok = ~F.col("bad")
    n_if = lambda c: F.count_if(ok & c)
    errors = F.count_if("is_error")
    digit = F.col("status_class")
    fives = F.count_if(digit == "5")
    sent = F.coalesce(F.sum("response_size"), F.lit(0))
    sizes = lambda c: [F.count(c), F.avg(c), F.min(c), F.max(c)]
    values = [
        total, F.coalesce(F.sum("volume"), F.lit(0)),
        errors, ratio(errors, total),
        *[F.count_if(digit == str(d)) for d in range(1, 6)], F.when(total > 0, fives / total),
        F.avg("latency"), F.min("latency"), F.max("latency"),
        *sizes("request_size"), *sizes("response_size"),
        sent, sent / ctx.window_seconds if ctx.window_seconds > 0 else F.lit(0.0),
        *[n_if(F.col("stage") == s) for s in STAGES],
        F.round(ratio(n_if(F.col("not_found")), total) * 100.0, 2),
        n_if(F.col("no_agent")), n_if(F.col("headless")), n_if(F.col("probe")),
        *[n_if(F.col(s)) for s in ("sqli", "xss", "traversal", "rce")],
        total, F.count_if("bad"), F.count_if(~F.col("has_latency")),
        *[F.count_if(f"tool_{n}") for n in ("nikto", "playwright", "go_http_client", "curl")],
        *[F.count_if(f"target{i}") for i in range(len(WATCHED_TARGETS))],
    ]
    return record_signals(records, keys).groupBy(*keys).agg(
        *[v.cast("double").alias(name) for name, v in zip(_FLAT, values, strict=True)]
    )


def to_long(df: DataFrame, keys: Keys, names: dict[str, str]) -> DataFrame:
    """Wide row to ``(keys, selector, value)`` rows; booleans become 1 and 0, NULLs are dropped.

    ``names`` maps columns to selectors.
    """
    pairs = [
        F.struct(F.lit(selector).alias("selector"), F.col(f"`{column}`").cast("double").alias("value"))
        for column, selector in names.items()
    ]
    return df.select(*keys, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def percentile_metrics(records: DataFrame, keys: Keys, ctx: AnalysisContext) -> DataFrame:
    """Percentiles of latency and both sizes as long rows: the three are ranked together, kind being a key."""
    f = Fields(records)
    kinds = {
        "latency": (f.latency(), LATENCY_PERCENTILES),
        "distribution.request_sizes": (f.request_size(), SIZE_PERCENTILES),
        "distribution.response_sizes": (f.response_size(), SIZE_PERCENTILES),
    }
    values = records.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("_value")) for kind, (value, _) in kinds.items()
    ]))).where(F.col("_value").isNotNull())
    table = percentile_table(values, [*keys, "kind"], F.col("_value"), LATENCY_PERCENTILES, ctx.percentiles)
    selectors = [
        F.struct(F.lit(kind).alias("kind"), F.lit(f"{kind}.{name}").alias("selector"), F.col(_column_of(p)).alias("value"))
        for kind, (_, wanted) in kinds.items() for name, p in wanted.items()
    ]
    return (
        table.select(*keys, "kind", F.explode(F.array(*selectors)).alias("_row"))
        .where(F.col("_row.kind") == F.col("kind"))
        .select(*keys, "_row.selector", "_row.value")
    )


def _column_of(percentile: float) -> str:
    return next(n for n, p in LATENCY_PERCENTILES.items() if p == percentile)


def metric_pieces(
    records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext(), session_table: DataFrame | None = None
) -> list[Callable[[], DataFrame]]:
    """The independent parts of ``metrics_long``, each a job of its own with the same three columns.

    ``session_table``: ``sessions_with_paths`` of the records where the caller has it already.
    """

    def flat() -> DataFrame:
        return to_long(flat_metrics(records, keys, ctx), keys, {c: c for c in _FLAT})

    def endpoints() -> DataFrame:
        share = F.max("requests") / F.sum("requests") * 100.0
        df = endpoint_counts(records, keys).groupBy(*keys).agg(share.alias("share"))
        return to_long(df, keys, {"share": "endpoint.top_endpoint_share"})

    def bursts() -> DataFrame:
        df = burst_verdict(requests_per_second(records, keys), keys, ctx)
        return to_long(df, keys, {s.rsplit(".", 1)[1]: s for s in BURST_SELECTORS})

    def sessions() -> DataFrame:
        names = {s.rsplit(".", 1)[1]: s for s in SESSION_SELECTORS + BRUTE_FORCE_SELECTORS}
        names |= {f"saw_{s.lower()}": f"journey.funnel.{s}" for s in FUNNEL_STAGES}
        table = sessions_with_paths(records, keys, ctx) if session_table is None else session_table
        return to_long(session_rollup(table, keys, ctx), keys, names)

    return [flat, sessions, lambda: percentile_metrics(records, keys, ctx), endpoints, bursts]


def metrics_long(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """All measures as ``(keys, selector, value)``.

    ``records`` is read several times: pass parsed records that were written once (``through_table``).
    """
    return reduce(DataFrame.unionByName, [piece() for piece in metric_pieces(records, keys, ctx)])


def metrics_wide(long: DataFrame, keys: Keys = [], selectors: tuple[str, ...] = SELECTORS) -> DataFrame:
    """One row per key with a column per selector: a grouped maximum, no join."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("selector") == s, F.col("value"))).alias(s) for s in selectors]
    )


def bundle(wide: DataFrame, keys: Keys = []) -> DataFrame:
    """Wide metrics as nested structs, one per analyzer."""
    tree: dict = {}
    for selector in [c for c in wide.columns if c not in keys]:
        node, parts = tree, selector.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = F.col(f"`{selector}`")

    def build(node) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return wide.select(*keys, *[build(v).alias(k) for k, v in tree.items() if isinstance(v, dict)])
