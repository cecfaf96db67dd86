"""Rules over closed windows of a stream, with the values a batch analysis of the window gives.

State holds counts that can be merged, by window, kind and key: one row of sums for the window itself, and counts per second, per
endpoint, per latency value, and per client and session slot. They are combined in each task before the shuffle, and a window's rows are
let out together once the watermark passes its end. The batch expressions make percentiles, peaks, shares and sessions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import Fields
from ..operators.context import AnalysisContext
from ..operators.grouping import ratio
from ..operators.metrics import BURST_SELECTORS, record_signals, to_long
from ..operators.quantiles import percentiles_of_counts
from ..operators.rules import BUILTIN_RULES, Rule, evaluate_rules, rules_table
from ..operators.sessions import is_failed_login, number_sessions, slot_of
from ..operators.statistics import LATENCY_PERCENTILES, burst_verdict
from .jobs import WATERMARK, run_chunks

KEYS = ["window_start"]
#: Sums of the row of a window, by name, over the signals of a record.
_SUMS = {
    "errors": "is_error", "fives": "status_class = '5'", "not_found": "NOT bad AND not_found", "headless": "NOT bad AND headless",
    "probe": "NOT bad AND probe", "sqli": "NOT bad AND sqli", "xss": "NOT bad AND xss", "traversal": "NOT bad AND traversal",
}
_FACTS = (
    "window_start timestamp, kind string, name string, slot bigint, number bigint, first timestamp, last timestamp, bytes bigint, "
    "failed bigint, " + ", ".join(f"{n} bigint" for n in _SUMS)
)


def window_facts(records: DataFrame, ctx: AnalysisContext = AnalysisContext(), watermark: str = WATERMARK) -> DataFrame:
    """Mergeable counts of every closed window of ``ctx.window_minutes``: ``window_start, kind, name, slot`` and sums.

    Kinds: ``window`` (no name), ``second``, ``endpoint``, ``latency`` (the value) and ``client`` (address and session slot). Records
    without a time belong to no window.
    """
    f = Fields(records)
    failed = is_failed_login(f.method(), F.coalesce(f.filled("path"), F.lit("/")), f.status_or_200())
    timed = (
        records.withColumns({"_time": f.timestamp(), "_endpoint": f.endpoint(), "_failed": failed})
        .where(F.col("_time").isNotNull()).withWatermark("_time", watermark)
    )
    signals = record_signals(timed, ["_time", "_endpoint", "_failed"])
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    is_named = ~F.col("bad") & (F.col("client_ip") != "-")
    kinds = {
        "window": (F.lit(True), none, zero),
        "second": (F.lit(True), F.unix_seconds("_time").cast("string"), zero),
        "endpoint": (F.lit(True), F.col("_endpoint"), zero),
        "latency": (F.col("latency").isNotNull(), F.col("latency").cast("string"), zero),
        "client": (is_named, F.col("client_ip"), slot_of(F.col("_time"), ctx.session_gap_seconds)),
    }
    rows = [F.when(use, F.struct(F.lit(k).alias("kind"), name.alias("name"), slot.alias("slot"))) for k, (use, name, slot) in kinds.items()]
    wide = signals.select(
        "_time", F.coalesce("response_size", F.lit(0)).alias("_bytes"), F.coalesce("_failed", F.lit(False)).alias("_failed"),
        *[F.coalesce(F.expr(c), F.lit(False)).alias(f"_{n}") for n, c in _SUMS.items()], F.inline(F.array_compact(F.array(*rows))),
    )
    return (
        wide.groupBy(F.window("_time", f"{int(ctx.window_minutes)} minutes"), "kind", "name", "slot")
        .agg(
            F.count(F.lit(1)).alias("number"), F.min("_time").alias("first"), F.max("_time").alias("last"),
            F.sum("_bytes").alias("bytes"), F.count_if("_failed").alias("failed"), *[F.count_if(f"_{n}").alias(n) for n in _SUMS],
        )
        .select(F.col("window.start").alias("window_start"), "kind", "name", "slot", "number", "first", "last", "bytes", "failed", *_SUMS)
    )


def fact_values(facts: DataFrame, ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """``window_start, selector, value`` of the windows, as the batch measures give them, from their facts (a written table)."""
    of = lambda kind: facts.where(F.col("kind") == kind)
    share = lambda name: F.col(name) / F.col("number")
    flat = {
        "metadata.analyzed_records": F.col("number"),
        "traffic.total_requests": F.col("number"),
        "error.total_errors": F.col("errors"),
        "error.error_ratio": share("errors"),
        "status.http_5xx_rate": share("fives"),
        "bandwidth.total_bytes_sent": F.col("bytes"),
        "bandwidth.bytes_per_second": F.col("bytes") / ctx.window_seconds,
        "security.enumeration.error_404_ratio": F.round(ratio(F.col("not_found"), F.col("number")) * 100.0, 2),
        "security.bot_metrics.headless_fingerprints_count": F.col("headless"),
        "security.scanner_metrics.scanner_hits_count": F.col("probe"),
        "security.injection_metrics.sql_injection_count": F.col("sqli"),
        "security.injection_metrics.xss_injection_count": F.col("xss"),
        "security.injection_metrics.path_traversal_count": F.col("traversal"),
    }
    windows = of("window").select(*KEYS, *[c.cast("double").alias(n) for n, c in flat.items()])
    latency = of("latency").select(*KEYS, F.col("name").cast("double").alias("_v"), F.col("number").alias("_n"))
    percentiles = percentiles_of_counts(latency, KEYS, LATENCY_PERCENTILES)
    seconds = of("second").select(*KEYS, F.col("name").alias("second"), F.col("number").alias("requests"))
    bursts = burst_verdict(seconds, KEYS, ctx)
    top = of("endpoint").groupBy(*KEYS).agg((F.max("number") / F.sum("number") * 100.0).alias("share"))
    slots = of("client").select(
        *KEYS, F.col("name").alias("client_ip"), "slot", F.col("first").alias("start_time"), F.col("last").alias("end_time"), "failed"
    )
    sessions = number_sessions(slots, KEYS, ctx.session_gap_seconds).groupBy(*KEYS, "client_ip", "session_index").agg(F.sum("failed").alias("failed"))
    clients = sessions.groupBy(*KEYS, "client_ip").agg(F.max("failed").alias("most"), F.sum("failed").alias("failed"))
    # Windows without a named client have no candidates, which is a value as well.
    locked = of("window").select(*KEYS, F.lit(None).cast("bigint").alias("most"), F.lit(None).cast("bigint").alias("failed")).unionByName(
        clients.drop("client_ip")
    ).groupBy(*KEYS).agg(
        F.count_if(F.col("most") > ctx.failed_logins).alias("locked"), F.count_if(F.col("failed") > 0).alias("failing")
    )
    pieces = [
        to_long(windows, KEYS, {n: n for n in flat}),
        to_long(percentiles, KEYS, {n: f"latency.{n}" for n in LATENCY_PERCENTILES}),
        to_long(bursts, KEYS, {s.rsplit(".", 1)[1]: s for s in BURST_SELECTORS}),
        to_long(top, KEYS, {"share": "endpoint.top_endpoint_share"}),
        to_long(locked, KEYS, {"locked": "security.brute_force.lockout_candidates_count", "failing": "security.brute_force.failing_ip_count"}),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def run_window_rules(
    facts: DataFrame,
    out: str,
    checkpoint: str,
    rules: tuple[Rule, ...] | list[Rule] = BUILTIN_RULES,
    ctx: AnalysisContext = AnalysisContext(),
) -> StreamingQuery:
    """Insights of every closed window below ``out/insights``, its facts below ``out/facts``; a folder per micro-batch.

    All built-in rules get their value. A batch that is handed over again after a failure replaces its own folders.
    """

    def handle(chunk: DataFrame, number: int) -> None:
        spark, path = chunk.sparkSession, f"{out}/facts/chunk={number}"
        chunk.write.mode("overwrite").parquet(path)
        closed = spark.read.schema(_FACTS).parquet(path)
        insights = evaluate_rules(fact_values(closed, ctx), rules_table(spark, rules), KEYS)
        insights.write.mode("overwrite").parquet(f"{out}/insights/chunk={number}")

    return run_chunks(facts, handle, checkpoint)
