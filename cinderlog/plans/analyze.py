"""The whole analysis: records to metrics, insights, incidents and health, per key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import Fields
from ..operators.context import AnalysisContext
from ..operators.grouping import Keys
from ..operators.incidents import (
    affected_ips, correlate_incidents, health_scores, incident_timeline,
)
from ..operators.metrics import metric_pieces
from ..operators.rules import BUILTIN_RULES, Rule, evaluate_rules, rules_table
from ..session import through_tables
from .plugins import builtin_tables, extra_metrics


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysis; all but ``affected_ips`` have a bounded number of rows per key."""

    metrics: DataFrame
    insights: DataFrame
    incidents: DataFrame
    timeline: DataFrame
    health: DataFrame
    affected_ips: DataFrame


def with_window(records: DataFrame, minutes: int = 60) -> DataFrame:
    """Records with ``window_start``, the start of their tumbling window, for use as a key.

    Records without a time, bad lines among them, come under NULL: a key like any other, so no record is missing from the results.
    """
    seconds = minutes * 60
    time = Fields(records).timestamp()
    return records.withColumn("window_start", F.timestamp_seconds(F.floor(F.unix_seconds(time) / seconds) * seconds))


def window_end(minutes: int) -> Column:
    return F.col("window_start") + F.expr(f"INTERVAL {int(minutes)} MINUTES")


def measure(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Long metric table, registered extra metrics included, written once.

    It has one small row set per key; what follows reads it several times.
    """
    tables = builtin_tables(records, keys, ctx)
    extra = [lambda df=df: df for df in extra_metrics(records, keys, ctx, tables)]
    return through_tables(records.sparkSession, metric_pieces(records, keys, ctx, tables.get("session")) + extra, "metrics")


def analyze(
    records: DataFrame,
    keys: Keys = [],
    ctx: AnalysisContext = AnalysisContext(),
    rules: tuple[Rule, ...] | list[Rule] = BUILTIN_RULES,
    at: Column | None = None,
) -> Analysis:
    """Run everything for every key. An empty rule list gives empty insights, incidents and full scores.

    ``at`` dates insights and incidents, over the key columns; the default is the time of the run.
    """
    spark = records.sparkSession
    stamp = at if at is not None else F.current_timestamp()
    long = measure(records, keys, ctx)
    insights = evaluate_rules(long, rules_table(spark, rules), keys)
    ips = affected_ips(records, keys)
    return Analysis(
        metrics=long,
        insights=insights,
        incidents=correlate_incidents(insights, long, keys, stamp, ips),
        timeline=incident_timeline(insights, keys, stamp),
        health=health_scores(long, insights, keys),
        affected_ips=ips,
    )


def insights_per_window(
    records: DataFrame,
    minutes: int = 60,
    keys: Keys = [],
    ctx: AnalysisContext | None = None,
    rules: tuple[Rule, ...] | list[Rule] = BUILTIN_RULES,
) -> DataFrame:
    """Rules evaluated for every key and tumbling window."""
    windowed = with_window(records, minutes)
    all_keys = [*keys, "window_start"]
    long = measure(windowed, all_keys, ctx or AnalysisContext(window_minutes=minutes))
    return evaluate_rules(long, rules_table(records.sparkSession, rules), all_keys)
