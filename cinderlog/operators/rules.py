"""Threshold rules as a join of the long metric table with a rule table."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .grouping import Keys

OPERATORS = ("gt", "lt", "gte", "lte", "eq")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    category: str
    severity: str
    selector: str
    operator: str
    threshold: float
    template: str
    weight: float = 1.0
    enabled: bool = True


RULE_SCHEMA = (
    "rule_id string, name string, category string, severity string, selector string, operator string, "
    "threshold double, template string, weight double, enabled boolean"
)

# The built-in rules.
BUILTIN_RULES = (
    Rule("high-latency-p99", "High P99 Latency", "performance", "high", "latency.p99_ms", "gt", 500.0,
         "P99 latency {value}ms exceeds {threshold}ms", 1.0),
    Rule("high-latency-p95", "High P95 Latency", "performance", "medium", "latency.p95_ms", "gt", 300.0,
         "P95 latency {value}ms exceeds {threshold}ms", 0.8),
    Rule("high-error-ratio", "High Error Ratio", "reliability", "high", "error.error_ratio", "gt", 0.05,
         "Error ratio {value} exceeds {threshold}", 1.0),
    Rule("high-5xx-rate", "High HTTP 5xx Rate", "reliability", "critical", "status.http_5xx_rate", "gt", 0.02,
         "HTTP 5xx rate {value} exceeds {threshold}", 1.2),
    Rule("traffic-burst", "Traffic Burst Detection", "traffic", "medium", "traffic_burst.is_bursting", "eq", 1.0,
         "Traffic burst anomaly detected (is_bursting={value})", 0.9),
    Rule("bandwidth-spike", "Bandwidth Spike", "traffic", "medium", "bandwidth.bytes_per_second", "gt", 10000.0,
         "Bandwidth throughput {value} B/s exceeds {threshold} B/s", 0.8),
    Rule("endpoint-overload", "Endpoint Overload", "traffic", "medium", "endpoint.top_endpoint_share", "gt", 50.0,
         "Top endpoint share {value}% exceeds {threshold}% of total traffic", 0.7),
    Rule("sec-bot-01", "Suspected Bot Activity", "security", "high",
         "security.bot_metrics.headless_fingerprints_count", "gt", 0.0,
         "Headless automated browser client footprint detected ({value} headless hits)", 1.0),
    Rule("sec-cs-02", "Credential Stuffing Attack", "security", "critical",
         "security.brute_force.lockout_candidates_count", "gt", 0.0,
         "Credential stuffing candidates identified ({value} accounts/IPs exceeding failed login threshold)", 1.0),
    Rule("sec-enum-03", "Directory Enumeration Scan", "security", "high",
         "security.enumeration.error_404_ratio", "gt", 10.0,
         "Abnormally high 404 response footprint ({value}% of total traffic)", 1.0),
    Rule("sec-scan-04", "Vulnerability Scanning Probe", "security", "high",
         "security.scanner_metrics.scanner_hits_count", "gt", 0.0,
         "Probes trying to locate admin panels, backups, or configs ({value} hits detected)", 1.0),
    Rule("sec-inj-05", "SQL Injection Attempt", "security", "critical",
         "security.injection_metrics.sql_injection_count", "gt", 0.0,
         "SQL query signature injection payloads detected in request URI/body ({value} hits)", 1.0),
    Rule("sec-inj-06", "XSS Injection Attempt", "security", "critical",
         "security.injection_metrics.xss_injection_count", "gt", 0.0,
         "Cross-Site Scripting signature payloads detected in request URI/body ({value} hits)", 1.0),
    Rule("sec-inj-07", "Path Traversal Attempt", "security", "critical",
         "security.injection_metrics.path_traversal_count", "gt", 0.0,
         "Directory path traversal escape payloads detected in request URI/body ({value} hits)", 1.0),
)

# Recommendations by category and severity.
RECOMMENDATIONS = (
    ("performance", "low", "Monitor latency trends over the next analysis window."),
    ("performance", "medium", "Review slow endpoints and consider query optimization."),
    ("performance", "high", "Investigate slow endpoints immediately — latency is impacting users."),
    ("performance", "critical", "Scale deployment immediately — critical latency detected."),
    ("reliability", "low", "Monitor error rates for upward trends."),
    ("reliability", "medium", "Investigate recurring errors in application logs."),
    ("reliability", "high", "Elevated error rate detected — review recent deployments."),
    ("reliability", "critical", "Critical failure rate — initiate incident response."),
    ("traffic", "low", "Traffic levels are slightly above normal."),
    ("traffic", "medium", "Traffic spike detected — verify auto-scaling is active."),
    ("traffic", "high", "Significant traffic surge — check load balancer health."),
    ("traffic", "critical", "Extreme traffic volume — possible DDoS or viral event."),
    ("security", "low", "Log the event for future auditing."),
    ("security", "medium", "Review access logs for suspicious patterns."),
    ("security", "high", "Block the offending source and alert the security team."),
    ("security", "critical", "Active attack detected — engage incident response immediately."),
)
DEFAULT_RECOMMENDATION = "Review the triggered metric and take appropriate action."


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] | list[Rule] = BUILTIN_RULES) -> DataFrame:
    """Rules as a table. An unknown operator is refused here."""
    for rule in rules:
        if rule.operator not in OPERATORS:
            raise ValueError(f"Unknown operator '{rule.operator}'. Valid operators: {list(OPERATORS)}")
    return spark.createDataFrame([astuple(r) for r in rules], RULE_SCHEMA)


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """Comparison by operator name; an unknown name fails the job."""
    return (
        F.when(operator == "gt", value > threshold)
        .when(operator == "lt", value < threshold)
        .when(operator == "gte", value >= threshold)
        .when(operator == "lte", value <= threshold)
        .when(operator == "eq", value == threshold)
        .otherwise(F.raise_error(F.concat(F.lit("Unknown operator "), operator)).cast("boolean"))
    )


def confidence(analyzed: Column, weight: Column) -> Column:
    """Weight scaled by the number of records, which counts in full from a hundred on."""
    sample = F.when(analyzed > 0, F.least(F.lit(1.0), analyzed / 100.0)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(sample * weight, 4)))


def number_text(value: Column) -> Column:
    """Two decimals without trailing zeros, but always one: 5.0, 0.05, 12.34."""
    text = F.format_string("%.2f", F.round(value, 2))
    return F.when(F.endswith(text, F.lit("0")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def evaluate_rules(
    long: DataFrame, rules: DataFrame, keys: Keys = [], recommendations: DataFrame | None = None
) -> DataFrame:
    """Insights: one row per key and enabled rule whose comparison holds.

    The number of records comes with the metrics (``metadata.analyzed_records``). The rule table is a
    local relation, so Spark knows its size and picks the join.
    """
    wide = long.groupBy(*keys).agg(
        F.max(F.when(F.col("selector") == "metadata.analyzed_records", F.col("value"))).alias("analyzed_records"),
        F.map_from_entries(F.collect_list(F.struct("selector", "value"))).alias("_values"),
    )
    # One bounded map per key (the fixed set of selectors): the record count travels with every value.
    values = wide.select(*keys, "analyzed_records", F.explode("_values").alias("selector", "value"))
    active = rules.where(F.coalesce("enabled", F.lit(True)))
    hit = values.join(active, "selector").where(
        compare(F.col("value"), F.col("operator"), F.col("threshold"))
    )
    texts = recommendations if recommendations is not None else recommendation_table(long.sparkSession)
    described = F.replace(
        F.replace(F.col("template"), F.lit("{value}"), number_text(F.col("value"))),
        F.lit("{threshold}"), number_text(F.col("threshold")),
    )
    return hit.join(texts, ["category", "severity"], "left").select(
        *keys, "rule_id", "name", "category", "severity",
        confidence(F.col("analyzed_records"), F.col("weight")).alias("confidence"),
        described.alias("description"),
        F.coalesce("recommendation", F.lit(DEFAULT_RECOMMENDATION)).alias("recommendation"),
        "selector",
        F.round("value", 4).alias("observed_value"),
        "threshold", "operator", "weight",
        F.round(F.least(F.lit(1.0), F.col("analyzed_records") / 100.0), 4).alias("sample_factor"),
    )


def recommendation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECOMMENDATIONS), "category string, severity string, recommendation string")


def insight_rollup(insights: DataFrame) -> DataFrame:
    """Triggered insights per rule, severity and category."""
    return insights.groupBy("rule_id", "severity", "category").agg(F.count(F.lit(1)).alias("triggered"))
