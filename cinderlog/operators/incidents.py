"""Insights to incidents and health scores, per key.

All inputs are small per key: the wide metric row and at most one insight per rule. Lists in a row are
bounded by the number of rules; addresses stay in a long table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import Fields, severity_rank
from .grouping import Keys, ranked_per_key
from .metrics import metrics_wide
from .security import PROBE_PATHS, WATCHED_TARGETS, TOOLS

# Capabilities, evidence, titles and recommendations.
BRUTE_FORCE = "Credential Stuffing / Brute Force"
DISCOVERY = "Admin & Sensitive File Discovery"
EMULATION = "Automated Browser Emulation"
ENUMERATION = "Endpoint Directory Enumeration"
PERFORMANCE_TITLE = "System Performance & Reliability Degradation"
DEFAULT_TOOLS, DEFAULT_CAPABILITIES, DEFAULT_TARGETS = (
    "Automated Script / Bot", "Web Probing", "General Web Endpoints",
)
TITLES = {
    BRUTE_FORCE: "Credential Stuffing & Authentication Attack Campaign",
    DISCOVERY: "Automated Reconnaissance & Probe Campaign",
    EMULATION: "Automated Bot Threat Campaign",
}
DEFAULT_TITLE = "Security Anomaly & Threat Incident"
EVIDENCE = {
    "headless": "[+] Headless browser fingerprint footprint detected",
    "probes": "[+] Sensitive probe paths (.env, wp-admin, config) accessed",
    "missing": ("[+] Abnormally high 404 response ratio (", "%)"),
    "logins": ("[+] Multiple failed authentication attempts (", " source IPs)"),
    "scanner": "[+] Known security scanner User-Agent (Nikto)",
    "latency": ("[+] High P99 Latency (", "ms)"),
    "errors": ("[+] Elevated error rate (", "%)"),
    "security": ("[+] ", " correlated security rule alerts co-occurring"),
    "performance": ("[+] ", " performance/reliability SLA threshold breaches"),
}
SECURITY_ADVICE = (
    "Enable strict rate-limiting on authentication and API probe endpoints",
    "Inspect web server access logs for unauthorized file access or data leakage",
    "Review WAF security rule thresholds and update blocklist",
)
PERFORMANCE_ADVICE = (
    "Inspect backend service logs for slow database queries or upstream API latency",
    "Verify auto-scaling policies and worker thread capacity",
    "Review error rate metrics per endpoint",
)


def incident_class(category: Column, rule_id: Column) -> Column:
    """``security`` or ``performance``; other traffic insights belong to neither."""
    return (
        F.when((category == "security") | ((category == "traffic") & F.contains(rule_id, F.lit("burst"))), "security")
        .when(category.isin("performance", "reliability"), "performance")
    )


def incident_groups(insights: DataFrame, keys: Keys = []) -> DataFrame:
    """At most two groups per key, with their rules and highest severity."""
    rank = F.min(severity_rank(F.col("severity")))
    return (
        insights.withColumn("incident_class", incident_class(F.col("category"), F.col("rule_id")))
        .where(F.col("incident_class").isNotNull())
        .groupBy(*keys, "incident_class")
        .agg(
            F.when(rank == 0, "CRITICAL").when(rank == 1, "HIGH").otherwise("MEDIUM").alias("severity"),
            F.count(F.lit(1)).alias("insight_count"),
            F.array_sort(F.collect_list("rule_id")).alias("rule_ids"),
        )
    )


def incident_id(kind: Column, at: Column, rule_ids: Column) -> Column:
    """Time (``untimed`` for the records without one) and a four-digit hash of the sorted rule ids."""
    prefix = F.when(kind == "security", F.lit("INC-")).otherwise(F.lit("INC-PERF-"))
    mark = F.upper(F.substring(F.md5(F.array_join(rule_ids, "").cast("binary")), 1, 4))
    return F.concat(prefix, F.coalesce(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("untimed")), F.lit("-"), mark)


def _m(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(0.0))


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.round(value, 1))


def capability_tests() -> dict[str, Column]:
    return {
        EMULATION: _m("security.bot_metrics.headless_fingerprints_count") > 0,
        DISCOVERY: _m("security.scanner_metrics.scanner_hits_count") > 0,
        ENUMERATION: _m("security.enumeration.error_404_ratio") > 0,
        BRUTE_FORCE: _m("security.brute_force.failing_ip_count") > 0,
    }


def _around(kind: str, text: Column) -> Column:
    before, after = EVIDENCE[kind]
    return F.concat(F.lit(before), text, F.lit(after))


def _lines_or_count(lines: Column, kind: str) -> Column:
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(_around(kind, F.col("insight_count").cast("string"))))


def security_evidence() -> Column:
    tests = capability_tests()
    failing = _m("security.brute_force.failing_ip_count").cast("bigint").cast("string")
    return _lines_or_count(F.array_compact(F.array(
        F.when(tests[EMULATION], F.lit(EVIDENCE["headless"])),
        F.when(tests[DISCOVERY], F.lit(EVIDENCE["probes"])),
        F.when(tests[ENUMERATION], _around("missing", _one_decimal(_m("security.enumeration.error_404_ratio")))),
        F.when(tests[BRUTE_FORCE], _around("logins", failing)),
        F.when(_m("profile.nikto") > 0, F.lit(EVIDENCE["scanner"])),
    )), "security")


def performance_evidence() -> Column:
    return _lines_or_count(F.array_compact(F.array(
        F.when(_m("latency.p99_ms") != 0, _around("latency", _one_decimal(_m("latency.p99_ms")))),
        F.when(_m("error.total_errors") > 0, _around("errors", _one_decimal(_m("error.error_ratio") * 100.0))),
    )), "performance")


def incident_title(kind: Column) -> Column:
    tests = capability_tests()
    out = F.when(kind == "performance", PERFORMANCE_TITLE)
    for capability, title in TITLES.items():
        out = out.when(tests[capability], title)
    return out.otherwise(DEFAULT_TITLE)


def _or_default(items: list[Column], default: str) -> Column:
    found = F.array_sort(F.array_compact(F.array(*items)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def correlate_incidents(
    insights: DataFrame, long: DataFrame, keys: Keys, at: Column, ips: DataFrame | None = None
) -> DataFrame:
    """Incidents with id, title, severity, confidence, evidence, threat profile and advice.

    ``at`` is the time the ids carry, over the key columns (the window end). The metric row and the
    insight groups are stacked and grouped by key, so there is no join and no cross join. ``ips`` is
    ``affected_ips``; its first three addresses go into the advice.
    """
    groups = incident_groups(insights, keys)
    parts = groups.select(
        *keys, F.struct("incident_class", "severity", "insight_count", "rule_ids").alias("_group")
    )
    wide = metrics_wide(long, keys)
    measures = [c for c in wide.columns if c not in keys]
    stacked = wide.select(*keys, F.struct(*[F.col(f"`{c}`") for c in measures]).alias("_metrics"))
    stacked = stacked.unionByName(parts, allowMissingColumns=True)
    first_ips = F.array().cast("array<string>")
    if ips is not None:
        three = ranked_per_key(ips, keys, [F.asc("ip")], 3).groupBy(*keys).agg(
            F.array_sort(F.collect_list("ip")).alias("_ips")
        )
        stacked = stacked.unionByName(three, allowMissingColumns=True)
        first_ips = F.coalesce("_ips", first_ips)
    per_key = stacked.groupBy(*keys).agg(
        F.first("_metrics", ignorenulls=True).alias("_metrics"),
        F.collect_list("_group").alias("_groups"),
        *([F.first("_ips", ignorenulls=True).alias("_ips")] if ips is not None else []),
    )
    rows = per_key.withColumn("_ips", first_ips).select(
        *keys, "_ips", "_metrics.*", F.inline("_groups")
    )
    kind = F.col("incident_class")
    tools = [
        F.when(_m(f"profile.{n}") > 0, F.lit(t))
        for n, t in zip(("nikto", "playwright", "go_http_client", "curl"), TOOLS)
    ]
    targets = [F.when(_m(f"profile.target{i}") > 0, F.lit(t)) for i, t in enumerate(WATCHED_TARGETS)]
    is_security = kind == "security"
    evidence = F.when(is_security, security_evidence()).otherwise(performance_evidence())
    block = F.when(
        F.size("_ips") > 0, F.concat(F.lit("Block offending IP address(es): "), F.array_join("_ips", ", "))
    ).otherwise(F.lit("Enforce WAF IP blocking rules"))
    advice = F.when(is_security, F.array(block, *[F.lit(a) for a in SECURITY_ADVICE])).otherwise(
        F.array(*[F.lit(a) for a in PERFORMANCE_ADVICE])
    )
    out = rows.withColumn("evidence", evidence)
    sure = F.when(
        is_security, F.least(F.lit(0.99), F.round(F.lit(0.70) + F.least(F.size("evidence"), F.lit(5)) * 0.05, 2))
    ).otherwise(F.lit(0.90))
    return out.select(
        *keys,
        "incident_class",
        incident_id(kind, at, F.col("rule_ids")).alias("incident_id"),
        incident_title(kind).alias("title"),
        "severity",
        sure.alias("confidence"),
        "insight_count",
        "rule_ids",
        "evidence",
        F.when(is_security, _or_default(tools, DEFAULT_TOOLS)).alias("suspected_tools"),
        F.when(
            is_security,
            _or_default([F.when(t, F.lit(c)) for c, t in capability_tests().items()], DEFAULT_CAPABILITIES),
        ).alias("capabilities"),
        F.when(is_security, _or_default(targets, DEFAULT_TARGETS)).alias("observed_targets"),
        F.when(is_security, F.col("severity")).alias("risk_level"),
        advice.alias("recommendations"),
    )


def affected_ips(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Distinct addresses of a security incident, long form: every record's, and the scanners'.

    Clients with paths or lockouts are records' clients already, but through more aliases. The records are read once.
    """
    f = Fields(records)
    good, client = ~f.is_bad(), f.client_ip()
    probing = good & F.coalesce(f.text("path"), F.lit("")).rlike(PROBE_PATHS)
    ips = F.array(f.first_filled("source_ip", "ip"), F.when(good & (client != "-"), client), F.when(probing, client))
    return records.select(*keys, F.explode(F.array_distinct(F.array_compact(ips))).alias("ip")).distinct()


def incident_timeline(insights: DataFrame, keys: Keys, at: Column) -> DataFrame:
    """Insights of incidents as events: time, type (rule id up to the first dash), severity, text."""
    return (
        insights.withColumn("incident_class", incident_class(F.col("category"), F.col("rule_id")))
        .where(F.col("incident_class").isNotNull())
        .select(
            *keys, "incident_class", "rule_id",
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.substring_index("rule_id", "-", 1).alias("event_type"),
            "description",
            F.upper("severity").alias("severity"),
        )
    )


def incident_rollup(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity", F.col("incident_class").alias("category")).agg(
        F.count(F.lit(1)).alias("incidents")
    )


# -- health --------------------------------------------------------------------------------------------

# Status bounds, weights of the overall score, and summaries by status.
HEALTHY_FROM, WARNING_FROM = 85, 60
OVERALL_WEIGHTS = {"security": 0.35, "reliability": 0.30, "performance": 0.20, "traffic": 0.15}
SUMMARIES = {
    "security": (
        "No active security threats or scanner probes detected.",
        "Security probes or automated bot traffic detected ({n} incidents).",
        "Active high-severity security threat campaign underway ({n} incidents).",
    ),
    "reliability": (
        "Optimal service reliability; error ratios within nominal thresholds.",
        "Elevated HTTP error ratios or 5xx server responses observed.",
        "Severe service disruption or high 5xx error rate breach.",
    ),
    "performance": (
        "Response latency SLAs met (P95 < 300ms, P99 < 500ms).",
        "Response latency degradation observed on key routes.",
        "High latency breach impacting user experience.",
    ),
    "traffic": (
        "Traffic throughput and request distributions stable.",
        "Traffic burst anomaly or bandwidth spike detected.",
        "Extreme traffic volume or endpoint overload detected.",
    ),
}
_HEALTH_INPUTS = (
    "status.http_5xx_rate", "error.error_ratio", "latency.p99_ms", "latency.p95_ms", "traffic_burst.is_bursting",
)


def health_status(score: Column) -> Column:
    return F.when(score >= HEALTHY_FROM, "HEALTHY").when(score >= WARNING_FROM, "WARNING").otherwise("CRITICAL")


def health_scores(long: DataFrame, insights: DataFrame, keys: Keys = []) -> DataFrame:
    """Four scores from 0 to 100 and the overall score, one row per key.

    Insight counts and incident penalties are stacked onto the metrics as further values and read in one
    grouped pass.
    """
    counts = insights.groupBy(*keys, "category").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        *keys, F.concat(F.lit("insights."), F.col("category")).alias("selector"), "value"
    )
    severity = F.col("severity")
    penalty = F.when(severity == "CRITICAL", 40.0).when(severity == "HIGH", 25.0).otherwise(15.0)
    incidents = incident_groups(insights, keys).where(F.col("incident_class") == "security").select(
        *keys, F.lit("incidents.security").alias("selector"), penalty.alias("value")
    )
    names = _HEALTH_INPUTS + tuple(f"insights.{c}" for c in OVERALL_WEIGHTS) + ("incidents.security",)
    inputs = long.where(F.col("selector").isin(*_HEALTH_INPUTS, "metadata.analyzed_records"))
    w = metrics_wide(inputs.unionByName(counts).unionByName(incidents), keys, names)
    base = {
        "security": 100 - _m("incidents.security") - _m("insights.security") * 5,
        "reliability": 100
        - F.when(_m("status.http_5xx_rate") > 0.05, 40).when(_m("status.http_5xx_rate") > 0.02, 20).otherwise(0)
        - F.when(_m("error.error_ratio") > 0.10, 30).when(_m("error.error_ratio") > 0.05, 15).otherwise(0)
        - _m("insights.reliability") * 10,
        "performance": 100
        - F.when(_m("latency.p99_ms") > 1000, 40).when(_m("latency.p99_ms") > 500, 25).otherwise(0)
        - F.when(_m("latency.p95_ms") > 300, 15).otherwise(0)
        - _m("insights.performance") * 10,
        "traffic": 100 - F.when(_m("traffic_burst.is_bursting") == 1, 20).otherwise(0) - _m("insights.traffic") * 10,
    }
    scored = w.select(
        *keys,
        F.when(_m("incidents.security") > 0, 1).otherwise(0).alias("_n"),
        *[F.greatest(F.lit(0), F.least(F.lit(100), s)).cast("bigint").alias(f"{d}_score") for d, s in base.items()],
    )
    weighted = [F.col(f"{d}_score") * F.lit(v).cast("double") for d, v in OVERALL_WEIGHTS.items()]
    average = F.floor(sum(weighted[1:], weighted[0]))
    overall = F.least(average, F.col("security_score"), F.col("reliability_score")).cast("bigint")
    scored = scored.withColumn("overall_score", overall)
    out = []
    for domain, texts in SUMMARIES.items():
        score = F.col(f"{domain}_score")
        healthy, warning, critical = [F.replace(F.lit(t), F.lit("{n}"), F.col("_n").cast("string")) for t in texts]
        out += [
            score,
            health_status(score).alias(f"{domain}_status"),
            F.when(score >= HEALTHY_FROM, healthy).when(score >= WARNING_FROM, warning).otherwise(critical)
            .alias(f"{domain}_summary"),
        ]
    return scored.select(*keys, "overall_score", health_status(F.col("overall_score")).alias("status"), *out)


# -- diagnosis -----------------------------------------------------------------------------------------

# Headline and remediation title by finding.
DIAGNOSES = (
    ("sqli", "CRITICAL: SQL Injection Attempts Detected", "Enforce Input Sanitization / WAF Rules"),
    ("brute_force", "HIGH: Brute-Force Login Attacks Detected", "Enable Fail2Ban / IP Rate Limiting"),
    ("scanner", "MEDIUM: Active Vulnerability Scans Identified", "Block Scanner / Prober IPs"),
    ("errors", "WARN: High Error Rates on Endpoints", "Investigate Database Latency"),
    ("latency", "INFO: Performance Latency Warning", "Index Endpoint Query Parameters"),
    ("healthy", "HEALTHY: No Operational Anomalies Detected", "Enable Continuous Monitoring"),
)


def diagnosis(long: DataFrame, keys: Keys = []) -> DataFrame:
    """First finding that applies, with its headline and remediation title."""
    w = metrics_wide(long, keys)
    tests = {
        "sqli": _m("security.injection_metrics.sql_injection_count") > 0,
        "brute_force": _m("security.brute_force.failing_ip_count") > 0,
        "scanner": _m("security.scanner_metrics.scanner_hits_count") > 0,
        "errors": _m("error.error_ratio") > 0.05,
        "latency": _m("latency.avg_ms") > 400,
        "healthy": F.lit(True),
    }

    def pick(index: int) -> Column:
        out = F.lit(None).cast("string")
        for row in reversed(DIAGNOSES):
            out = F.when(tests[row[0]], F.lit(row[index])).otherwise(out)
        return out

    return w.select(*keys, pick(0).alias("finding"), pick(1).alias("summary"), pick(2).alias("remediation"))
