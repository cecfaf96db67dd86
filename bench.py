"""Headline timings. Prints one JSON line.

``BENCH_SF_DIR`` is the input folder, ``BENCH_CPUS`` the number of local cores. Lines are built and written
before the clock starts; every query is timed from planning to its last row. The first run of each query
in a fresh session pays for code generation, so each is run twice and the second time counts; the first
times are reported as ``cold``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cinderlog.operators.detection import detect, sample_head  # noqa: E402
from cinderlog.operators.parsing import parse_auto, parse_lines  # noqa: E402
from cinderlog.plans.analyze import analyze, measure, window_end  # noqa: E402
from cinderlog.session import local_session, through_table  # noqa: E402
from workload import load_all  # noqa: E402
from workload.demo_log import demo_lines, written_once  # noqa: E402
from workload.parsing_queries import mixed_lines  # noqa: E402
from workload.rule_queries import HOURLY, KEYS, hourly_records  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Copies of the derived log the parsers are timed on.
COPIES = 10
FORMATS = {
    "access": ("raw_access", "nginx"), "syslog_3164": ("raw_syslog3164", "syslog"), "syslog_5424": ("raw_syslog5424", "syslog"),
    "app": ("raw_django", "django"), "json": ("raw_json", "json"), "windows_csv": ("raw_win_csv", "windows"),
    "windows_xml": ("raw_win_xml", "windows"),
}
QUERIES = (
    "detect_format", "parse_auto", "stats_summary", "status_categories", "top_endpoints", "latency_percentiles", "size_histogram",
    "burst_summary", "timeline_series", "session_table", "session_metrics", "journeys", "injection_counts", "failed_logins_per_ip",
    "metrics_long", "evaluate_rules", "correlate_incidents", "health_scores",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> tuple[float, float]:
    times = []
    for _ in range(2):
        start = time.perf_counter()
        job()
        times.append(round(time.perf_counter() - start, 3))
    return times[0], times[1]


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    warm, cold, rates = {}, {}, {}

    for name, (raw, fmt) in FORMATS.items():
        copies = written_once(
            spark, SF_DIR, f"{raw}-x{COPIES}",
            # In enough files for all cores: the derived table is a single one.
            lambda: demo_lines(spark, SF_DIR, raw).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).repartition(2 * int(CPUS)),
        )
        lines = copies.count()
        key = f"parse_{name}_x{COPIES}"
        cold[key], warm[key] = timed(lambda: drain(parse_lines(copies, fmt, 2024)))
        rates[name] = round(lines / warm[key])

    mixed = written_once(
        spark, SF_DIR, f"mixed-x{COPIES}",
        lambda: mixed_lines(spark, SF_DIR).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).repartition(2 * int(CPUS)),
    )
    winners = through_table(detect(sample_head(mixed_lines(spark, SF_DIR)), year=2024), "winners")
    key = f"parse_auto_x{COPIES}"
    cold[key], warm[key] = timed(lambda: drain(parse_auto(mixed, winners, 2024)))
    rates["parse_auto"] = round(mixed.count() / warm[key])

    for name in QUERIES:
        cold[name], warm[name] = timed(lambda: drain(catalog.QUERIES[name](spark, SF_DIR)))

    records = hourly_records(spark, SF_DIR)
    records.count()
    cold["all_measures_per_hour"], warm["all_measures_per_hour"] = timed(lambda: measure(records, KEYS, HOURLY))
    flat = records.drop("window_start")
    cold["all_measures"], warm["all_measures"] = timed(lambda: measure(flat, [], HOURLY))
    rates["all_measures_records"] = round(flat.count() / warm["all_measures"])
    cold["analyze_to_health"], warm["analyze_to_health"] = timed(
        lambda: drain(analyze(records, KEYS, HOURLY, at=window_end(60)).health)
    )
    # One client owns a third of all requests.
    third = flat.withColumn("source_ip", F.when(F.col("line_id") % 3 == 0, F.lit("10.9.9.9")).otherwise(F.col("source_ip")))
    from cinderlog.operators.sessions import journey_steps, sessions_with_paths

    cold["sessions_hot_client"], warm["sessions_hot_client"] = timed(lambda: drain(sessions_with_paths(third)))
    cold["journeys_hot_client"], warm["journeys_hot_client"] = timed(lambda: drain(journey_steps(third)))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "sf": SF_DIR,
        "per_second": rates, "cold": cold, "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
