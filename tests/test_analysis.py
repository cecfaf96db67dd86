import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.operators import incidents, metrics, rules, security, sessions, statistics as st
from cinderlog.operators.context import AnalysisContext
from cinderlog.operators.parsing import parse_lines
from cinderlog.operators.quantiles import exact_percentiles
from cinderlog.plans.analyze import analyze, measure, window_end, with_window
from cinderlog.plans.plugins import metric_order, register_metric, unregister_metric

T0 = datetime(2031, 3, 9, 22, 40)


@pytest.fixture(scope="module")
def records(spark):
    """Records from dictionaries, each value kept under its own type."""

    def build(rows, schema):
        rows = [{"line_id": i, **r} for i, r in enumerate(rows)]
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in ["line_id", *names]) for r in rows], "line_id long, " + schema)

    return build


def test_volume_takes_the_first_size_that_counts(records):
    rows = [{"size": 7}, {"bytes_sent": "1200"}, {"size": 0, "bytes_sent": "31"}, {"raw": "twelve bytes"}, {"message": "größer"}, {"size": 0, "raw": "ab"}, {}]
    df = records(rows, "size long, bytes_sent string, raw string, message string")
    row = st.traffic_volume(df).first()
    assert (row.total_requests, row.volume_bytes) == (7, 7 + 1200 + 31 + 12 + 6 + 2 + 0)


def test_levels_and_codes(records):
    levels = ["fatal", " Critical ", "error", "notice", "debug", "debug", None, "trace"]
    df = records([{"level": v} for v in levels], "level string")
    found = {r.level: r.records for r in st.error_levels(df).collect()}
    wrong = sum(n for v, n in found.items() if v in ("FATAL", "CRITICAL", "ERROR"))
    assert found["DEBUG"] == 2 and sum(found.values()) == 7
    assert tuple(st.error_summary(df).first()) == (wrong, wrong / 8)
    df = records([{"status_code": c} for c in (101, 204, 206, 301, 418, 418, 599)] + [{"status": "502"}, {"status": "teapot"}], "status_code int, status string")
    assert {r.status_code: r.records for r in st.status_codes(df).collect()} == {101: 1, 204: 1, 206: 1, 301: 1, 418: 2, 599: 1, 502: 1}
    assert tuple(st.status_categories(df).first()) == (1, 2, 1, 2, 2, 2 / 9)


def test_latency_sizes_and_bandwidth(records):
    values = [13.0, 8.5, 1999.0, 77.25, 42.0, 0.125]
    df = records([{"duration": str(v)} if i % 2 else {"time_taken": v} for i, v in enumerate(values)] + [{"duration": "soon"}], "duration string, time_taken double")
    assert list(st.latency_percentiles(df).first()) == pytest.approx(list(np.percentile(values, [50, 90, 95, 99])))
    assert tuple(st.latency_range(df).first()) == pytest.approx((np.mean(values), 0.125, 1999.0))
    sizes = [64, 2048, 4095, 4096, 99]
    df = records([{"size": n, "path": "/big" if n > 1000 else "/small"} for n in sizes], "size long, path string")
    assert tuple(st.size_range(df).first()) == (5, sum(sizes) / 5, 64, 4096)
    assert {r.bin: r.records for r in st.size_histogram(df, width=1024).collect()} == {"0-1023": 2, "2048-3071": 1, "3072-4095": 1, "4096-5119": 1}
    assert tuple(st.bandwidth_summary(df, ctx=AnalysisContext(window_minutes=2)).first()) == (sum(sizes), sum(sizes) / 120)
    top = st.top_bandwidth_endpoints(df).orderBy(F.desc("bytes_sent")).collect()
    assert [(r.endpoint, r.bytes_sent) for r in top] == [("/big", 2048 + 4095 + 4096), ("/small", 163)]
    assert top[0].percentage == pytest.approx(100 * 10239 / sum(sizes))


def test_exact_percentiles_against_brute_force(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(3, 2, 3000), -rng.exponential(50, 500), np.full(1500, 42.0)])
    df = spark.createDataFrame([(int(i % 3 == 0), float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {r.g: (r.a, r.b, r.c) for r in exact_percentiles(df, ["g"], F.col("v"), {"a": 0.0, "b": 37.5, "c": 99.9}).collect()}
    for g in (0, 1):
        part = np.array([v for i, v in enumerate(values) if int(i % 3 == 0) == g])
        assert got[g] == pytest.approx(tuple(np.percentile(part, [0, 37.5, 99.9])))


def test_bursts(records):
    minute = AnalysisContext(window_minutes=1)
    quiet = [{"timestamp": T0 + timedelta(seconds=3 * i)} for i in range(20)]
    row = st.burst_summary(records([*quiet, {}, {}], "timestamp timestamp"), ctx=minute).first()
    assert (row.average_rps, row.peak_rps, row.is_bursting) == (22 / 60, 1.0, False)
    rush = quiet + [{"timestamp": T0 + timedelta(seconds=31, milliseconds=40 * i)} for i in range(12)]
    df = records(rush, "timestamp timestamp")
    row = st.burst_summary(df, ctx=minute).first()
    assert (row.peak_rps, row.is_bursting) == (12.0, True) and row.burst_ratio == pytest.approx(12 / (32 / 60))
    assert [(r.second, r.requests_per_second) for r in st.burst_windows(df, ctx=minute).collect()] == [(T0 + timedelta(seconds=31), 12.0)]


def visits(records, rows):
    return records(rows, "source_ip string, timestamp timestamp, method string, path string, status_code int, parse_error boolean")


def test_sessions(records):
    at = lambda m, s=0: T0 + timedelta(minutes=m, seconds=s)
    long = [{"source_ip": "10.7.0.1", "timestamp": at(m)} for m in (0, 29, 58, 87, 150)]
    short = [{"source_ip": "10.7.0.2", "timestamp": at(3, s)} for s in (0, 10)]
    row = sessions.session_metrics(sessions.sessions_with_paths(visits(records, long + short))).first()
    assert (row.active_sessions_count, row.longest_session_duration_seconds, row.bounce_rate, row.requests_per_session) == (3, 87 * 60.0, 33.33, 2.33)
    # A gap of exactly the limit does not split; unnamed requests and bad lines stand apart.
    df = visits(records, [{"source_ip": "10.7.0.3", "timestamp": at(5)}, {"source_ip": "10.7.0.3", "timestamp": at(35)},
                          {"source_ip": "10.7.0.3", "timestamp": at(65, 1)}, {"source_ip": "-", "timestamp": at(5)}, {"timestamp": at(5)},
                          {"source_ip": "10.7.0.4", "timestamp": at(5), "parse_error": True}, {"source_ip": "10.7.0.5"}])
    got = {r.session_id: r.request_count for r in sessions.session_table(df).collect()}
    assert got == {"session_10_7_0_3_0": 2, "session_10_7_0_3_1": 1, "session_anon_3": 1, "session_anon_4": 1}


def test_sessions_against_brute_force(spark):
    import random

    random.seed(3)
    rows = [(i, random.choice(["a", "a", "a", "b", "c"]), T0 + timedelta(seconds=random.randrange(0, 400_000, 7)), random.choice(["/", "/cart", "/pay", "/x"]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "line_id long, source_ip string, timestamp timestamp, path string")
    expected, steps = {}, {}
    for ip in "abc":
        index, last, key = 0, None, None
        for i, _, t, path in sorted((r for r in rows if r[1] == ip), key=lambda r: (r[2], r[0])):
            if last is not None and (t - last).total_seconds() > 1800:
                index += 1
            last, key = t, f"session_{ip}_{index}"
            expected[i] = key
            stage = {"/": "Landing", "/cart": "Cart", "/pay": "Checkout", "/x": "Other"}[path]
            if not steps.get(key) or steps[key][-1] != stage:
                steps.setdefault(key, []).append(stage)
    assert {r.line_id: r.session_id for r in sessions.session_requests(df).collect()} == expected
    for often in (sessions.OFTEN, 2):
        got = {}
        for r in sessions.journey_steps(df, often=often).orderBy("session_id", "step").collect():
            got.setdefault(r.session_id, []).append(r.stage)
            assert len(got[r.session_id]) == r.step
        assert got == steps


def test_busy_minute_of_one_client(spark, monkeypatch):
    """All requests within one minute, many at the same time: cut into stretches, with the journey of a whole ordering."""
    monkeypatch.setattr(sessions, "_LINES", 64)
    paths = ["/", "/cart", "/pay", "/x"]
    df = spark.range(3000).select(
        F.col("id").alias("line_id"), F.lit("c").alias("source_ip"), F.element_at(F.array(*map(F.lit, paths)), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("path"),
        F.timestamp_micros(F.lit(1_900_000_020_000_000) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)) * 1_000_000 + F.when(F.col("id") % 3 == 0, F.col("id") * 7 % 20_000).otherwise(0)).alias("timestamp"),
    )
    stage = dict(zip(paths, ("Landing", "Cart", "Checkout", "Other")))
    want = []
    for r in df.orderBy("timestamp", "line_id").collect():
        if not want or want[-1] != stage[r.path]:
            want.append(stage[r.path])
    for often in (10, sessions.OFTEN):
        got = sessions.journey_steps(df, often=often).orderBy("step").collect()
        assert [r.stage for r in got] == want and [r.step for r in got] == list(range(1, len(want) + 1))


def test_behaviour_and_brute_force(records):
    ctx = AnalysisContext(failed_logins=4, bot_requests=30, distinct_paths=6)
    eager = [{"source_ip": "10.8.0.1", "timestamp": T0 + timedelta(minutes=i), "path": "/feed"} for i in range(31)]
    guesses = [{"source_ip": "10.8.0.2", "timestamp": T0 + timedelta(minutes=2 * i), "method": "POST", "path": "/signin", "status_code": c}
               for i, c in enumerate((403, 422, 200, 401, 500, 429))]
    walker = [{"source_ip": "10.8.0.3", "timestamp": T0 + timedelta(minutes=i), "path": f"/room/{i}"} for i in range(7)]
    table = sessions.sessions_with_paths(visits(records, eager + guesses + walker), ctx=ctx)
    row = sessions.session_metrics(table, ctx=ctx).first()
    assert (row.possible_bot_count, row.credential_stuffing_count, row.endpoint_enumeration_count) == (1, 1, 1)
    assert [tuple(r) for r in security.failed_logins_per_ip(table).collect()] == [("10.8.0.2", 5)]
    assert [r.client_ip for r in security.lockout_candidates(table, ctx=ctx).collect()] == ["10.8.0.2"]
    assert security.login_failure_ratio(table).first().failure_ratio == 83.33


def test_security_signatures(records):
    df = records([
        {"path": "/find?k=7%20union%20all%20select%20name", "user_agent": "Browser 3"}, {"path": "/find?k=or%201%3D1", "user_agent": "Browser 3"},
        {"path": "/note?t=%3Csvg%20onload%20=%20go()%3E", "user_agent": "Browser 3"}, {"path": "/file?f=..%2F..%2Fkeys", "user_agent": "Browser 3"},
        {"path": "/run?x=base64", "user_agent": "-"}, {"path": "/backup.zip", "status_code": 404, "user_agent": "Selenium grid"},
        {"path": "/reunion selected works"}, {"path": "/für?q=UNİON"},
    ], "path string, user_agent string, status_code int")
    assert tuple(security.injection_counts(df).first()) == (3, 1, 1, 1)  # the pattern knows no word borders
    assert tuple(security.bot_user_agents(df).first()) == (3, 1)
    assert security.error_404_ratio(df).first()[0] == 12.5 and security.scanner_hits(df).first().hits == 1


def test_rules_and_text(spark, records):
    long = spark.createDataFrame([("metadata.analyzed_records", 10.0), ("error.error_ratio", 0.08), ("x", 5.0)], "selector string, value double")
    table = rules.rules_table(spark, [*rules.BUILTIN_RULES, rules.Rule("x1", "X", "other", "low", "x", "lte", 5.0, "{value} at most {threshold}"),
                                      rules.Rule("x2", "X", "other", "low", "x", "eq", 5.0, "", enabled=False)])
    got = {r.rule_id: r for r in rules.evaluate_rules(long, table).collect()}
    assert set(got) == {"high-error-ratio", "x1"}
    assert got["high-error-ratio"].description == "Error ratio 0.08 exceeds 0.05" and got["high-error-ratio"].confidence == 0.1
    assert got["x1"].description == "5.0 at most 5.0" and got["x1"].recommendation == rules.DEFAULT_RECOMMENDATION
    with pytest.raises(ValueError, match="Unknown operator"):
        rules.rules_table(spark, [rules.Rule("b", "B", "c", "low", "x", "ne", 1.0, "")])


def access_line(ip, path, status, agent, second):
    return f'{ip} - - [09/Mar/2031:22:40:{second:02d} +0000] "GET {path} HTTP/1.1" {status} 77 "-" "{agent}"'


def test_analysis_end_to_end(lines):
    agents = ["curl/9.1", "Nikto/3.0", "Go-http-client/3"]
    paths = ["/phpinfo", "/x?q=union%20select%20a", "/cgi-bin/y", "/gone", "/gone/too", "/.git"]
    text = [access_line("198.51.100.9", p, 404, agents[i % 3], i) for i, p in enumerate(paths)]
    result = analyze(parse_lines(lines(*text, access_line("198.51.100.10", "/", 200, "Browser 3", 9)), "nginx"))
    incident = result.incidents.where("incident_class = 'security'").first()
    assert incident.incident_id.startswith("INC-") and incident.severity == "CRITICAL"
    assert set(incident.suspected_tools) == {"Nikto", "curl", "Go-http-client"}
    assert any("Nikto" in e for e in incident.evidence) and incident.recommendations[0].startswith("Block offending IP")
    assert {r.ip for r in result.affected_ips.collect()} == {"198.51.100.9", "198.51.100.10"}
    health = result.health.first()
    assert health.overall_score < 100 and health.security_score < 100 and health.traffic_status in ("HEALTHY", "WARNING")
    assert result.timeline.count() >= 2


def test_windows_keep_records_without_a_time(lines):
    text = [access_line("198.51.100.9", "/a", 200, "Browser 3", 1), "no time in this line", "nor in this one"]
    result = analyze(with_window(parse_lines(lines(*text), "nginx"), 60), ["window_start"], at=window_end(60))
    found = {(r.window_start, r.selector): r.value for r in result.metrics.collect()}
    hour = datetime(2031, 3, 9, 22)
    assert found[hour, "metadata.analyzed_records"] == 1 and found[hour, "metadata.skipped_records"] == 0
    assert found[None, "metadata.analyzed_records"] == 2 and found[None, "metadata.skipped_records"] == 2
    assert {r.window_start for r in result.health.collect()} == {hour, None}


def test_no_rules_and_empty_input(spark, lines):
    result = analyze(parse_lines(lines(access_line("198.51.100.9", "/", 200, "Browser 3", 3)), "nginx"), rules=[])
    assert result.insights.count() == 0 and result.incidents.count() == 0
    assert (result.health.first().overall_score, result.health.first().status) == (100, "HEALTHY")
    empty = parse_lines(spark.createDataFrame([], "line_id long, source_file string, value string"), "nginx")
    row = st.stats_summary(empty).first()
    assert (row.total_lines, row.error_rate, row.bytes_transferred) == (0, 0.0, 0)
    assert st.burst_summary(empty).first().is_bursting is False


def test_keys_add_up(lines):
    text = {f"{n}.json": [json.dumps({"level": "error", "status_code": 500 + i, "size": i, "latency": i * n}) for i in range(5)] for n in range(3)}
    df = parse_lines(lines(text), "json")
    whole = metrics.metrics_wide(metrics.metrics_long(df)).first()
    parts = metrics.metrics_wide(metrics.metrics_long(df, ["source_file"]), ["source_file"]).collect()
    for name in ("traffic.total_requests", "error.total_errors", "status.status_categories.5xx", "bandwidth.total_bytes_sent"):
        assert whole[name] == sum(p[name] for p in parts)


def test_dependencies_deliver_their_tables(lines, monkeypatch):
    calls, plain = [], sessions.sessions_with_paths

    def counted(*args):
        calls.append(1)
        return plain(*args)

    monkeypatch.setattr(sessions, "sessions_with_paths", counted)
    monkeypatch.setattr(metrics, "sessions_with_paths", counted)
    text = [access_line(f"198.51.100.{i % 3}", "/a", 200, "Browser 3", i) for i in range(10)]
    job = lambda records, keys, ctx, tables: tables["session"].groupBy(*keys).agg(F.sum("request_count").alias("visits.all"))
    register_metric("visits", job, ("visits.all",), dependencies=("session",))
    register_metric("guests", lambda r, k, c, t: t["visits"].select(*k, (F.col("`visits.all`") - 1).alias("visits.less")), ("visits.less",), dependencies=("visits", "endpoint"))
    try:
        found = {r.selector: r.value for r in measure(parse_lines(lines(*text), "nginx")).collect()}
    finally:
        unregister_metric("guests")
        unregister_metric("visits")
    assert (found["visits.all"], found["visits.less"], found["session.active_sessions_count"]) == (10.0, 9.0, 3.0)
    assert len(calls) == 1


def test_metric_registry():
    job = lambda records, keys, ctx: records
    register_metric("one", job, ("one.x",), dependencies=("session",))
    try:
        order = metric_order()
        assert order.index("session") < order.index("one")
        with pytest.raises(ValueError, match="already registered"):
            register_metric("one", job, ("one.y",))
        register_metric("two", job, ("two.x",), dependencies=("three",))
        with pytest.raises(ValueError, match="not registered"):
            metric_order()
        register_metric("three", job, ("three.x",), dependencies=("two",))
        with pytest.raises(ValueError, match="Circular"):
            metric_order()
    finally:
        for name in ("one", "two", "three"):
            unregister_metric(name)
