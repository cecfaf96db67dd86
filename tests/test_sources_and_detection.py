import gzip

from pyspark.sql import functions as F

from cinderlog.operators.detection import detect, format_quality, format_scores, sample_head
from cinderlog.operators.parsing import parse_auto
from cinderlog.sources.exports import write_csv, write_json_lines
from cinderlog.sources.files import list_files, read_heads, read_log_lines, read_windows_csv, size_guard

NGINX = '127.0.0.1 - - [10/Jul/2026:20:53:59 +0530] "GET /users HTTP/1.1" 200 456 "http://referer.com" "Mozilla/5.0"'
APP = "[2026-07-10 12:00:00] INFO django.request: GET /api 200 45ms"


def test_reading_gzip_latin1_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n   \ntwo\n")
    (tmp_path / "b.log").write_bytes("café line\nplain Ã©".encode("latin-1"))
    with gzip.open(tmp_path / "c.log.gz", "wt") as f:
        f.write("\U0001f600 packed\n")
    lines = read_log_lines(spark, str(tmp_path))
    assert sorted(r.value for r in lines.collect()) == sorted(["one", "two", "café line", "plain Ã©", "\U0001f600 packed"])
    # By line, bytes that happen to be UTF-8 stay so.
    by_line = {r.value for r in read_log_lines(spark, str(tmp_path), latin1="line").collect()}
    assert "café line" in by_line and "plain é" in by_line
    heads = read_heads(list_files(spark, str(tmp_path)), 1)
    assert {r.value for r in heads.collect()} == {"one", "café line", "\U0001f600 packed"}


def test_size_guard(spark, tmp_path):
    (tmp_path / "small.log").write_text("x\n")
    with gzip.open(tmp_path / "bomb.log.gz", "wt") as f:
        f.write("0" * 10_000 + "\n")
    files = list_files(spark, str(tmp_path))
    guarded = size_guard(files, read_log_lines(spark, str(tmp_path), "off"), max_unpacked_bytes=5_000)
    verdicts = {r.source_file.split("/")[-1]: r.verdict for r in guarded.collect()}
    assert verdicts == {"small.log": "ok", "bomb.log.gz": "unpacks_too_large"}
    assert {r.verdict for r in size_guard(files, max_bytes=1).collect()} == {"too_large"}


def test_windows_export_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.csv").write_text(
        'Level,Date and Time,Source,Event ID,Task Category,Description\n'
        'Error,2026-07-10 12:00:00,App,7,None,"first line\nsays ""hi"", twice"\n,,,,,\nInformation,2026-07-10 12:00:01,Short\n')
    rows = read_windows_csv(spark, str(tmp_path / "in")).orderBy("timestamp").collect()
    assert [(r.level, r.event_id, r.message) for r in rows] == [("ERROR", 7, 'first line\nsays "hi", twice'), ("INFO", None, None)]
    df = spark.createDataFrame([('say "x"', None, 1)], "a string, b string, n int")
    write_csv(df, str(tmp_path / "csv"), ["n", "a", "b"])
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"1","say ""x""",""' in text
    write_json_lines(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().a == 'say "x"'


def test_detection_rank_ambiguity_and_suffix(spark, lines):
    files = {
        "a.log": [NGINX] * 3, "a.dat": [NGINX] * 3, "junk.log": ["hello", "this is random", "123", "???"],
        "app.log": [APP] * 3, "rare.dat": [NGINX, "x", "y", "z"], "e.csv": ["Level,Date and Time,Source,Event ID,Task Category,Description"],
    }
    found = {r.source_file: r for r in detect(sample_head(lines(files))).collect()}
    assert found["a.log"].format == "nginx" and found["a.log"].confidence >= 0.9 and found["a.log"].ambiguous
    assert found["a.log"].alternatives == ["apache"] and "Compatible formats: 'apache'" in found["a.log"].reason
    assert found["a.log"].confidence > found["a.dat"].confidence
    assert (found["junk.log"].format, found["junk.log"].confidence, found["junk.log"].ambiguous) == ("unknown", 0.0, False)
    assert found["rare.dat"].format == "unknown" and "below threshold" in found["rare.dat"].reason
    assert found["app.log"].format == "django" and found["e.csv"].format == "windows"
    assert {r.source_file: r.format for r in detect(sample_head(lines(files)), fallback=True).collect()}["rare.dat"] == "nginx"
    parts = format_scores(format_quality(sample_head(lines(files)))).where("source_file = 'a.dat' AND format = 'nginx'").first()
    assert (parts.match_score, parts.parse_quality, parts.timestamp_quality, parts.numeric_valid) == (0.3, 0.25, 0.15, 0.05)


def test_parse_auto_is_one_pass(spark, lines):
    data = lines({"a.log": [NGINX, "bad"], "b.log": [APP], "c.log": ["junk"]})
    winners = spark.createDataFrame([("a.log", "nginx"), ("b.log", "django"), ("c.log", "unknown")], "source_file string, format string")
    records = parse_auto(data, winners)
    rows = {(r.source_file, r.parse_error): r for r in records.collect()}
    assert rows[("a.log", False)].status_code == 200 and rows[("a.log", True)].raw == "bad"
    assert rows[("b.log", False)].logger == "django.request" and rows[("c.log", True)].raw == "junk"
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 0 and "BroadcastHashJoin" in plan


def test_folder_to_records(spark, tmp_path):
    (tmp_path / "web site").mkdir()
    (tmp_path / "web site" / "a b.log").write_text(f"{NGINX}\nbad\n{NGINX}\n")
    (tmp_path / "app.log").write_text(f"{APP}\n" * 3)
    winners = detect(read_heads(list_files(spark, [str(tmp_path), str(tmp_path / "web site")])))
    records = parse_auto(read_log_lines(spark, [str(tmp_path), str(tmp_path / "web site")]), winners)
    counts = {(r.format, r.parse_error): r["count"] for r in records.groupBy("format", "parse_error").count().collect()}
    assert counts == {("nginx", False): 2, ("nginx", True): 1, ("django", False): 3}
