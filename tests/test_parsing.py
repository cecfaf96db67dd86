"""Each format on lines of our own; what a line says in is what its record says out."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.fields import Fields, journey_stage, safe_int
from cinderlog.functions.text import csv_cells, url_decode_lenient
from cinderlog.functions.times import normalize_timestamp, strptime_pattern
from cinderlog.operators.formats import known_formats, register_format, unregister_format
from cinderlog.operators.parsing import explode_log_text, parse_lines, split_errors


def parsed(df):
    return [r.asDict() for r in df.orderBy("line_id").collect()]


def picked(row, *names):
    return tuple(row[n] for n in names)


def test_access_lines(lines):
    rows = parsed(parse_lines(lines(
        '203.0.113.77 - mira [03/Feb/2031:07:45:10 -0330] "DELETE /shelf/44/tag HTTP/2.0" 409 7812 "https://library.test/desk" "ShelfBot 9 (reader)"',
        'fe80::7:1 - - [29/Feb/2032:23:59:59 +0000] "HEAD /map HTTP/1.0" 206 -',
        "the printer on floor 3 is out of paper",
        '198.51.100.4 - mira [03/Feb/2031:07:45:11 +1400] "PATCH /two words HTTP/1.1" 415 12',
        '198.51.100.4 - m\x01ra [03/Feb/2031:07:45:12 +0000] "PUT /odd HTTP/1.1" 201 13',
        '198.51.100.4 - - [31/Feb/2031:07:45:12 +0000] "PUT /odd HTTP/1.1" 201 13',
    ), "apache"))
    assert picked(rows[0], "source_ip", "remote_user", "method", "path", "protocol", "status_code", "size", "referer", "user_agent") == (
        "203.0.113.77", "mira", "DELETE", "/shelf/44/tag", "HTTP/2.0", 409, 7812, "https://library.test/desk", "ShelfBot 9 (reader)")
    assert rows[0]["timestamp"] == datetime(2031, 2, 3, 11, 15, 10) and rows[0]["format"] == "apache"
    assert picked(rows[1], "source_ip", "remote_user", "size", "referer", "user_agent", "parse_error") == ("fe80::7:1", None, None, None, None, False)
    assert rows[1]["timestamp"] == datetime(2032, 2, 29, 23, 59, 59)
    assert picked(rows[2], "parse_error", "raw", "path", "timestamp") == (True, "the printer on floor 3 is out of paper", None, None)
    assert picked(rows[3], "request", "path", "method", "parse_error") == ("PATCH /two words HTTP/1.1", None, None, False)
    assert picked(rows[4], "remote_user", "path", "status_code") == ("m\x01ra", "/odd", 201)
    assert picked(rows[5], "timestamp", "parse_error", "status_code") == (None, False, 201)


def test_syslog_layouts(lines):
    rows = parsed(parse_lines(lines(
        "<187>Sep  3 04:05:06 harbor-2 crane[88]: boom lowered by operator 12",
        '<12>1 2031-09-03T04:05:06.250+02:00 harbor-2.test tide 77 MSG9 [depth@1 m="4.2"][wind@1 kn="19"] water is rising',
        "Sep 30 23:00:01 harbor-2 crane: cable check failed twice",
        "Sep 30 23:00:02 harbor-2 gate[5]: please note the NOTICE on the door",
        "<14>1 - - - - - - quiet",
        "harbor-2 says hello",
    ), "syslog", 2030))
    assert picked(rows[0], "priority", "level", "hostname", "process", "pid", "message", "syslog_version") == (
        187, "ERROR", "harbor-2", "crane", 88, "boom lowered by operator 12", "3164")
    assert rows[0]["timestamp"] == datetime(2030, 9, 3, 4, 5, 6)
    assert picked(rows[1], "level", "hostname", "process", "pid", "msgid", "structured_data", "message", "syslog_version") == (
        "WARNING", "harbor-2.test", "tide", 77, "MSG9", '[depth@1 m="4.2"][wind@1 kn="19"]', "water is rising", "5424")
    assert rows[1]["timestamp"] == datetime(2031, 9, 3, 2, 5, 6, 250_000)
    assert [picked(r, "level", "pid", "priority") for r in rows[2:4]] == [("ERROR", None, None), ("NOTICE", 5, None)]
    assert picked(rows[4], "timestamp", "msgid", "structured_data", "message") == (None, None, None, "quiet")
    assert rows[5]["parse_error"]


def test_application_lines(lines):
    rows = parsed(parse_lines(lines(
        "[2031-04-05 06:07:08] critical orchard.press: pump 4 stopped",
        "2031-04-05 06:07:08,050 - orchard.cellar - warn - barrel 7 at 19 degrees",
        "2031-04-05 - orchard - INFO - no time of day",
    ), "django"))
    assert picked(rows[0], "timestamp", "level", "logger", "message") == (datetime(2031, 4, 5, 6, 7, 8), "CRITICAL", "orchard.press", "pump 4 stopped")
    assert picked(rows[1], "timestamp", "level", "logger", "message") == (
        datetime(2031, 4, 5, 6, 7, 8, 50_000), "WARNING", "orchard.cellar", "barrel 7 at 19 degrees")
    assert rows[2]["parse_error"]


def test_json_lines(lines):
    rows = parsed(parse_lines(lines(
        '{"ts": "2031-06-07T08:09:10Z", "severity": "fatal", "log": "kiln too hot", "status_code": "507", "batch": 12}',
        '{"@timestamp": "2031-06-07T08:09:10+01:00", "LVL": "x", "note": "debug"}',
        '{"time": "2031-06-07T08:00:00Z", "ts": "2031-06-07T09:00:00Z", "level": "", "mood": "Warn"}',
        '{"glaze": "blue"', '{"glaze": 1} and more', "{'glaze': 1}", '["glaze"]', '{"glaze":1},{"glaze":2}',
        '{"glaze":"blue","glaze":"red","shelf":{"row":[3,4]}}',
    ), "json"))
    assert picked(rows[0], "timestamp", "level", "message", "status_code", "attrs") == (
        datetime(2031, 6, 7, 8, 9, 10), "FATAL", "kiln too hot", 507, {"severity": "fatal", "batch": "12"})
    assert picked(rows[1], "timestamp", "level") == (datetime(2031, 6, 7, 7, 9, 10), "DEBUG")
    assert picked(rows[2], "timestamp", "level") == (datetime(2031, 6, 7, 9), "WARNING")
    assert [r["parse_error"] for r in rows] == [False] * 3 + [True] * 5 + [False]
    assert rows[8]["attrs"] == {"glaze": "red", "shelf": '{"row":[3,4]}'}


def test_windows_events(lines):
    xml = (
        '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="{p}"/><EventID>{e}</EventID>'
        '<TimeCreated SystemTime="{t}"/><Level>{l}</Level><Task>{k}</Task></System><EventData>{d}</EventData></Event>'
    )
    rows = parsed(parse_lines(lines(
        "Keywords,Date and Time,Source,Event ID,Task Category",
        '"Audit Failure","2031-08-09 10:11:12","Turnstile, east",5061,"Gate","Badge ""77-b"" refused, twice"',
        xml.format(p="Lift", e=19, t="2031-08-09T10:11:12.123456789Z", l=2, k=3, d='<Data Name="floor">9</Data><Data>stuck</Data>'),
        xml.format(p="Lift", e="", t="", l=9, k="", d=""),
        "<!DOCTYPE x [<!ENTITY y 'z'>]><Event>&y;</Event>",
        '<Event><System>left open',
        'Critical,8/9/2031 1:02:03 PM,Boiler,7001,Heat,"runs over the line',
        "a,b,c,not a number,e",
    ), "windows"))
    assert [r["parse_error"] for r in rows] == [True, False, False, False, True, True, False, True]
    assert picked(rows[1], "level", "timestamp", "source", "event_id", "category", "message") == (
        "AUDIT_FAILURE", datetime(2031, 8, 9, 10, 11, 12), "Turnstile, east", 5061, "Gate", 'Badge "77-b" refused, twice')
    assert picked(rows[2], "level", "timestamp", "source", "event_id", "category", "message") == (
        "ERROR", datetime(2031, 8, 9, 10, 11, 12, 123_456), "Lift", 19, "3", "floor=9; stuck")
    assert picked(rows[3], "level", "timestamp", "source", "event_id", "message") == ("INFO", None, "Lift", None, None)
    assert picked(rows[6], "level", "timestamp", "message") == ("CRITICAL", datetime(2031, 8, 9, 13, 2, 3), "runs over the line")


def test_registered_formats(lines):
    register_format("ferry", r"(?P<when>\d{8}) pier=(?P<pier>\w+) (?P<level>\w+): (?P<message>.+)", "when", "%Y%m%d")
    try:
        rows = parsed(parse_lines(lines("log> 20311011 pier=B4 LATE: fog on the river", "nothing here"), "ferry"))
        assert picked(rows[0], "timestamp", "level", "message", "attrs") == (
            datetime(2031, 10, 11), "LATE", "fog on the river", {"when": "20311011", "pier": "B4"})
        assert rows[1]["parse_error"]
        register_format("ferry", r"^(?P<level>[A-Z]+)$")  # takes the place of the first
        assert [r["level"] for r in parsed(parse_lines(lines("GO", "stop"), "ferry"))] == ["GO", None]
        assert list(known_formats()) == ["json", "nginx", "apache", "django", "syslog", "windows", "ferry"]
    finally:
        unregister_format("ferry")
    for pattern, complaint in ((r"pier=\w+", "at least one named group"), (r"(?P<pier>", "Invalid regex")):
        with pytest.raises(ValueError, match=complaint):
            register_format("ferry", pattern)
    with pytest.raises(ValueError, match="Unknown format"):
        parse_lines(lines("GO"), "ferry")


def test_bad_lines_are_set_apart(lines):
    good, bad = split_errors(parse_lines(lines('192.0.2.200 - - [05/May/2031:05:05:05 +0000] "GET /ok HTTP/1.1" 200 5', "...", "???"), "nginx"))
    assert [r.path for r in good.collect()] == ["/ok"] and sorted(r.raw for r in bad.collect()) == ["...", "???"]


def test_text_column_to_lines(spark):
    df = spark.createDataFrame([(9, "one\rtwo\r\n\t\nthree\x1ffour five"), (8, None), (7, "")], "id int, text string")
    got = [(r.id, r.line_no, r.value) for r in explode_log_text(df, "text", ["id"]).orderBy("line_no").collect()]
    assert got == [(9, 1, "one"), (9, 2, "two"), (9, 4, "three\x1ffour"), (9, 5, "five")]


def column(spark, kind, values, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_times(spark):
    noon = datetime(2031, 12, 1, 12)
    texts = ["2031-12-01T12:00:00Z", "2031-12-01 13:00:00+01:00", "01/Dec/2031:12:00:00 +0000", "[2031-12-01 12:00:00]", "12/1/2031 12:00:00 PM", "noon", "-", None]
    assert column(spark, "string", texts, normalize_timestamp) == [noon] * 5 + [None] * 3
    assert strptime_pattern("%H.%M.%S %d/%b/%Y") == "HH.mm.ss dd/MMM/yyyy"


def test_small_columns(spark):
    assert column(spark, "string", ["x%2By+z%", "%7Euser", "%C3%28"], url_decode_lenient) == ["x+y+z%", "~user", "�("]
    assert column(spark, "string", ["'-7'", " 42 ", "4e2", "", None], safe_int) == [-7, 42, None, None, None]
    assert column(spark, "string", ['"a ""b"", c",,d', "", '"open'], csv_cells) == [['a "b", c', "", "d"], [""], ["open"]]
    urls = ["/", "/products", "/product/9/details", "/shop/cart", "/pay", "/garden"]
    assert column(spark, "string", urls, journey_stage) == ["Landing", "Products", "Product", "Cart", "Checkout", "Other"]


def test_endpoints(spark):
    rows = [("/tide?x=1", "POST /other HTTP/1.1", "crane"), (" ", "POST /dock/3 HTTP/1.1", None), (None, None, " crane "), (None, "", None)]
    df = spark.createDataFrame(rows, "path string, request string, service string")
    assert [r[0] for r in df.select(Fields(df).endpoint()).collect()] == ["/tide?x=1", "unknown", "crane", "unknown"]
