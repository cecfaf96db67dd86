"""What plans must not do: run a pattern or a parser again for every filter and field."""

import re

import pytest

from cinderlog.operators.formats import add_format, regex_format, unregister_format
from cinderlog.operators.parsing import parse_lines, parse_with_formats
from cinderlog.streaming.jobs import stream_lines

FILTERS = ["level = 'ERROR'", "NOT parse_error", "timestamp > '2024-01-01'", "status_code >= 500 AND path LIKE '/a%'", "raw LIKE '%x'"]
COSTLY = {
    "json": r"from_json", "nginx": r"split\(regexp_replace\(", "syslog": r"split\(regexp_replace\(", "django": r"split\(regexp_replace\(",
    "windows": r"from_xml|regexp_extract_all",
}


def runs(df, pattern):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(pattern, plan))


@pytest.mark.parametrize("fmt", list(COSTLY))
def test_filters_do_not_parse_again(lines, fmt):
    records = parse_lines(lines("x"), fmt)
    bare = runs(records, COSTLY[fmt])
    assert bare <= 2
    for condition in FILTERS:
        assert runs(records.where(condition), COSTLY[fmt]) <= bare, condition


def test_mixed_formats_parse_once(lines):
    records = parse_with_formats(lines("x").selectExpr("*", "'json' AS format"))
    for condition in FILTERS:
        assert runs(records.where(condition), "from_json") == 1


def test_streams_parse_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"level": "error", "status_code": 500, "path": "/a"}\n')
    records = parse_lines(stream_lines(spark, str(tmp_path / "in")), "json")
    for n, condition in enumerate(FILTERS):
        job = records.where(condition).writeStream.format("noop").trigger(availableNow=True)
        job = job.option("checkpointLocation", str(tmp_path / f"progress{n}")).start()
        job.awaitTermination()
        assert len(re.findall("from_json", job._jsq.explainInternal(False))) == 1


def test_names_of_formats(lines):
    """Any text names a format: its columns do not depend on how the name reads as one."""
    for name in ("my.app", "a b", "ünï`x", "a-b.c"):
        add_format(regex_format(name, r"^(?P<level>\w+)=(?P<message>.*)$"))
        try:
            got = parse_lines(lines("ERROR=disk full", "?"), name).orderBy("line_id").collect()
        finally:
            unregister_format(name)
        assert [(r.format, r.level, r.message, r.parse_error) for r in got] == [(name, "ERROR", "disk full", False), (name, None, None, True)]
