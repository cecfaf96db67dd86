"""Exports with records over several lines, against reading each file whole."""

import csv
import io
import random

from cinderlog.operators.detection import detect
from cinderlog.operators.exports import assemble_records, export_files, export_records
from cinderlog.operators.parsing import parse_auto
from cinderlog.sources.files import list_files, read_heads, read_log_lines

HEADER = "Level,Date and Time,Source,Event ID,Task Category,Description"


def made(draw):
    """A file of records: cells quoted or not, with line breaks, quotes, commas and blank lines inside."""
    cell = lambda: "".join(draw.choices(["a", "b c", ",", '""', "\n", "\n\n", ' "" ', "x,y"], k=draw.randrange(0, 6)))
    rows = [HEADER]
    for _ in range(draw.randrange(0, 9)):
        cells = [f'"{cell()}"' if draw.random() < 0.7 else draw.choice(("", "plain", 'in"side', " sp ")) for _ in range(draw.randrange(1, 8))]
        rows.append(",".join(cells))
        if draw.random() < 0.3:
            rows.append(draw.choice(("", "  ", ",,,")))
    return "\n".join(rows)


def whole_rows(text):
    rows = list(csv.reader(io.StringIO(text.strip())))
    return [r for r in rows[1:] if any(c.strip() for c in r)]


def lines_of(spark, files, draw):
    """Lines in blocks of random size."""
    rows, n = [], 0
    for name, text in files.items():
        block = 0
        for line in text.split("\n"):
            if draw.random() < 0.25:
                block += 100
            rows.append((n, name, block, line, n * 2))
            n += 1
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "line_id long, source_file string, block_start long, value string, extra int")


def test_records_like_a_whole_read(spark):
    draw = random.Random(4)
    files = {f"f{i}.csv": "\n" * draw.randrange(2) + made(draw) for i in range(60)}
    got = assemble_records(lines_of(spark, files, draw))
    assert got.columns == ["line_id", "source_file", "block_start", "value", "extra"]
    found = {}
    for r in got.orderBy("line_id").collect():
        assert r.extra == 2 * r.line_id
        found.setdefault(r.source_file, []).append(r.value)
    for name, text in files.items():
        cells = [[c.strip() for c in next(csv.reader(io.StringIO(v)))] for v in found.get(name, [])]
        assert cells == [[c.strip() for c in r] for r in whole_rows(text)], text


def test_open_quote_gives_its_lines_back(spark):
    lines = [HEADER, 'Error,2024-03-01 10:00:00,S,1,C,"never closed', *[f"line {i}" for i in range(30)]]
    frame = spark.createDataFrame([(i, "f", 0, v) for i, v in enumerate(lines)], "line_id long, source_file string, block_start long, value string")
    assert assemble_records(frame, most_lines=10).count() == 31
    assert assemble_records(frame).count() == 1
    assert assemble_records(frame.limit(0)).count() == 0


def test_parse_auto_with_exports(spark, tmp_path):
    export = HEADER + '\nWarning,2024-05-06 07:08:09,Spooler,77,Print,"Queue ""A"" is\n\nfull, 9 jobs"\n,,,,,\nnonsense\nError,,,,,\n'
    (tmp_path / "events.csv").write_text(export)
    (tmp_path / "app.log").write_text("[2024-05-06 07:08:09] INFO shop.cart: added 3 items\n\n[2024-05-06 07:08:10] ERROR shop.cart: none left\n")
    heads = read_heads(list_files(spark, str(tmp_path)))
    winners = detect(heads)
    exports = export_files(heads, winners)
    lines = read_log_lines(spark, str(tmp_path), blanks=True)
    got = parse_auto(lines, winners, exports=exports).collect()
    windows = sorted((r for r in got if r.format == "windows"), key=lambda r: r.line_id)
    assert [(r.level, r.source, r.event_id, r.message, r.parse_error) for r in windows] == [
        ("WARNING", "Spooler", 77, 'Queue "A" is\n\nfull, 9 jobs', False), (None,) * 4 + (True,), (None,) * 4 + (True,),
    ]
    assert windows[0].raw == 'Warning,2024-05-06 07:08:09,Spooler,77,Print,Queue "A" is\n\nfull, 9 jobs'
    assert sorted(r.message for r in got if r.format == "django") == ["added 3 items", "none left"]


def test_short_rows(spark):
    rows = spark.createDataFrame([(1, ["Error", "", "S"]), (2, [])], "line_id long, _cells array<string>")
    got = {r.line_id: r for r in export_records(rows).collect()}
    assert got[1].source == "S" and not got[1].parse_error and got[2].parse_error
