"""Lines to records: one projection per format, bad lines kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import csv_cells, strip
from ..schema import LINE_COLUMNS, RECORD_FIELDS, null_of, require_columns
from .exports import assemble_records, export_records
from .formats import DEFAULT_YEAR, Format, known_formats

# Fixed value: the line boundaries Python's str.splitlines() knows.
LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def explode_log_text(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Lines of a text column, blank ones dropped: ``keys`` + ``line_no`` (1-based) + ``value``."""
    return (
        df.select(*keys, F.posexplode(F.split(F.col(text), LINE_BREAKS)).alias("pos", "value"))
        .where(strip(F.col("value")) != "")
        .select(*keys, (F.col("pos") + 1).cast("bigint").alias("line_no"), "value")
    )


def parse_lines(lines: DataFrame, fmt: str | Format, year: int = DEFAULT_YEAR) -> DataFrame:
    """Records of one format. ``lines`` has ``line_id``, ``source_file``, ``value``; other columns stay."""
    return _project(lines, {None: _resolve(fmt, year)})


def parse_with_formats(lines: DataFrame, year: int = DEFAULT_YEAR) -> DataFrame:
    """Records of lines that carry their format in a ``format`` column; unknown formats give bad lines.

    One pass: every format's costly column is guarded by the format, so a line pays only for its own.
    """
    return _project(lines, known_formats(year))


def parse_auto(
    lines: DataFrame, winners: DataFrame, year: int = DEFAULT_YEAR, exports: DataFrame | None = None
) -> DataFrame:
    """Parse each file with its detected format.

    ``winners`` has one row per file (``source_file``, ``format``). Spark broadcasts it as long as its size
    in bytes allows, so the lines are not shuffled; past that it is a plain join.

    ``exports`` names the files (``source_file``) that are Event Viewer exports, see ``export_files``: their records may span lines.
    Only their lines are shuffled. The lines then need ``block_start`` and have to include blank ones.
    """
    side = winners.select("source_file", "format")
    if exports is None:
        return parse_with_formats(lines.drop("format").join(side, "source_file", "left"), year)
    plain = lines.join(exports, "source_file", "left_anti").where(strip(F.col("value")) != "")
    records = parse_auto(plain, winners, year)
    whole = assemble_records(lines.drop("format").join(exports, "source_file", "left_semi"))
    cells = worked_out(whole.withColumn("_cells", csv_cells(strip(F.col("value")))), ["_cells"])
    return records.unionByName(export_records(cells.drop("value")).select(*records.columns))


def split_errors(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the bad lines with their text."""
    bad = F.coalesce(F.col("parse_error"), F.lit(False))
    keep = [c for c in ("line_id", "source_file", "format") if c in records.columns]
    return records.where(~bad), records.where(bad).select(*keep, "raw")


def _resolve(fmt: str | Format, year: int) -> Format:
    if isinstance(fmt, Format):
        return fmt
    formats = known_formats(year)
    if fmt not in formats:
        raise ValueError(f"Unknown format {fmt!r}; known: {list(formats)}")
    return formats[fmt]


def with_stages(lines: DataFrame, formats: list[Format], guard) -> DataFrame:
    """Add the intermediate columns of the formats; ``guard(format)`` limits where each is evaluated."""
    shared: dict[int, dict[str, tuple[Column, list[Format]]]] = {}
    for fmt in formats:
        for depth, stage in enumerate(fmt.stages(F.col("value"))):
            for name, column in stage.items():
                entry = shared.setdefault(depth, {}).setdefault(name, (column, []))
                entry[1].append(fmt)
    out = lines
    for depth in sorted(shared):
        out = out.withColumns({
            name: guard(column, users) for name, (column, users) in shared[depth].items()
        })
    return out


def worked_out(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep what is in the columns ``names`` from being worked out again by what is built on them.

    Filters on parsed fields are pushed below plain projections, and repeat there what the fields are made from. They do not pass a
    generator whose output they read, so the columns go through one that gives one row for each.
    """
    quoted = lambda c: F.col(f"`{c}`")
    kept = [quoted(c) for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*[quoted(c) for c in names]))))


def _project(lines: DataFrame, formats: dict[str | None, Format]) -> DataFrame:
    require_columns(lines, LINE_COLUMNS, "parsing")
    single = None in formats
    chosen = list(formats.values())
    value = F.col("value")

    def guard(column: Column, users: list[Format]) -> Column:
        return column if single else F.when(F.col("format").isin(*[u.name for u in users]), column)

    staged = with_stages(lines, chosen, guard)
    staged = worked_out(staged, [c for c in staged.columns if c not in lines.columns])
    fields = {fmt.name: fmt.fields() for fmt in chosen}

    def cases(pick, default: Column) -> Column:
        out, first = None, True
        for fmt in chosen:
            column = pick(fmt)
            if column is None:
                continue
            if single:
                return column
            condition = F.col("format") == fmt.name
            out = F.when(condition, column) if first else out.when(condition, column)
            first = False
        return default if out is None else out.otherwise(default)

    good = F.coalesce(cases(lambda f: f.parsed(), F.lit(False)), F.lit(False))
    flagged = staged.withColumn("parse_error", ~good)
    ok = ~F.col("parse_error")
    out: list[Column] = []
    for name in RECORD_FIELDS:
        if name == "format":
            column = F.lit(chosen[0].name) if single else F.col("format")
        elif name == "parse_error":
            column = F.col(name)
        elif name == "raw":
            column = cases(lambda f: f.raw(value), value)
        else:
            column = F.when(ok, cases(lambda f, n=name: fields[f.name].get(n), null_of(name)))
        out.append(column.cast(RECORD_FIELDS[name]).alias(name))
    kept = [c for c in lines.columns if c not in RECORD_FIELDS and c != "value"]
    return flagged.select(*kept, *out)
