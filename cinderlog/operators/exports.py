"""Event Viewer exports: CSV records whose quoted cells run over lines.

A line is a step between two states, outside and inside a quoted cell: it keeps the state, turns it round, or leads to one of them from
both. Steps compose in any grouping, so the state before every line follows from a running count of turns and the last line that leads
to one state, worked out block by block; blocks are then chained through one short row each. A file of many blocks is read by as many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import csv_cells, strip
from ..schema import RECORD_FIELDS, null_of, require_columns
from ..session import through_table
from .formats import WINDOWS_EXPORT_CELLS, has_cell, windows_row_fields, windows_row_raw

#: Lines of a record above which a quote is taken to have been left open: such lines come back one by one.
MOST_LINES = 10_000

# Closed cells, then a quoted one that the line does not close.
_LEFT_OPEN = r'\A(?:"(?:[^"]++|"")*+"[^,]*,|(?!")[^,]*,)*+"(?:[^"]++|"")*+\z'


def export_files(sample: DataFrame, winners: DataFrame | None = None) -> DataFrame:
    """``source_file`` of the files whose first line is the header of an export, from a head sample.

    With ``winners``, only files detected as Windows events.
    """
    first = sample.where(strip(F.col("value")) != "").groupBy("source_file").agg(F.min_by("value", "line_no").alias("value"))
    found = first.where(has_cell(csv_cells(F.col("value")), WINDOWS_EXPORT_CELLS)).select("source_file")
    if winners is not None:
        found = found.join(winners.where("format = 'windows'"), "source_file", "left_semi")
    return found


def _states(df: DataFrame, turn: Column, fixed: Column, w) -> DataFrame:
    """Add ``_after_0`` and ``_after_1``: the state after each row if it was outside, or inside, before the first one."""
    counted = df.withColumn("_turns", F.sum(turn.cast("int")).over(w))
    last = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("_turns").alias("turns"))), ignorenulls=True).over(w)
    reset = counted.withColumn("_last", last)
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    flip = lambda state, by: state != by
    known = flip(F.col("_last.state"), odd(F.col("_turns") - F.col("_last.turns")))
    return reset.withColumns({
        f"_after_{s}": F.when(F.col("_last").isNotNull(), known).otherwise(flip(F.lit(bool(s)), odd(F.col("_turns")))) for s in (0, 1)
    }).drop("_turns", "_last")


def assemble_records(lines: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """Lines of exports as whole records: ``value`` holds the lines of a record, joined by line feeds.

    ``lines`` has ``line_id``, ``source_file``, ``block_start`` and ``value``, blank lines included; the other columns are those of a
    record's first line. The header and records without a filled cell are left out. Cells follow the rules of CSV: a quote opens a cell
    only at its start. A quote left open for more than ``most_lines`` lines gives back these lines one by one.
    """
    require_columns(lines, ["line_id", "source_file", "block_start", "value"], "record assembly")
    block = Window.partitionBy("source_file", "block_start").orderBy("line_id")
    opens = F.col("value").rlike(_LEFT_OPEN)
    stays = F.concat(F.lit('"x'), F.col("value")).rlike(_LEFT_OPEN)
    steps = lines.withColumns({"_opens": F.coalesce(opens, F.lit(False)), "_stays": F.coalesce(stays, F.lit(False))})
    turn = F.col("_opens") & ~F.col("_stays")
    fixed = F.when(F.col("_opens") == F.col("_stays"), F.col("_opens"))
    stated = _states(steps, turn, fixed, block).withColumns({
        f"_starts_{s}": ~F.lag(f"_after_{s}", 1, bool(s)).over(block) for s in (0, 1)
    }).drop("_opens", "_stays")
    # Written: it is read for the blocks and for the lines, and both have to see the same line ids.
    stated = through_table(stated, "export-lines")

    blocks = stated.groupBy("source_file", "block_start").agg(
        *[F.max_by(f"_after_{s}", "line_id").alias(f"_out_{s}") for s in (0, 1)],
        *[F.max(F.when(F.col(f"_starts_{s}"), F.col("line_id"))).alias(f"_start_{s}") for s in (0, 1)],
        F.min(F.when(strip(F.col("value")) != "", F.col("line_id"))).alias("_filled"),
    )
    file = Window.partitionBy("source_file").orderBy("block_start")
    out_turns = F.col("_out_0") & ~F.col("_out_1")
    out_fixed = F.when(F.col("_out_0") == F.col("_out_1"), F.col("_out_0"))
    place = F.struct(F.col("block_start").alias("block"), F.col("_last_start").alias("line"))
    chained = (
        _states(blocks, out_turns, out_fixed, file)
        .withColumn("_inside", F.lag("_after_0", 1, False).over(file))
        .withColumn("_last_start", F.when(F.col("_inside"), F.col("_start_1")).otherwise(F.col("_start_0")))
        .withColumn("_open_record", F.last(F.when(F.col("_last_start").isNotNull(), place), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_header", F.min(F.when(F.col("_filled").isNotNull(), F.struct(F.col("block_start").alias("block"), F.col("_filled").alias("line"))))
                    .over(Window.partitionBy("source_file")))
        .select("source_file", "block_start", "_inside", "_open_record", "_header")
    )

    here = F.struct(F.col("block_start").alias("block"), F.col("line_id").alias("line"))
    starts = F.when(F.col("_inside"), F.col("_starts_1")).otherwise(F.col("_starts_0"))
    owned = (
        stated.join(chained, ["source_file", "block_start"])
        .withColumn("_record", F.last(F.when(starts, here), ignorenulls=True).over(block))
        .withColumn("_record", F.coalesce("_record", "_open_record"))
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("source_file", "block_start", "_record"))
    owned = owned.withColumn("_record", F.when(size > most_lines, here).otherwise(F.col("_record")))
    others = [c for c in lines.columns if c not in ("line_id", "source_file", "block_start", "value")]
    part = F.struct("block_start", "line_id", "value")
    whole = owned.groupBy("source_file", "_record").agg(
        F.array_sort(F.collect_list(part)).alias("_parts"),
        F.first("_header").alias("_header"),
        *([F.min_by(F.struct(*others), here).alias("_others")] if others else []),
    )
    value = F.array_join(F.transform("_parts", lambda p: F.coalesce(p["value"], F.lit(""))), "\n")
    return (
        whole.where(~F.col("_record").eqNullSafe(F.col("_header")))
        .select(
            F.col("_record.line").alias("line_id"), "source_file", F.col("_record.block").alias("block_start"), value.alias("value"),
            *(["_others.*"] if others else []),
        )
        # A record without a filled cell has nothing but separators, quotes and white space.
        .where(
            (strip(F.translate("value", '",', "")) != "")
            | (F.contains("value", F.lit('""')) & F.exists(csv_cells(strip(F.col("value"))), lambda c: strip(c) != ""))
        )
        .select(*lines.columns)
    )


def export_records(rows: DataFrame, cells: str = "_cells") -> DataFrame:
    """Records of export rows from an array column of their cells, by position; the other columns stay.

    Short rows are padded. A row without time, source and event id is a bad one.
    """
    fields = windows_row_fields(F.col(cells))
    bad = fields["timestamp"].isNull() & fields["source"].isNull() & fields["event_id"].isNull()
    flagged = rows.withColumn("parse_error", bad)
    out = []
    for name, kind in RECORD_FIELDS.items():
        if name == "format":
            column = F.lit("windows")
        elif name == "parse_error":
            column = F.col(name)
        elif name == "raw":
            column = windows_row_raw(F.col(cells))
        else:
            column = F.when(~F.col("parse_error"), fields.get(name, null_of(name)))
        out.append(column.cast(kind).alias(name))
    kept = [c for c in rows.columns if c != cells and c not in RECORD_FIELDS]
    return flagged.select(*kept, *out)
