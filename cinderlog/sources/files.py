"""Reading log folders."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip
from ..operators.exports import export_records
from ..schema import RECORD_FIELDS
from ..session import through_table

# Accepted suffixes and byte limits.
LOG_SUFFIXES = (".log", ".txt", ".json", ".csv", ".gz")
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_UNPACKED_BYTES = 200 * 1024 * 1024
SAMPLE_LINES = 50


def read_log_lines(spark: SparkSession, paths: str | list[str], latin1: str = "file", blanks: bool = False) -> DataFrame:
    """Non-blank lines of text files, gzip by suffix: ``line_id``, ``source_file``, ``block_start``, ``value``.

    ``line_id`` is unique and rises within a block; (``block_start``, ``line_id``) is file order. With ``blanks``, blank lines are kept:
    records that span lines may hold some.
    ``latin1`` says how text that is not UTF-8 is read: ``file`` reads the whole file as Latin-1 (the lines are written once, so
    that the files are scanned once), ``line`` just the line, ``off`` leaves it.
    """
    lines = spark.read.text(paths).select(
        F.monotonically_increasing_id().alias("line_id"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
    )
    if latin1 == "file":
        lines = latin1_fallback(lines)
    elif latin1 == "line":
        lines = lines.withColumn("value", as_text(F.col("value")))
    elif latin1 != "off":
        raise ValueError(f"latin1 must be 'file', 'line' or 'off', not {latin1!r}")
    return lines if blanks else lines.where(strip(F.col("value")) != "")


def as_text(value: Column) -> Column:
    """UTF-8 text, or the same bytes read as Latin-1."""
    return F.when(F.is_valid_utf8(value), value).otherwise(_as_latin1(value))


def _as_latin1(value: Column) -> Column:
    return F.decode(value.cast("binary"), "ISO-8859-1")


def latin1_fallback(lines: DataFrame) -> DataFrame:
    """Read every file that holds a line outside UTF-8 as Latin-1, all of it.

    The lines are scanned once: they are written as bytes with a mark on those outside UTF-8, and which way a file is read is
    settled on reading them back, from the marks alone. Their ids are those written, whatever scans follow.
    """
    others = [c for c in lines.columns if c != "value"]
    held = through_table(
        lines.select(*others, F.col("value").cast("binary").alias("_bytes"), F.coalesce(~F.is_valid_utf8("value"), F.lit(False)).alias("_odd")),
        "raw-lines",
    )
    odd = held.where("_odd").select("source_file").distinct().withColumn("_latin1", F.lit(True))
    joined = held.join(odd, "source_file", "left")
    text = F.when(F.col("_latin1"), F.decode(F.col("_bytes"), "ISO-8859-1")).otherwise(F.col("_bytes").cast("string"))
    return joined.withColumn("value", text).select(*lines.columns)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source_file`` and ``bytes`` of each file; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select(
        # Spelled as the lines' source_file is, so the two join.
        F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("bytes")
    )


def extension_filter(files: DataFrame, suffixes: tuple[str, ...] = LOG_SUFFIXES) -> DataFrame:
    """Files with an accepted suffix."""
    name = F.lower("source_file")
    keep = F.lit(False)
    for suffix in suffixes:
        keep = keep | F.endswith(name, F.lit(suffix))
    return files.where(keep)


def size_guard(
    files: DataFrame,
    lines: DataFrame | None = None,
    max_bytes: int = MAX_FILE_BYTES,
    max_unpacked_bytes: int = MAX_UNPACKED_BYTES,
) -> DataFrame:
    """Each file with ``verdict``: ``ok``, ``too_large`` or, when ``lines`` is given, ``unpacks_too_large``."""
    over = F.when(F.col("bytes") > max_bytes, "too_large")
    if lines is None:
        return files.withColumn("verdict", F.coalesce(over, F.lit("ok")))
    unpacked = lines.groupBy("source_file").agg(F.sum(F.octet_length("value") + 1).alias("unpacked_bytes"))
    bomb = F.when(F.endswith("source_file", F.lit(".gz")) & (F.col("unpacked_bytes") > max_unpacked_bytes),
                  "unpacks_too_large")
    return files.join(unpacked, "source_file", "left").withColumn(
        "verdict", F.coalesce(over, bomb, F.lit("ok"))
    )


def read_heads(files: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    """First ``n`` lines of each listed file, without scanning the rest of it.

    Opens each file where the executors can reach it, so detection over a large folder costs a few
    kilobytes per file. For stores Python cannot open use ``sample_head`` over the lines instead.
    """
    schema = "source_file string, line_no bigint, value string"

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["source_file"]:
                head = _head_bytes(path, n)
                try:
                    text = [line.decode("utf-8") for line in head]
                except UnicodeDecodeError:
                    text = [line.decode("latin-1") for line in head]
                yield pd.DataFrame({
                    "source_file": path,
                    "line_no": range(1, len(text) + 1),
                    "value": [line.rstrip("\r\n") for line in text],
                })

    return files.select("source_file").mapInPandas(heads, schema)


def _head_bytes(path: str, n: int) -> list[bytes]:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        if stream is raw:
            # pyarrow streams read bytes, not lines.
            import io

            stream = io.BufferedReader(raw)
        out = []
        for _ in range(n):
            line = stream.readline()
            if not line:
                break
            out.append(line)
        return out


def read_windows_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of Event Viewer CSV exports, whose quoted messages span lines.

    The header row is skipped, blank rows are dropped, short rows padded; cells count by position. Such
    files cannot be split, so parallelism is per file.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(6)])
    rows = spark.read.csv(
        paths, schema=schema, header=True, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True,
    ).select(
        F.array(*[F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(6)]).alias("_cells"),
        F.col("_metadata.file_path").alias("source_file"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    return export_records(rows.where(F.exists("_cells", lambda c: strip(c) != ""))).select(
        "line_id", "source_file", *RECORD_FIELDS
    )
