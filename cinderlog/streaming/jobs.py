"""Structured Streaming jobs over a log folder, built from the batch expressions.

Late rows: a row older than the watermark (newest time seen minus ``WATERMARK``) is dropped by the jobs
that keep state; stateless jobs keep every row. Windows and sessions are emitted once, when the watermark
passes their end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import Fields, is_error_level
from ..functions.text import strip
from ..operators.formats import DEFAULT_YEAR, Format
from ..operators.detection import detect
from ..operators.exports import export_files
from ..operators.parsing import parse_auto, parse_lines
from ..operators.rules import Rule, evaluate_rules, rules_table
from ..operators.security import SIGNATURES, security_signals
from ..operators.sessions import is_failed_login, is_login_path
from ..session import through_table
from ..sources.exports import json_line
from ..sources.files import read_heads, read_log_lines

WATERMARK = "10 minutes"


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Non-blank lines of new files below ``path``."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        # Lines have no number across micro-batches; the byte range and text identify where they came from.
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "value").alias("line_id"),
        F.col("_metadata.file_path").alias("source_file"),
        "value",
    ).where(strip(F.col("value")) != "")


def stream_parse(
    spark: SparkSession, path: str, fmt: str | Format, year: int = DEFAULT_YEAR, files_per_trigger: int | None = None
) -> DataFrame:
    """Records as they arrive, bad lines kept. The same projection as the batch parse."""
    return parse_lines(stream_lines(spark, path, files_per_trigger), fmt, year)


def stream_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files below ``path`` (``source_file``, ``bytes``); their contents are not read."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("bytes"))


def run_parse_auto(
    files: DataFrame, out: str, checkpoint: str, year: int = DEFAULT_YEAR, heads: Callable[[DataFrame], DataFrame] = read_heads
) -> StreamingQuery:
    """Records of new files, each read in the format its own head shows: the streaming form of ``parse_auto``.

    A file arrives whole in one micro-batch, so its format is found there, from its first lines, and holds for all of it; exports whose
    records span lines are assembled. Records go below ``out/records`` and the formats found below ``out/formats``, a folder per
    micro-batch. ``heads`` gives the first lines of files. The names of a micro-batch's files pass the driver, as they do in the file
    source itself; ``files_per_trigger`` bounds their number.
    """

    def handle(chunk: DataFrame, number: int) -> None:
        spark = chunk.sparkSession
        names = [r.source_file for r in chunk.select("source_file").collect()]
        if not names:
            return
        sample = through_table(heads(spark.createDataFrame([(n,) for n in names], "source_file string")), "heads")
        path = f"{out}/formats/chunk={number}"
        found = detect(sample, year=year)
        found.write.mode("overwrite").parquet(path)
        winners = spark.read.schema(found.schema).parquet(path)
        exports = through_table(export_files(sample, winners), "export-files")
        some = not exports.isEmpty()
        lines = read_log_lines(spark, names, blanks=some)
        records = parse_auto(lines, winners, year, exports=exports if some else None)
        records.drop("block_start").write.mode("overwrite").parquet(f"{out}/records/chunk={number}")

    return run_chunks(files, handle, checkpoint)


def run_to_table(df: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append the stream to files until the input that is there now is used up."""
    return (
        df.writeStream.format(fmt).outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_json_sink(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append records as JSON lines."""
    return run_to_table(records.select(json_line(records).alias("value")), out, checkpoint, "text")


def run_chunks(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "append"
) -> StreamingQuery:
    """Hand each micro-batch to ``handle(chunk, number)``.

    A batch can be handed over again after a failure, so ``handle`` should write by number.
    """
    return (
        df.writeStream.outputMode(output_mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_chunk(out: str) -> Callable[[DataFrame, int], None]:
    """A chunk writer that replaces its own folder when a batch is repeated."""

    def handle(chunk: DataFrame, number: int) -> None:
        chunk.write.mode("overwrite").parquet(f"{out}/chunk={number}")

    return handle


def window_metrics(records: DataFrame, window: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Totals, errors, 5xx, bytes and p95 latency per tumbling window.

    The percentile is the mergeable summary: an exact one would keep every value in state.
    """
    f = Fields(records)
    code = f.status()
    return (
        records.select(
            f.timestamp().alias("timestamp"), f.level().alias("level"), code.alias("code"),
            f.response_size().alias("bytes"), f.latency().alias("latency"),
        )
        .where(F.col("timestamp").isNotNull())
        .withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", window))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(is_error_level(F.col("level"))).alias("total_errors"),
            F.count_if(F.substring(F.col("code").cast("string"), 1, 1) == "5").alias("status_5xx"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
            F.percentile_approx("latency", 0.95).alias("p95_ms"),
        )
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "total_requests", "total_errors", "status_5xx", "total_bytes", "p95_ms",
        )
    )


def window_bursts(records: DataFrame, minutes: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """Average and peak requests per second of each window: seconds first, then windows over the seconds."""
    seconds = (
        records.select(Fields(records).timestamp().alias("timestamp"))
        .where(F.col("timestamp").isNotNull())
        .withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 second").alias("second"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    average = F.sum("requests") / float(minutes * 60)
    return (
        seconds.groupBy(F.window(F.window_time("second"), f"{minutes} minutes"))
        .agg(average.alias("average_rps"), F.max("requests").cast("double").alias("peak_rps"))
        .select(
            F.col("window.start").alias("window_start"), "average_rps", "peak_rps",
            (F.col("peak_rps") / F.col("average_rps")).alias("burst_ratio"),
            ((F.col("peak_rps") / F.col("average_rps") > 3.0) & (F.col("peak_rps") >= 5.0)).alias("is_bursting"),
        )
    )


def closed_sessions(records: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Sessions of named clients as they close.

    With the library's session settings (``session.SETTINGS``), rows of a busy client are merged in each task before they are shuffled,
    so it cannot overload one task.
    """
    f = Fields(records)
    path = F.coalesce(f.filled("path"), F.lit("/"))
    failed = is_failed_login(F.col("method"), F.col("path"), F.col("status_code"))
    return (
        records.where(~f.is_bad())
        .select(
            f.client_ip().alias("client_ip"), f.timestamp().alias("time"), f.method().alias("method"),
            path.alias("path"), f.status_or_200().alias("status_code"),
        )
        .where(F.col("time").isNotNull() & (F.col("client_ip") != "-"))
        .withWatermark("time", watermark)
        .groupBy("client_ip", F.session_window("time", gap))
        .agg(
            F.min("time").alias("start_time"), F.max("time").alias("end_time"),
            F.count(F.lit(1)).alias("request_count"), F.count_if(failed).alias("failed_logins"),
            F.count_if((F.col("method") == "POST") & is_login_path(F.col("path"))).alias("login_posts"),
        )
        .drop("session_window")
    )


def unnamed_visits(records: DataFrame) -> DataFrame:
    """Requests of unnamed clients: each is a session of its own, so no state is kept for them."""
    f = Fields(records)
    return (
        records.where(~f.is_bad() & (f.client_ip() == "-"))
        .select(f.client_ip().alias("client_ip"), f.timestamp().alias("start_time"))
        .where(F.col("start_time").isNotNull())
        .select("client_ip", "start_time", F.col("start_time").alias("end_time"),
                F.lit(1).cast("bigint").alias("request_count"))
    )


def window_rule_values(windows: DataFrame) -> DataFrame:
    """Closed windows as ``(window_start, selector, value)``."""
    total = F.col("total_requests")
    pairs = {
        "metadata.analyzed_records": total,
        "traffic.total_requests": total,
        "error.error_ratio": F.col("total_errors") / total,
        "status.http_5xx_rate": F.col("status_5xx") / total,
        "latency.p95_ms": F.col("p95_ms"),
        "bandwidth.bytes_per_second": F.col("total_bytes")
        / (F.unix_seconds("window_end") - F.unix_seconds("window_start")),
    }
    rows = [F.struct(F.lit(n).alias("selector"), v.cast("double").alias("value")) for n, v in pairs.items()]
    return windows.select("window_start", F.inline(F.array(*rows))).where(F.col("value").isNotNull())


#: Selectors that :func:`window_rule_values` fills.
WINDOW_SELECTORS = (
    "metadata.analyzed_records", "traffic.total_requests", "error.error_ratio", "status.http_5xx_rate", "latency.p95_ms",
    "bandwidth.bytes_per_second",
)


def run_rule_alerts(
    windows: DataFrame, out: str, checkpoint: str, rules: tuple[Rule, ...] | list[Rule]
) -> StreamingQuery:
    """Insights of every closed window of :func:`window_metrics`, written per micro-batch.

    The light form, for rules over the few measures such windows carry; other rules are refused. ``rules.run_window_rules`` takes all.
    """
    unfilled = sorted({r.selector for r in rules} - set(WINDOW_SELECTORS))
    if unfilled:
        raise ValueError(f"windows carry no value for {unfilled}; they carry {list(WINDOW_SELECTORS)}")
    write = write_chunk(out)

    def handle(chunk: DataFrame, number: int) -> None:
        values = window_rule_values(chunk)
        write(evaluate_rules(values, rules_table(chunk.sparkSession, rules), ["window_start"]), number)

    return run_chunks(windows, handle, checkpoint)


def security_hits(records: DataFrame) -> DataFrame:
    """Injection and probe hits as they arrive; no state."""
    f = Fields(records)
    signals = security_signals(records, [], {"time": f.timestamp()})
    names = [*SIGNATURES, "probe"]
    classes = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    return signals.select("time", "client_ip", "path", F.explode(classes).alias("signal"))
