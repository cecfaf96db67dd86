"""Format detection as an aggregation per file over a small head sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from .formats import (
    DEFAULT_YEAR, WINDOWS_EXPORT_CELLS, WINDOWS_LEVELS, Format, csv_cells, has_cell, known_formats,
)
from .parsing import with_stages

# Detection threshold, tie margin, suffix bonus and the weights of the composite score.
THRESHOLD = 0.6
AMBIGUITY_MARGIN = 0.02
SUFFIX_BONUS = 0.05
COMPOSITE_WEIGHTS = {
    "match_score": 0.30, "parse_quality": 0.25, "extraction": 0.25, "timestamp_quality": 0.15, "numeric_valid": 0.05,
}
EXPORT_HEADER_SCORE = 0.95
EXPORT_ROW_SCORE = 0.90


def sample_head(lines: DataFrame, n: int = 50, order: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """First ``n`` lines of each file with ``line_no``.

    The row-number limit is applied before the shuffle as well, so at most ``n`` lines per file and task
    move. Pass the lines of first blocks only (``block_start = 0``) where files are large, or use
    ``read_heads``, which does not scan.
    """
    w = Window.partitionBy("source_file").orderBy(*order)
    return (
        lines.withColumn("line_no", F.row_number().over(w).cast("bigint"))
        .where(F.col("line_no") <= n)
        .select("source_file", "line_no", "value")
    )


def format_quality(sample: DataFrame, year: int = DEFAULT_YEAR) -> DataFrame:
    """Per file and format: lines, matched, parsed and the ratios behind the composite score."""
    formats = known_formats(year)
    trimmed = sample.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
    staged = with_stages(trimmed, list(formats.values()), lambda column, users: column)

    per_line, sums = [], []
    for name, fmt in formats.items():
        match = F.coalesce(fmt.matches(F.col("value")), F.lit(False))
        per_line.append(match.alias(f"{name}__match"))
        sums.append(F.count_if(f"`{name}__match`").alias(f"{name}__matched"))
        if not fmt.declared:
            continue
        ok = match & F.coalesce(fmt.parsed(), F.lit(False))
        fields = fmt.fields()
        present = sum((fields[n].isNotNull().cast("int") for n in fmt.declared), F.lit(0))
        per_line += [
            ok.alias(f"{name}__ok"),
            F.when(ok, present / len(fmt.declared)).alias(f"{name}__present"),
            (ok & fields["timestamp"].isNotNull()).alias(f"{name}__timed"),
        ]
        sums += [
            F.count_if(f"`{name}__ok`").alias(f"{name}__parsed"),
            F.avg(f"`{name}__present`").alias(f"{name}__extraction"),
            F.count_if(f"`{name}__timed`").alias(f"{name}__timed"),
        ]
    wide = (
        staged.select("source_file", "line_no", "value", *per_line)
        .groupBy("source_file")
        .agg(F.count(F.lit(1)).alias("lines"), F.min_by("value", "line_no").alias("first_line"), *sums)
    )
    rows = []
    for name, fmt in formats.items():
        composite = bool(fmt.declared)
        rows.append(F.struct(
            F.lit(name).alias("format"),
            F.lit(fmt.priority).alias("priority"),
            F.lit(fmt.scoring).alias("scoring"),
            F.lit(fmt.weight).alias("weight"),
            F.array(*[F.lit(e) for e in fmt.extensions]).cast("array<string>").alias("extensions"),
            F.col(f"`{name}__matched`").alias("matched"),
            (F.col(f"`{name}__parsed`") if composite else F.lit(None).cast("bigint")).alias("parsed"),
            (F.col(f"`{name}__extraction`") if composite else F.lit(None).cast("double")).alias("extraction_ratio"),
            (F.col(f"`{name}__timed`") if composite else F.lit(None).cast("bigint")).alias("timed"),
        ))
    return wide.select("source_file", "lines", "first_line", F.inline(F.array(*rows)))


def format_match_rates(quality: DataFrame) -> DataFrame:
    """Matched share of the sampled lines, per file and format."""
    return quality.select(
        "source_file", "format", "lines", "matched", (F.col("matched") / F.col("lines")).alias("match_rate")
    )


def _first_line_score() -> Column:
    cells = csv_cells(F.col("first_line"))
    header = has_cell(cells, WINDOWS_EXPORT_CELLS)
    known = F.upper(strip(F.get(cells, F.lit(0)))).isin(*WINDOWS_LEVELS)
    return F.when(header, EXPORT_HEADER_SCORE).when((F.size(cells) >= 4) & known, EXPORT_ROW_SCORE)


def format_scores(quality: DataFrame) -> DataFrame:
    """Confidence per file and format with its weighted parts, before and after the suffix bonus.

    The parts are filled for composite scores only.
    """
    w = COMPOSITE_WEIGHTS
    some = F.col("parsed") > 0
    part = lambda ratio, name: F.when(some, ratio * w[name]).when(F.col("parsed") == 0, 0.0)
    tabular = F.when(F.col("scoring") == "tabular", _first_line_score())
    scored = quality.withColumns({
        "match_rate": F.col("matched") / F.col("lines"),
        "fixed_score": tabular,
    }).withColumns({
        "match_score": part(F.col("match_rate"), "match_score"),
        "parse_quality": part(F.col("parsed") / F.col("lines"), "parse_quality"),
        "extraction": part(F.col("extraction_ratio"), "extraction"),
        "timestamp_quality": part(F.col("timed") / F.col("parsed"), "timestamp_quality"),
        # Typed columns cannot hold a badly typed number, so every parsed line is valid.
        "numeric_valid": part(F.lit(1.0), "numeric_valid"),
    })
    parts = list(w)
    composite = F.least(F.lit(1.0), sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    raw = F.coalesce(
        F.col("fixed_score"),
        F.when(F.col("scoring") == "flat", F.col("match_rate") * F.col("weight")),
        composite,
    )
    boosted = F.when(
        (F.col("base_score") > 0) & F.exists("extensions", lambda e: F.endswith(F.col("source_file"), e)),
        F.least(F.lit(1.0), F.col("base_score") + SUFFIX_BONUS),
    ).otherwise(F.col("base_score"))
    no_parts = F.col("fixed_score").isNotNull()
    return scored.withColumn("base_score", raw).withColumn("confidence", boosted).select(
        "source_file", "format", "priority", "base_score", "confidence",
        *[F.when(~no_parts, F.round(F.col(p), 4)).alias(p) for p in parts],
    )


def rank_formats(scores: DataFrame) -> DataFrame:
    """Non-zero scores with ``rank``: confidence, then priority, then name."""
    w = Window.partitionBy("source_file").orderBy(F.desc("confidence"), F.desc("priority"), "format")
    return scores.where(F.col("confidence") > 0).withColumn("rank", F.row_number().over(w))


def detect_formats(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: ``format`` (``unknown`` below the threshold), ``confidence``, ``ambiguous``, ``reason``.

    The group is the handful of known formats of one file, so the lists are bounded by that number.
    """
    w = Window.partitionBy("source_file")
    best = F.max(F.struct("confidence", "priority", F.lit(0))).over(w)
    close = (best["confidence"] - F.col("confidence") <= AMBIGUITY_MARGIN) & (F.col("rank") > 1)
    ranked = rank_formats(scores).withColumn("_close", close)
    pct = lambda c: F.round(c * 100).cast("bigint").cast("string")
    limit = str(round(threshold * 100))
    per_file = ranked.groupBy("source_file").agg(
        F.min_by("format", "rank").alias("best"),
        F.max("confidence").alias("best_confidence"),
        F.array_sort(
            F.collect_list(F.when(F.col("_close"), F.struct("rank", "format", "confidence")))
        ).alias("_alternatives"),
    )
    files = scores.select("source_file").distinct().join(per_file, "source_file", "left")
    won = F.coalesce(F.col("best_confidence") >= threshold, F.lit(False))
    names = F.transform(
        "_alternatives",
        lambda a: F.concat(F.lit("'"), a["format"], F.lit("' ("), pct(a["confidence"]), F.lit("%)")),
    )
    reason = (
        F.when(
            won,
            F.concat(
                F.lit("Selected parser '"), F.col("best"), F.lit("' with "), pct(F.col("best_confidence")),
                F.lit(f"% confidence (detection threshold: {limit}%)."),
                F.when(F.size("_alternatives") > 0,
                       F.concat(F.lit(" Compatible formats: "), F.array_join(names, ", "), F.lit(".")))
                .otherwise(F.lit("")),
            ),
        )
        .when(
            F.col("best").isNotNull(),
            F.concat(F.lit("Best match '"), F.col("best"), F.lit("' scored "), pct(F.col("best_confidence")),
                     F.lit(f"%, which is below threshold {limit}%.")),
        )
        .otherwise(F.lit("No registered parser exceeded the confidence threshold."))
    )
    empty = F.array().cast("array<string>")
    return files.select(
        "source_file",
        F.when(won, F.col("best")).otherwise("unknown").alias("format"),
        F.when(won, F.col("best_confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        (won & (F.size("_alternatives") > 0)).alias("ambiguous"),
        F.when(won, F.transform("_alternatives", lambda a: a["format"])).otherwise(empty).alias("alternatives"),
        reason.alias("reason"),
    )


def fallback_format(scores: DataFrame, winners: DataFrame) -> DataFrame:
    """For files no format won: the first format, by priority, that scored at all."""
    first = scores.where(F.col("base_score") > 0).groupBy("source_file").agg(
        F.min_by("format", F.struct(-F.col("priority"), "format")).alias("_first")
    )
    unknown = F.col("format") == "unknown"
    return winners.join(first, "source_file", "left").withColumn(
        "format", F.when(unknown, F.coalesce("_first", "format")).otherwise(F.col("format"))
    ).drop("_first")


def detect(sample: DataFrame, threshold: float = THRESHOLD, fallback: bool = False, year: int = DEFAULT_YEAR) -> DataFrame:
    """Detected format per file from a head sample (``source_file``, ``line_no``, ``value``)."""
    scores = format_scores(format_quality(sample, year))
    winners = detect_formats(scores, threshold)
    return fallback_format(scores, winners) if fallback else winners


def list_formats(spark, year: int = DEFAULT_YEAR) -> DataFrame:
    """Catalogue of the known formats, by priority then name."""
    rows = [(f.name, f.description, f.priority, list(f.extensions)) for f in known_formats(year).values()]
    return spark.createDataFrame(
        rows, "name string, description string, priority int, extensions array<string>"
    ).orderBy(F.desc("priority"), "name")
