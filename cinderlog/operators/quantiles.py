"""Percentiles with linear interpolation, exact at any size and for any range of values.

``percentile()`` keeps every distinct value of a group in one task. Here the values are first counted (combined before the shuffle) and
the counts laid into ordered buckets by sign, exponent and leading digits. Only buckets that hold a wanted rank are looked into; one that
still holds many values is laid into finer buckets, as often as it takes. No task ever orders more than a set number of values, and the
result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import through_table
from .grouping import Keys, join_on

#: Buckets per doubling of the value, and parts that a too large bucket is cut into.
_FINENESS = 64
_PARTS = 1024
#: Different values of a bucket that are put in order in one go.
MOST_VALUES = 10_000


def _bucket(value: Column) -> Column:
    """Ordered bucket of a number: never decreasing in the value, ``_FINENESS`` for each of about 2 100 exponents and sign."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # Where the logarithm is rounded over a power of two, the leading digits fall below 1 or reach 2 and make up for it.
    digits = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * _FINENESS)
    place = ((exponent + 1100) * _FINENESS + digits + 1).cast("bigint")
    edge = 1 << 40
    return (
        F.when(value == 0, F.lit(0).cast("bigint"))
        .when(F.isnan(value), F.lit(edge + 1))
        .when(size == float("inf"), F.signum(value).cast("bigint") * edge)
        # The smallest numbers are no longer stored with all their digits: one bucket.
        .when(size < 1e-300, F.signum(value).cast("bigint"))
        .when(value < 0, -place)
        .otherwise(place)
    )


def _part(value: Column) -> Column:
    """Part of its bucket that a number lies in; the least and the greatest are never in the same one."""
    share = (value - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def count_values(df: DataFrame, keys: Keys, value: Column) -> DataFrame:
    """``keys``, ``_v``, ``_n``: how often each value occurs."""
    return (
        df.select(*keys, value.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def exact_percentiles(
    df: DataFrame, keys: Keys, value: Column, percentiles: dict[str, float], most_values: int = MOST_VALUES
) -> DataFrame:
    """``keys`` + one column per name in ``percentiles`` (0 to 100); no row for a group without values."""
    return percentiles_of_counts(count_values(df, keys, value), keys, percentiles, most_values)


def percentiles_of_counts(
    counts: DataFrame, keys: Keys, percentiles: dict[str, float], most_values: int = MOST_VALUES
) -> DataFrame:
    """The same from ``keys``, ``_v`` and ``_n`` (how often the value occurs), one row per key and value."""

    def rank(p: float) -> Column:
        return (F.col("_total") - 1) * (p / 100.0)

    def holds(index: Column, start: Column, size: Column) -> Column:
        return (index >= start) & (index < start + size)

    wanted = F.lit(False)
    for p in percentiles.values():
        for edge in (F.floor(rank(p)), F.ceil(rank(p))):
            wanted = wanted | holds(edge, F.col("_start"), F.col("_size"))

    # Written: read for the sizes of the buckets and for the values in them.
    counts = through_table(counts, "value-counts")
    total = F.sum("_size").over(Window.partitionBy(*keys))
    inside = counts.select(
        *keys, "_v", "_n", F.lit(0.0).alias("_low"), F.lit(0.0).alias("_high"), F.lit(0).cast("bigint").alias("_before"),
        F.lit(None).cast("bigint").alias("_total"),
    )
    bucket = _bucket(F.col("_v"))
    while True:
        placed = inside.withColumn("_b", bucket)
        ordered = Window.partitionBy(*keys, "_low").orderBy("_b")
        sizes = placed.groupBy(*keys, "_low", "_b").agg(
            F.sum("_n").alias("_size"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count(F.lit(1)).alias("_values"),
            F.max("_before").alias("_before"), F.max("_total").alias("_total"),
        ).withColumns({
            "_start": F.col("_before") + F.sum("_size").over(ordered) - F.col("_size"),
            "_total": F.coalesce("_total", total),
        })
        held = through_table(
            sizes.where(wanted).select(*keys, "_low", "_b", "_least", "_most", "_values", "_start", "_total"), "rank-buckets"
        )
        inside = join_on(placed.select(*keys, "_low", "_b", "_v", "_n"), held, [*keys, "_low", "_b"]).select(
            *keys, "_v", "_n", F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.col("_start").alias("_before"), "_total"
        )
        largest = held.agg(F.max("_values")).first()[0]
        if not largest or largest <= most_values:
            break
        inside, bucket = through_table(inside, "rank-values"), _part(F.col("_v"))

    within = Window.partitionBy(*keys, "_low").orderBy("_v")
    values = inside.withColumn("_start", F.col("_before") + F.sum("_n").over(within) - F.col("_n"))
    at = lambda index: F.max(F.when(holds(index, F.col("_start"), F.col("_n")), F.col("_v")))
    aggs, out = [F.max("_total").alias("_total")], []
    for i, (name, p) in enumerate(percentiles.items()):
        aggs += [at(F.floor(rank(p))).alias(f"_lo{i}"), at(F.ceil(rank(p))).alias(f"_hi{i}")]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(hi == lo, lo).otherwise(lo + (hi - lo) * (rank(p) - F.floor(rank(p)))).alias(name))
    found = values.groupBy(*keys).agg(*aggs)
    return found.where(F.col("_total").isNotNull()).select(*keys, *out)


def approx_percentiles(
    df: DataFrame, keys: Keys, value: Column, percentiles: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Same shape from a mergeable summary of bounded size; opt-in."""
    probabilities = [p / 100.0 for p in percentiles.values()]
    sketch = F.percentile_approx(value.cast("double"), probabilities, accuracy)
    return (
        df.groupBy(*keys).agg(sketch.alias("_q")).where(F.col("_q").isNotNull())
        .select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(percentiles)])
    )


def percentile_table(df: DataFrame, keys: Keys, value: Column, percentiles: dict[str, float], method: str) -> DataFrame:
    if method == "exact":
        return exact_percentiles(df, keys, value, percentiles)
    if method == "approx":
        return approx_percentiles(df, keys, value, percentiles)
    raise ValueError(f"percentiles must be 'exact' or 'approx', not {method!r}")
