"""Small helpers for aggregates that take any grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Keys = list[str]


def ranked_per_key(df: DataFrame, keys: Keys, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows, per key if there are keys. Both forms keep only ``n`` rows per task before a shuffle."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def join_on(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL is a key like any other; the keys appear once."""
    names = [f"_right_{i}" for i in range(len(keys))]
    right = right.withColumnsRenamed(dict(zip(keys, names)))
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return left.join(right, same, how).drop(*names)


#: Rows of a bucket of keys from which they are dealt to PARTS tasks, and the number of buckets.
OFTEN, PARTS, BUCKETS = 100_000, 32, 1 << 16


def join_dealt(
    many: DataFrame, few: DataFrame, keys: Keys, rows: Column, often: int = OFTEN, parts: int = PARTS
) -> DataFrame:
    """``join_on`` of ``many`` rows per key with one row per key of ``few``, where some keys may own a large share of all rows.

    ``rows``, over ``few``, is the number of rows of ``many`` with the key. Keys fall into a fixed number of buckets; rows of buckets
    that hold many are dealt over several tasks, and their keys are sent to each of these. The table of such buckets, at most
    ``BUCKETS`` numbers, is the only one broadcast.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = few.select(bucket.alias("_bucket"), rows.alias("_rows")).groupBy("_bucket").agg(F.sum("_rows").alias("_rows"))
    hot = F.broadcast(sizes.where(F.col("_rows") > often).select("_bucket", F.lit(True).alias("_hot")))
    own = F.pmod(F.xxhash64(*many.columns), F.lit(parts)).cast("int")
    left = many.withColumn("_bucket", bucket).join(hot, "_bucket", "left")
    left = left.withColumn("_part", F.when(F.col("_hot"), own).otherwise(F.lit(0))).drop("_bucket", "_hot")
    right = few.withColumn("_bucket", bucket).join(hot, "_bucket", "left")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_part", F.explode(every)).drop("_bucket", "_hot")
    return join_on(left, right, [*keys, "_part"]).drop("_part")


def with_totals(df: DataFrame, totals: DataFrame, keys: Keys) -> DataFrame:
    """Add the columns of ``totals`` (one row per key): a scalar subquery without keys, an equi-join with."""
    if keys:
        return join_on(df, totals, keys)
    names = [c for c in totals.columns if c not in keys]
    return df.select("*", *[totals.select(n).scalar().alias(n) for n in names])


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
