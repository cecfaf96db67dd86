"""Mix sources to target shares of words by Pareto order sampling.

A source is taken ``target / size`` times. The whole part is certain: every document gets so many copies. The words that are left of the
target are a sample of documents taken once more, with inclusion probabilities in proportion to their sizes, ``p = rate * size``; ``rate``
makes the expected words those that are left. Documents that would get a probability above one are taken for certain, and the rate is that
of the others. Each document draws a random number from its id; its rank is the random odds divided by the inclusion odds, and documents
are taken by rank as long as they fit into the words that are left. The last place goes to the document whose size is nearest to what is
missing then, so a source ends as near its target as one document can bring it.

Ranks are first counted in buckets, so that only the bucket in which a source ends is ever sorted, however large it is; rates are found
from the different sizes of a source and their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

WEIGHTS, MOST = (1, 2, 3), 3
BUCKETS = 1 << 14


def words(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Target words of each source, from ``source, source_size``: shares of the whole by weight, nowhere above ``most`` times the
    source; what is above is shared out again by weight until nothing is above.

    Weights repeat over the sources in the order of their code points, null last. Sources are numbered across partitions, and a
    round of sharing sends the driver three sums.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    kinds = [sizes.schema[c].dataType.simpleString() for c in ("source", "source_size")]
    weight = F.array(*map(F.lit, weights))[(F.col("n") % len(weights)).cast("int")].cast("double")
    numbered = spark.createDataFrame(ordered, f"source {kinds[0]}, source_size {kinds[1]}, n long")
    numbered = written(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "sources")
    whole = numbered.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:
        above = F.col("weight") * level > F.col("cap") if before is not None else F.lit(False)
        capped, free = numbered.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        before, level = level if before is not None else -1.0, (whole - (capped or 0.0)) / free if free else level
    return numbered.select("source", "source_size", F.least(F.col("weight") * level, "cap").alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Decide for every row: ``_row`` (its number in the written copy), ``doc_id, source, size, source_size, target, copies, taken``.

    Rows repeat as they do in the input; rows alike in id, source and size are interchangeable. Null texts have size 0 and are
    taken 0 times, a null source is a source. Reruns agree, since random numbers come from ids.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    return decide(written(narrow.withColumn("_row", F.monotonically_increasing_id()), "sizes"), seed, weights, most)


def rates(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, rate, top, competing``: inclusion probabilities are ``rate * size`` up to size ``top`` and 1 above, which makes
    ``rest`` words in all; ``competing`` of them are left to the documents up to ``top``."""
    counts = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("double").alias("number"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("number") * F.col("size") * F.col("size")
    counts = counts.withColumns({
        "above": F.coalesce(F.sum(F.col("number") * F.col("size")).over(larger), F.lit(0.0)),
        "squares": F.sum(square).over(Window.partitionBy("source")) - F.coalesce(F.sum(square).over(larger), F.lit(0.0)),
    })
    both = counts.alias("c").join(plan.select(F.col("source").alias("_source"), "rest").alias("p"), F.col("c.source").eqNullSafe(F.col("_source")))
    both = both.withColumn("left", F.col("rest") - F.col("above")).where("left >= 0").withColumn("rate", F.col("left") / F.col("squares"))
    fits = both.where(F.col("rate") * F.col("size") <= 1 + 1e-12)
    best = fits.groupBy("source").agg(F.max(F.struct("size", "rate", "left")).alias("best"))
    return best.select("source", F.col("best.rate").alias("rate"), F.col("best.size").alias("top"), F.col("best.left").alias("competing"))


def decide(rows: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The same from written rows ``doc_id, source, size, _row``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most).withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("certain", F.floor(F.col("times") + 1e-12))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    found = rates(rows, plan).withColumnRenamed("source", "_source")
    plan = plan.join(found, plan.source.eqNullSafe(F.col("_source")), "left").drop("_source")
    plan = written(plan, "plan")

    same = rows.source.eqNullSafe(F.col("plan.source"))
    joined = rows.join(plan.alias("plan"), same).drop(plan.source)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("mix"), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    chance = F.least(F.col("rate") * F.col("size"), F.lit(1.0))
    odds = draw / (1 - draw) * (1 - chance) / chance
    competes = (F.col("size") > 0) & (F.col("size") <= F.col("top")) & (F.col("rate") > 0)
    ranked = joined.withColumn("rank", F.when(competes, odds / (1 + odds)))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))

    # Where each source ends: the first bucket that its remaining words do not cover.
    filled = ranked.where("bucket IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.first("competing").alias("competing"))
    run = Window.partitionBy("source").orderBy("bucket")
    filled = filled.withColumn("upto", F.sum("held").over(run)).where(F.col("upto") > F.col("competing"))
    ends = filled.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("held")).alias("before"))).alias("end"))
    ends = written(ends.select("source", F.col("end.bucket").alias("last"), F.col("end.before").alias("before")), "ends")
    placed = ranked.alias("r").join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left").drop(F.col("e.source"))

    # Only the rows of those buckets are put in order.
    edge = placed.where(F.col("bucket") == F.col("last"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "_row")
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = written(edge.select("source", "doc_id", "size", "_row", "rank", "upto", "competing", (F.col("upto") <= F.col("competing")).alias("fits")), "edge")
    # What is missing then, and the document nearest to it among all that are not taken.
    reached = edge.groupBy("source").agg(F.max(F.when(F.col("fits"), F.col("upto"))).alias("reached")).withColumnRenamed("source", "_source")
    missing = ends.join(reached, ends.source.eqNullSafe(F.col("_source"))).join(
        plan.select(F.col("source").alias("_plan"), "competing"), ends.source.eqNullSafe(F.col("_plan"))
    ).select("source", (F.col("competing") - F.coalesce("reached", "before")).alias("missing"))
    behind = placed.where(F.col("bucket") > F.col("last")).select("source", "doc_id", "size", "_row", "rank")
    behind = behind.unionByName(edge.where(~F.col("fits")).select("source", "doc_id", "size", "_row", "rank"))
    missing = missing.withColumnRenamed("source", "_source")
    near = behind.join(missing, behind.source.eqNullSafe(F.col("_source"))).where(F.abs(F.col("missing") - F.col("size")) < F.col("missing"))
    last = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("missing") - F.col("size")).alias("off"), "rank", "doc_id", "size", "_row")).alias("one"))
    taken = written(edge.where("fits").select("_row").unionByName(last.select("one._row")).withColumn("in_edge", F.lit(1)), "edge-taken")

    extra = F.when((F.col("rest") > 0) & (F.col("size") > F.col("top")), 1).when(F.col("bucket").isNull(), 0)
    extra = extra.when(F.col("bucket") < F.coalesce("last", F.lit(BUCKETS)), 1).otherwise(F.coalesce("in_edge", F.lit(0)))
    whole = placed.join(taken, "_row", "left").withColumn("copies", F.when(F.col("size") > 0, F.col("certain") + extra).otherwise(0))
    whole = whole.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return whole.select("_row", "doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), "taken")
