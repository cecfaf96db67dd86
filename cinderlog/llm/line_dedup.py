"""Remove passages of several lines that repeat across documents, by content-defined chunks. DataFrame functions only.

A rolling hash over the hashes of neighbouring lines ends a chunk wherever it is divisible, so the same lines give the same chunks
wherever they stand. Chunks of two lines or more are grouped by their text, that is byte by byte; of every repeated one the first
occurrence, by document id and place, stays. Texts are shuffled once to be compared and once to be rebuilt; in between only
places move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, written

#: A chunk ends where the rolling hash is divisible by this, so it has as many lines on average.
DIVISOR, LEAST_LINES = 3, 2
_PLACE = 1 << 31
#: Occurrences from which those of a bucket of chunks are dealt to SALT parts, and the number of buckets.
OFTEN, SALT, BUCKETS = 1000, 16, 1 << 16


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's md5 as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame, text: str, divisor: int = DIVISOR) -> DataFrame:
    """Add ``_lines`` and ``_chunks``: for every chunk its first line times 2**31 plus its number of lines, in order.

    The lambdas look at elements only, and the generator keeps the optimizer from copying one step into the next, so a text is
    split once and every line hashed twice, whatever the length.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    docs = docs.withColumn("_step", F.explode(F.array(F.struct(lines.alias("lines")))))
    own = F.col("_step.lines")
    # The line before: a shift by one. The last line ends its chunk anyway.
    before = F.concat(F.array(F.lit("")), own)
    rolling = F.zip_with(own, before, lambda l, b: F.when(b.isNotNull() & l.isNotNull(), (line_hash(l) + 31 * line_hash(b)) % divisor))
    docs = docs.withColumn("_step2", F.explode(F.array(F.struct(F.slice(rolling, 1, F.size(own) - 1).alias("rolling"), (F.size(own) - 1).alias("last")))))
    inner = F.filter(F.transform("_step2.rolling", lambda r, i: F.when(r == 0, i)), lambda i: i.isNotNull())
    docs = docs.withColumn("_step3", F.explode(F.array(F.struct(F.concat(inner, F.array("_step2.last")).alias("ends")))))
    starts = F.concat(F.array(F.lit(0)), F.transform("_step3.ends", lambda e: e + 1))
    chunks = F.filter(
        F.zip_with(starts, "_step3.ends", lambda s, e: s.cast("long") * _PLACE + (e - s + 1)), lambda c: c.isNotNull()
    )
    docs = docs.withColumn("_step4", F.explode(F.array(F.struct(chunks.alias("chunks")))))
    return docs.withColumns({"_lines": F.col("_step.lines"), "_chunks": F.col("_step4.chunks")}).drop("_step", "_step2", "_step3", "_step4")


def _text_of(chunk: Column, lines: Column) -> Column:
    return F.array_join(F.slice(lines, F.shiftright(chunk, 31).cast("int") + 1, chunk.bitwiseAND(_PLACE - 1).cast("int")), "\n")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("mark"), F.lit(BUCKETS)).alias("bucket")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = DIVISOR, least: int = LEAST_LINES) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``n_lines`` and ``kept_lines``, which replace columns so named.

    The first occurrence by id (null first), then by row and place, stays. A null text stays null, with 0 lines; a text of which
    everything is removed becomes empty, with 0 kept lines. Lines are separated by line ends; chunks of one line always stay. Repeated
    rows are rows of their own: the second one loses what the first keeps. Other columns stay as they are, whatever their names; an empty
    table gives an empty one. The rows are written once, with a number each, so that all later scans mean the same row by it.
    """
    docs = docs.drop("n_lines", "kept_lines")
    others = [c for c in docs.columns if c != text]
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    packed = F.struct(*[name(c) for c in others]) if others else F.lit(None).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), name(key).alias("_key"), name(text).alias("_text"), packed.alias("_others"))
    rows = written(rows, "line-rows")
    cut = with_chunks(rows.select("_row", "_key", "_text"), "_text", divisor)
    whole = F.filter("_chunks", lambda c: c.bitwiseAND(_PLACE - 1) >= least)
    cut = cut.withColumn("_whole", F.explode(F.array(F.struct(whole.alias("chunks"), F.col("_lines").alias("lines")))))
    bodies = cut.select(F.explode(F.transform("_whole.chunks", lambda c: _text_of(c, F.col("_whole.lines")))).alias("body"))
    # Grouping by the text itself is the byte comparison; an md5 that two texts share would be set aside.
    groups = bodies.groupBy("body").count().select(F.md5(F.col("body").cast("binary")).alias("mark"), "count")
    repeated = groups.groupBy("mark").agg(F.sum("count").alias("n"), F.count("*").alias("texts")).where("n > 1 AND texts = 1").select("mark", "n")
    repeated = written(repeated, "repeated-chunks")

    # Chunks that occur very often are dealt to several tasks, by row. Whether a chunk may be one is looked up in at most BUCKETS numbers.
    hot = F.broadcast(repeated.groupBy(_bucket()).agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN).select("bucket", F.lit(True).alias("hot")))

    def dealt(df: DataFrame, number: Column) -> DataFrame:
        return df.join(hot, df.bucket == hot.bucket, "left").drop("bucket").withColumn("salt", F.when(F.col("hot"), number).otherwise(F.lit(0))).drop("hot")

    def to_all(df: DataFrame) -> DataFrame:
        every = df.withColumn("bucket", _bucket()).join(hot, "bucket", "left").drop("bucket")
        return every.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("hot")

    marks = F.transform("_whole.chunks", lambda c: F.struct(c.alias("chunk"), F.md5(_text_of(c, F.col("_whole.lines")).cast("binary")).alias("mark")))
    places = cut.select("_row", "_key", F.explode(marks).alias("m")).select("_row", "_key", "m.chunk", "m.mark")
    places = dealt(places.withColumn("bucket", _bucket()), F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int"))
    places = written(places.join(to_all(repeated.select("mark")), ["mark", "salt"]), "repeated-places")
    first = places.groupBy("mark").agg(F.min(F.struct("_key", "_row", "chunk")).alias("first"))
    later = places.join(to_all(first), ["mark", "salt"]).where((F.col("_row") != F.col("first._row")) | (F.col("chunk") != F.col("first.chunk")))
    gone = written(later.groupBy("_row").agg(F.collect_list("chunk").alias("_gone")), "repeated-gone")
    discard(places, repeated)

    kept = with_chunks(rows.join(gone, "_row", "left"), "_text", divisor)
    left = F.array_except("_chunks", F.coalesce("_gone", F.array().cast("array<bigint>")))
    kept = kept.withColumn("_left", F.explode(F.array(F.struct(left.alias("chunks"), F.col("_lines").alias("lines")))))
    body = F.array_join(F.transform("_left.chunks", lambda c: _text_of(c, F.col("_left.lines"))), "\n")
    count = F.aggregate("_left.chunks", F.lit(0).cast("long"), lambda n, c: n + c.bitwiseAND(_PLACE - 1))
    there = F.col("_text").isNotNull()
    made = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(body)
    return kept.select(
        *[made.alias(c) if c == text else F.col("_others")[c].alias(c) for c in docs.columns],
        F.when(there, F.size("_lines")).otherwise(0).alias("n_lines"), F.when(there, count).otherwise(0).cast("int").alias("kept_lines"),
    )


#: The same over the table ``documents`` (ids are unique there).
SQL = f"""
WITH lines AS (
  SELECT doc_id, text IS NULL AS missing, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (
  SELECT *, coalesce((h + 31 * lag(h, 1, ('0x' || substr(md5(''), 1, 8))::BIGINT) OVER (PARTITION BY doc_id ORDER BY i)) % {DIVISOR} = 0, false) AS ends
  FROM hashed
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled
), chunks AS (
  SELECT doc_id, missing, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY ALL
), placed AS (
  SELECT *, n < {LEAST_LINES} OR row_number() OVER (PARTITION BY body, n >= {LEAST_LINES} ORDER BY doc_id, chunk) = 1 AS stays FROM chunks
)
SELECT doc_id, CASE WHEN missing THEN NULL ELSE coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (stays), '') END AS text,
       (CASE WHEN missing THEN 0 ELSE sum(n) END)::INT AS n_lines, (CASE WHEN missing THEN 0 ELSE coalesce(sum(n) FILTER (stays), 0) END)::INT AS kept_lines
FROM placed GROUP BY doc_id, missing
"""
