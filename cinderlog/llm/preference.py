"""Preference pairs as one prompt and two completions with a loss mask.

A pair is two conversations with one ``pair_id``: the preferred one and the other. Their longest common prefix of turns is the prompt
and is rendered once; what follows in each is its completion. Completions are rendered with the span of each turn that a model learns
from: the text and end mark of an assistant's turn. All else in a completion, and all of the prompt, is masked.

Results are rows of turns, not one text for each pair: a conversation may be a large part of the table. Turns are put in blocks of
turn numbers, so that places and offsets come from sums over blocks and then within a block, and no task sees a whole conversation.
What is read more than once is written to the shared folder first.

Defined cases: a null role or text is an empty one. Turns are ordered by number (null first), then role, then text; a repeated row
counts once. A null ``pair_id`` is a pair like any other. A pair with one side only has an empty prompt; equal sides have a prompt
only. Marks inside texts are left as they are, since the mask comes from spans and never from a search for marks. Other columns of the
input are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Turn layout: before the role, between role and text, after the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turn numbers of a block: 2 to this power.
_BLOCK = 10
_FIRST = -(1 << 62)


def _offset(df: DataFrame, keys: list[str], block: Column, order: list[str], amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over the rows before this one: over whole blocks first, then inside the block."""
    rows = df.withColumn("_block", block).withColumn("_amount", amount)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_block").alias("_of"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_block") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    return rows.join(sums, same).withColumn(name, place).select(*df.columns, name)


def _turns(conversations: DataFrame, side: str) -> DataFrame:
    return conversations.select(
        "pair_id",
        F.lit(side).alias("side"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame, learned: str = "assistant") -> DataFrame:
    """Rendered turns of all pairs, from two tables ``(pair_id, turn, role, text)``.

    Returns ``pair_id``, ``part`` (prompt, chosen or rejected), ``position`` (place of the turn in its conversation, from 0),
    ``role``, ``rendered``, ``start`` and ``length`` (characters, within the part) and ``loss_start`` and ``loss_length``: the
    characters of the part that are learned; a length of 0 means that the whole turn is masked. Rendered turns of a part put one
    after another by ``position`` are its text, and prompt and completion together are the conversation.
    """
    turns = written(_turns(chosen, "chosen").unionByName(_turns(rejected, "rejected")).distinct(), "turns")
    by_turn = F.coalesce(F.shiftright("turn", _BLOCK), F.lit(_FIRST))
    placed = written(_offset(turns, ["pair_id", "side"], by_turn, ["turn", "role", "text"], F.lit(1), "position"), "placed-turns")

    # a position where both sides say the same keeps one of its two rows, at once with the place where the pair first differs
    both = placed.groupBy("pair_id", "position").agg(
        (F.count("*") == 2).alias("both"),
        F.min(F.struct("role", "text")).alias("a"),
        F.max(F.struct("role", "text")).alias("z"),
    )
    differs = ~(F.col("both") & (F.col("a") == F.col("z")))
    first = both.where(differs).groupBy("pair_id").agg(F.min("position").alias("_split"))

    # the split is looked up by pair and block, so that a long conversation is not one join key
    blocks = placed.select("pair_id", F.shiftright("position", _BLOCK).alias("_b")).distinct()
    split = blocks.join(first.withColumnRenamed("pair_id", "_p"), F.col("pair_id").eqNullSafe(F.col("_p")), "left")
    split = split.select(F.col("pair_id").alias("_p"), F.col("_b").alias("_of_b"), "_split")
    known = placed.withColumn("_b", F.shiftright("position", _BLOCK)).join(
        split, F.col("pair_id").eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_of_b"))
    )
    common = F.col("_split").isNull() | (F.col("position") < F.col("_split"))
    parts = known.where(~common | (F.col("side") == "chosen")).select(
        "pair_id", F.when(common, "prompt").otherwise(F.col("side")).alias("part"), "position", "role", "text"
    )

    head = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE))
    rendered = parts.select(
        "pair_id",
        "part",
        "position",
        "role",
        F.concat(head, "text", F.lit(CLOSE)).alias("rendered"),
        F.char_length(head).cast("long").alias("head"),
    ).withColumn("length", F.char_length("rendered").cast("long"))
    by_place = F.shiftright("position", _BLOCK)
    spans = _offset(written(rendered, "rendered-turns"), ["pair_id", "part"], by_place, ["position"], F.col("length"), "start")
    taught = (F.col("part") != "prompt") & (F.col("role") == learned)
    return spans.select(
        "pair_id",
        "part",
        "position",
        "role",
        "rendered",
        "start",
        "length",
        F.when(taught, F.col("start") + F.col("head")).otherwise(F.col("start")).alias("loss_start"),
        F.when(taught, F.col("length") - F.col("head")).otherwise(F.lit(0)).cast("long").alias("loss_length"),
    )


def lines_reversed(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """A worse form of each conversation: the lines of every assistant's turn in reverse order; turns of one line stay."""
    backwards = F.array_join(F.reverse(F.split("text", "\n")), "\n")
    return conversations.withColumn("text", F.when(F.col("role") == learned, backwards).otherwise(F.col("text")))


#: What the registered query returns, worked out conversation by conversation.
SQL = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, side FROM (
    SELECT conv_id, turn, role, text, 'chosen' AS side FROM conversations
    UNION ALL
    SELECT conv_id, turn, role,
           CASE WHEN role = 'assistant' THEN array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) ELSE text END,
           'rejected'
    FROM conversations)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role, text) - 1 AS position FROM said
), pairs AS (
  SELECT conv_id, position, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AS same
  FROM numbered GROUP BY conv_id, position
), split AS (
  SELECT conv_id, min(position) AS split FROM pairs WHERE NOT same GROUP BY conv_id
), parts AS (
  SELECT n.conv_id, n.position, n.role, side,
         CASE WHEN split IS NULL OR n.position < split THEN 'prompt' ELSE side END AS part,
         '<|im_start|>' || n.role || chr(10) AS head, n.text || '<|im_end|>' || chr(10) AS body
  FROM numbered n LEFT JOIN split s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), spans AS (
  SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, part ORDER BY position
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM parts WHERE part <> 'prompt' OR side = 'chosen'
)
SELECT conv_id, part, position, role, head || body AS rendered, start, length(head || body)::BIGINT AS length,
       (start + CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END)::BIGINT AS loss_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(body) ELSE 0 END::BIGINT AS loss_length
FROM spans
"""
