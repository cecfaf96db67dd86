"""A training corpus from raw documents: quality, repeated lines, near copies, source mix, packed sequences.

Every stage works on all documents that the one before kept and is written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderlog.llm import language, line_dedup, mixing, ngram_join, packing, quality
from cinderlog.llm.common import table, written
from cinderlog.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and all other columns out of the way of the names that operators give theirs."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_others"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with the text of ``df``."""
    return df.select(*[F.col("text") if c == "text" else F.col("_others")[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled documents outside the held-out part.

    Null and empty texts are scored like any others. Columns keep their values, also those named like the classifier's own.
    """
    labels = table(spark, sf_dir, "labels").where(~language.held_out())
    field = quality.learn(docs.where(~language.held_out()), labels)
    return _unpacked(quality.score(_packed(docs), field).where("predicted = 1"), docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; those of which nothing is left go. Null texts stay.

    Columns keep their values, also ``n_lines`` and ``kept_lines`` of the input.
    """
    packed = _packed(docs).withColumn("doc_id", F.col("_others.doc_id"))
    return _unpacked(line_dedup.remove_repeated(packed).where("n_lines = 0 OR kept_lines > 0"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the first of those with the smallest id.

    Documents without words are in no group: all of them stay, one of each id and text. Rows alike in id and text are copies whatever
    their other columns, and one of them stays. Documents are known by id and two hashes of the text, not by their place in a scan.
    """
    found = ngram_join.link(docs)
    known = F.struct("doc_id", "t1", "t2")
    alone = found.where("n_shingles = 0").select(known.alias("first"))
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(known).alias("first")).select("first")
    chosen = alone.unionByName(first).distinct().select(*[F.col(f"first.{c}").alias(f"_{c}") for c in ("doc_id", "t1", "t2")])
    packed = docs.select(
        F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.lit(1), "text").alias("_x"), F.xxhash64(F.lit(2), "text").alias("_y"),
        F.struct(*docs.columns).alias("_whole"),
    )
    # The least of the rows alike, where their columns have an order.
    pick = F.first if "map<" in docs.schema.simpleString() else F.min
    same = F.col("_d").eqNullSafe(F.col("_doc_id")) & (F.col("_x") == F.col("_t1")) & (F.col("_y") == F.col("_t2"))
    kept = packed.join(chosen, same, "left_semi").groupBy("_d", "_x", "_y").agg(pick("_whole").alias("_whole"))
    return kept.select("_whole.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, none of those that it leaves out. Empty and null texts are left out."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), mixing.words("text").alias("_size"), F.struct(*docs.columns).alias("_whole"))
    rows = written(rows, "mix-input")
    narrow = rows.select(F.col("_whole.doc_id").alias("doc_id"), F.col("_whole.source").alias("source"), F.col("_size").alias("size"), "_row")
    chosen = mixing.decide(narrow).where("copies > 0").select("_row", "copies")
    copies = rows.join(chosen, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return copies.select("_whole.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
