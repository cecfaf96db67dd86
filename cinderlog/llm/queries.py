"""Queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    language, line_dedup, mixing, neighbours, ngram_join, packing, periodic, piece_bpe, preference, quality, spelling, tokens,
    vector_join,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def model_file(name: str) -> bytes:
    """A public tokenizer's file, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def vocabulary(name: str) -> str:
    """A public tokenizer's file of text."""
    return model_file(name).decode()


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of four-word shingles that link at a Jaccard similarity of 0.85, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others, by inner product."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(cut)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of the held-out part teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out()))
    known = language.identify(docs.select("doc_id", "text"), model)
    return known.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of several lines that stand in an earlier one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated(docs)


ORACLES["op5_line_dedup"] = line_dedup.SQL


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation preferred to one with the lines of its answers in reverse order: prompt once, two masked completions."""
    chosen = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    pairs = preference.format_pairs(chosen, preference.lines_reversed(chosen))
    return pairs.withColumnRenamed("pair_id", "conv_id")


ORACLES["op7_chat_formatting"] = preference.SQL


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; documents of the held-out part teach nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = quality.learn(docs.where(~language.held_out()), labels.where(~language.held_out()))
    scored = quality.score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", language.held_out().alias("held_out"), "score", "predicted")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.9, over the whole table."""
    return vector_join.links(table(spark, sf_dir, "embeddings"))


@query
def op12_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces and decoded again."""
    model = model_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_and_decode(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that occur twice at least, and the common form each is a spelling of."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), least=7, every=31)
    return spelling.variants(words.where("n >= 2"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, of which one in ten repeats its end, and the text without the repetitions."""
    docs = table(spark, sf_dir, "documents")
    whole = docs.select("doc_id", periodic.tail_repeated(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.collapse_runs(whole).select("doc_id", "runs", "collapsed", periodic.most_repeated(F.col("runs")).alias("most"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("most.start").alias("start"),
        F.col("most.length").alias("length"),
        F.col("most.period").alias("period"),
        F.expr("(1000 * most.length) div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
