"""A corpus pipeline over the documents: five stages, each one operator of clustrum.llm on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.llm import language_id, line_dedup, mixing, ngram_join, piece_bpe
from clustrum.llm.shared import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; the model is learned from the documents' own labels, held-out ones aside."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), ~language_id.held_out())
    return language_id.predict(docs.select(*COLUMNS), model).where("lang_accepted").select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stood earlier in the corpus are cut out of the texts; all documents stay."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one of the smallest doc_id stays; documents without doc_id stay."""
    return ngram_join.one_of_each_group(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(mixing.mix_plan(docs.select(*COLUMNS))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the documents' pieces."""
    import public_tokenizers

    out = piece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No SQL can express the language model, the content-defined chunks and the piece encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
