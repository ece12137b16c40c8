"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, whatever other
columns come in and however their names clash.

At every stage null texts are empty ones, texts of any length are read whole, and repeated rows are
documents of their own, so:

- quality rules: null, empty and short texts go; repeated rows go or stay together.
- line dedup: a text that loses no line stays as it is, null too; one that loses every line with a word
  goes. A repeated row's lines are not earlier than its twin's, so both stay; null doc_ids come last.
- near-dedup: documents without words link with nothing and stay, as do null doc_ids; rows of one doc_id
  go or stay together. Ties don't arise: of a group the smallest doc_id stays.
- source mix: documents without words are never taken; rows equal in doc_id, source and size are
  interchangeable in the order, which decides which of them a last, partial pass takes.
- packing: every row that comes in is one document, cut into pieces of at most 4096 tokens.

An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import linededup, mixing, neardup, packing, quality
from citeloom.llm.common import WORD, pick, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, whatever else there is."""
    return pick(docs, **{c: c for c in COLUMNS})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go."""
    judged = quality.judge(_documents(docs), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, with n_chars counted anew; a document left without a word goes too."""
    cut = linededup.dedup_lines(_documents(docs))
    left = cut.filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of smallest id stays."""
    groups = neardup.near_duplicates(docs)
    return neardup.without(_documents(docs), groups.filter("NOT kept").select("doc_id").distinct())


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, in order of training position."""
    return mixing.mix_documents(_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted classifier, sketches and a tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
