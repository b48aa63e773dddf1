"""A corpus cleaning pipeline out of the text operators: each stage reads the table that the stage before it wrote.

Defined cases: a null text is the empty text and goes with the first stage, as does a text without a letter; null ids are
ordinary (of near-duplicates they go before others), null languages are not learned from; repeated rows are one text to
the near-duplicate stage, which keeps one of them; an empty table stays empty; extra columns are carried through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, language, line_dedup, sentencepiece, shingles
from tickloom.llm.common import free_names, held_out, materialise, named, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds a language; those without text or letters go, and only those where there was no
    language to learn."""
    net = language.train(docs, F.col("lang"), ~held_out(F.col("doc_id")))
    if not net.classes:
        return language.with_letters(docs)
    (found,) = free_names(docs, "_language")
    return language.identify(docs, net, out_col=found).filter(F.col(f"{found}.lang") != language.UNKNOWN).select(*named(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more, but for the first time each stands anywhere; a
    document with nothing else goes. So of a group of copies one keeps its text."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, keep="first")
    return kept.filter(F.length(F.btrim("text", F.lit(line_dedup.STRIPPED))) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*named(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: documents that share 0.8 or more of their
    five-word shingles, and chains of such."""
    return shingles.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), threshold=0.6)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, and whether decoding them gives its text again."""
    encoded = sentencepiece.encode_documents(docs)
    back = sentencepiece.decode_documents(encoded)
    return back.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", pieces)]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
