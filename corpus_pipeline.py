"""Corpus pipeline: documents in, packed sequences of a balanced corpus out.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinvector.llm import language_id, line_dedup, mixing, near_dedup, packing
from kinvector.llm.common import cut, set_aside, table
from kinvector.llm.queries import vocabulary

#: Tokenizers, fitted models and iterated components can't be expressed in SQL.
ORACLE_SQL = None
#: Documents whose calibrated language probability is below this are rejected, as those without letters are.
LEAST_SCORE = 0.3
OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Words in the table of each Python worker's encoder: the workers' memory adds to what earlier stages left in their executors.
MOST_WORDS = 150_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told.

    Null texts, texts without a letter and those of a probability below
    ``LEAST_SCORE`` go; repeated rows are judged each; an empty table stays one.
    """
    told = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return set_aside(docs, OWN, lambda held: language_id.language_id(held).where(told))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; no document goes.

    A null text becomes empty; rows of one doc_id count as documents of their
    own; the largest doc_id that holds a line keeps it, null being the smallest.
    """
    return set_aside(docs, OWN, line_dedup.line_dedup)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8.

    Texts without words are no duplicates and stay; rows that share the kept
    doc_id stay all; null ids stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_d")).distinct()
    return set_aside(docs, OWN, lambda held: held.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, a row for each copy. Null sources are one source; a document may be there several times or not at all."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens. Every row is packed, null texts as the end id alone."""
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"), most_words=MOST_WORDS)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
