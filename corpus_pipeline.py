"""From raw documents to a training mix, one operator after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next one's documents.

Null text, or text without a letter: goes in the first stage.  Null language or
source: a value like any other.  Null ids: kept, told apart by text, after all
others.  Of rows that repeat id and text one stays in the second stage; of
linked documents the one with the smallest id stays, and under one id the text
decides.  An empty table passes every stage as an empty table.  Texts of any
length are whole.  Columns beyond those of the documents, of whatever name, pass
all stages; only one named ``copies`` is replaced in the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm import decontamination, language_id, ngram_join, source_mix, substring_dedup
from rasterspark.llm.common import free_names, materialise, quoted

#: How many times as likely as each other language (all alike) the best guess must be at least.
#: Of four languages that is a score of 0.3.  A score is this chance times the share of letters in use in labelled texts.
LEAST_ODDS = 9 / 7


def least_score(n_languages: int) -> float:
    """The score at ``LEAST_ODDS``, 0.4 at most: with few languages only the share of known letters can tell a stranger."""
    return min(0.4, LEAST_ODDS / (LEAST_ODDS + n_languages - 1))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that look like no language of the table.

    Where no row has a language there is nothing to learn: all with a letter stay.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    lang, score = free_names(docs, "lang_pred", "score")
    told = model.predict(docs, lang_out=lang, score_out=score)
    return told.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= least_score(len(model.languages)))).select(*quoted(*docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarities of 0.8 or more on five-word shingles stays."""
    return ngram_join.representatives(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 20-word windows go from the texts; texts of which nothing stays go altogether."""
    kept = substring_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover half of a benchmark item or more."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_overlaps(docs, items)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mix takes, with the number of copies."""
    return source_mix.take(docs, out="copies")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("source_mix", mixed),
]

#: The cube method and the language model have no SQL; tests/llm/test_brute.py holds each stage, and run(), against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
