"""A corpus made ready for training: stages over documents, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; only
the last returns the packed pieces. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stored, table
from tidemark.llm.mixing import mixed
from tidemark.llm.ngram_join import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good
from tidemark.llm.substrings import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest doc_id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines, paragraphs and passages of 50 words and more that occur before go; documents of which nothing
    is left go too, null and empty texts stay."""
    return without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target weight says, or not at all."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; the ids follow from doc_id, start and length."""
    return pack(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]
# a tokenizer and a packing have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
