"""A corpus pipeline: toxic documents go, near copies go, personal data is masked, the rest is packed.

Each stage is a function of the session, the documents and the folder of tables. Its result is written as
Parquet and read again as the next one's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatehouse.llm.common import Scratch, read_table
from gatehouse.llm.ngram_join import Rule, one_of_each
from gatehouse.llm.packing import pack_documents
from gatehouse.llm.pseudonyms import with_pseudonyms
from gatehouse.llm.toxicity import drop_toxic, learn_lexicon


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from ``labels`` rejects go.

    Null and empty texts stay, repeated rows stay or go together, and an empty table gives none. Without toxic labels nothing goes.
    """
    return drop_toxic(docs, learn_lexicon(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sets of five-word shingles at a similarity of 0.8 or more, the smallest id stays.

    Null and empty texts and null ids stay, rows with one id stay or go together, and an empty table gives none.
    """
    return one_of_each(docs, Rule(width=5, percent=80))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes keyed pseudonyms of the same format. Every row stays; null and empty texts stay as they are."""
    return with_pseudonyms(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048. Null texts count as empty, repeated rows are packed each, and an empty table gives none."""
    return pack_documents(docs)


STAGES = [("toxicity", clean_toxic), ("near_copies", drop_near_copies), ("personal_data", mask_personal_data), ("packing", pack)]

#: The stages tokenise and hash; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what the next one has read is deleted."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return docs
