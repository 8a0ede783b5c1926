"""Documents to packed sequences: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and gives a table that the next one reads; models are trained on the labelled
rows of the whole corpus at sf_dir, and each stage works on all that the one before it kept.

Edge cases are those of the operators: null, empty and wordless texts have the classifier's bias as score and fail the
rules; without labels the classifier keeps all; of equal or near texts the smallest doc_id stays, rows of one doc_id with
different texts are judged apart, and repeated rows stay or go together; very long texts are taken whole. All columns
of documents are passed on to packing, which gives its own; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morphloom.llm.near_dups import drop_near_duplicates
from morphloom.llm.packing import pack_documents
from morphloom.llm.quality_model import classify, quality_model
from morphloom.llm.quality_rules import apply_rules, rules_model
from morphloom.llm.scratch import stored
from morphloom.llm.tokens import vocabulary


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return classify(docs, quality_model(*_corpus(spark, sf_dir))).where("predicted = 1").select(*docs.columns)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return apply_rules(docs, rules_model(*_corpus(spark, sf_dir))).where("kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), 0)


STAGES = [("quality classifier", keep_good), ("quality rules", keep_by_rules), ("near-duplicate removal", keep_one_of_each), ("best-fit packing", pack)]

ORACLE_SQL = None  # classifiers and tokenizers aren't SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
