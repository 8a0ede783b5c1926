"""Word counts and their segmentation: everything after works on distinct words with weights, never on the text again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MARK, SPACE, text_words


def word_counts(docs: DataFrame, lower: bool = False) -> DataFrame:
    """word (with its mark), cnt, and where it is first seen: first_doc, first_pos.

    The first place stands in for an order of insertion: no row number, hence no global sort.
    """
    text = F.lower("text") if lower else F.col("text")
    words = docs.select("doc_id", F.posexplode(text_words(text)).alias("pos", "w"))
    found = words.groupBy("w").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return found.select(F.concat(F.lit(MARK), "w").alias("word"), "cnt", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def segment(words: DataFrame) -> DataFrame:
    """words with toks: one symbol for each code point."""
    return words.withColumn("toks", F.split("word", ""))


def mergeable(words: DataFrame) -> DataFrame:
    """Those that count and have at least two symbols."""
    return words.where((F.col("cnt") > 0) & (F.size("toks") >= 2))


def vocabulary(words: DataFrame) -> DataFrame:
    """token: the distinct symbols of a segmentation."""
    return words.select(F.explode("toks").alias("token")).distinct()


def text_symbols(docs: DataFrame) -> DataFrame:
    """token: the distinct symbols of all words and their mark. Each text gives its own once; no word is shuffled."""
    found = docs.select(F.explode(F.array_distinct(F.split("text", ""))).alias("token")).distinct().where((F.col("token") != "") & ~F.col("token").rlike(SPACE))
    return found.select(F.explode(F.array("token", F.lit(MARK))).alias("token")).distinct()


def with_ids(vocab: DataFrame) -> DataFrame:
    """token, id: the rank of a token in code-point order. A vocabulary is bounded by its target size."""
    from pyspark.sql import Window as W

    return vocab.select("token", (F.row_number().over(W.orderBy("token")) - 1).alias("id"))


def corpus_bytes(docs: DataFrame, lower: bool = False) -> DataFrame:
    """n_docs and n_bytes: UTF-8 bytes of all texts, joined by line feeds."""
    text = F.lower("text") if lower else F.col("text")
    n = F.count("*")
    return docs.agg(n.alias("n_docs"), (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.greatest(n - 1, F.lit(0))).alias("n_bytes"))
