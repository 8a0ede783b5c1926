"""Boundary samples from real text: words that are an affix and a word that stands alone elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import MARK

#: Affixes of the probe (fixed values).
PREFIXES = ("un", "re", "dis", "mis", "pre", "non", "anti", "inter", "trans", "sub", "super", "over", "under", "semi", "auto", "micro", "macro", "post", "pro", "de", "co")
SUFFIXES = ("ing", "ed", "ly", "tion", "sion", "ment", "ness", "able", "less", "ist", "ive", "ous", "ize", "ise", "al", "er", "or", "ship", "hood", "ward", "wise", "ful", "dom")


def letter_words(docs: DataFrame, lower: bool = True) -> DataFrame:
    """w, cnt of the runs [a-z]+; without lowering, capitals divide words."""
    text = F.lower("text") if lower else F.col("text")
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"([a-z]+)"), F.lit(1))).alias("w")).groupBy("w").agg(F.count("*").alias("cnt"))


def affixed(base: Column, min_extra: int) -> Column:
    """Whether a base starts or ends with an affix and is longer than it by more than min_extra."""
    out = F.lit(False)
    for x in PREFIXES:
        out = out | (base.startswith(x) & (F.length(base) > len(x) + min_extra))
    for x in SUFFIXES:
        out = out | (base.endswith(x) & (F.length(base) > len(x) + min_extra))
    return out


def affix_probe(docs: DataFrame, lower: bool = True, min_base: int = 5, min_derived: int = 2, min_extra: int = 2, exclude_affixed: bool = False, max_samples: int | None = None) -> DataFrame:
    """word (marked), boundary, cnt, arm. A word may give a prefix and a suffix sample.

    Each arm tries its affixes in order: an affixed base (if excluded) drops the word, a base that is frequent enough
    gives the sample, else the next affix is tried. A word that the prefix arm drops has no suffix arm. Candidates are
    one row a word and fitting affix; bases meet their counts in an equi-join.
    """
    words = letter_words(docs, lower)
    derived = words.where(F.col("cnt") >= min_derived)
    n = F.length("w")

    def tries(affixes: tuple[str, ...], prefix: bool) -> DataFrame:
        found = F.array(*(F.when((F.col("w").startswith(x) if prefix else F.col("w").endswith(x)) & (n > len(x)) & (n >= n - len(x) + min_extra), F.struct(F.lit(i).alias("ord"), F.lit(len(x)).alias("len"))) for i, x in enumerate(affixes)))
        rows = derived.select("w", "cnt", F.explode(F.array_compact(found)).alias("t")).select("w", "cnt", "t.ord", "t.len")
        base = F.expr("substring(w, len + 1, length(w) - len)") if prefix else F.expr("substring(w, 1, length(w) - len)")
        return rows.withColumn("base", base).join(words.select(F.col("w").alias("base"), F.col("cnt").alias("base_cnt")), "base", "left").withColumn("base_cnt", F.coalesce("base_cnt", F.lit(0)))

    drop = affixed(F.col("base"), min_extra) if exclude_affixed else F.lit(False)
    out = []
    dropped = None
    for prefix, affixes in ((True, PREFIXES), (False, SUFFIXES)):
        boundary = F.lit(1) + (F.col("len") if prefix else F.length("base"))
        rows = tries(affixes, prefix).withColumn("drop", drop).where(F.col("drop") | (F.col("base_cnt") >= min_base))
        first = rows.groupBy("w", "cnt").agg(F.min_by(F.struct("drop", boundary.alias("boundary")), "ord").alias("first")).select("w", "cnt", "first.drop", "first.boundary")
        if not prefix and exclude_affixed:
            first = first.join(dropped, "w", "left_anti")
        dropped = first.where("drop").select("w")
        out.append(first.where(~F.col("drop")).select(F.concat(F.lit(MARK), "w").alias("word"), F.col("boundary").cast("int").alias("boundary"), "cnt", F.lit("prefix" if prefix else "suffix").alias("arm")))
    samples = out[0].unionByName(out[1])
    if max_samples:
        samples = samples.orderBy(F.xxhash64("word", "arm"), "word", "arm").limit(max_samples)
    return samples
