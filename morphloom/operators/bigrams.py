"""Weighted counts of neighbouring symbols, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mergeable

TINY = 1e-12


def bigram_counts(words: DataFrame) -> DataFrame:
    """a, b, n (weighted, overlapping pairs count) and first_seen (first_doc, first_pos, at)."""
    toks = F.col("toks")
    n = F.size(toks) - 1
    pairs = F.arrays_zip(F.slice(toks, 1, n).alias("a"), F.slice(toks, 2, n).alias("b"))
    rows = mergeable(words).select("cnt", "first_doc", "first_pos", F.posexplode(pairs).alias("at", "p"))
    return rows.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("cnt").alias("n"), F.min(F.struct("first_doc", "first_pos", "at")).alias("first_seen"))


def marginals(pairs: DataFrame) -> DataFrame:
    """pairs with n_first (of a as first), n_second (of b as second) and z (all pairs)."""
    first = pairs.groupBy("a").agg(F.sum("n").alias("n_first"))
    second = pairs.groupBy("b").agg(F.sum("n").alias("n_second"))
    total = F.broadcast(pairs.agg(F.sum("n").alias("z")))  # one row
    return pairs.join(first, "a").join(second, "b").join(total)


def ppmi(pairs: DataFrame, tau: int = 2) -> DataFrame:
    """a, b, n, first_seen, ppmi of the pairs seen at least tau times with positive association."""
    return association(marginals(pairs), tau)


def association(counted: DataFrame, tau: int = 2) -> DataFrame:
    """ppmi of pairs that have their marginals."""
    inv = 1.0 / F.col("z")
    value = F.ln((F.col("n") * inv + TINY) / (F.col("n_first") * inv * (F.col("n_second") * inv) + TINY))
    return counted.where((F.col("z") > 0) & (F.col("n") >= tau)).select("a", "b", "n", "first_seen", value.alias("ppmi")).where("ppmi > 0")


def edge_weights(associated: DataFrame, alpha: float = 0.0) -> DataFrame:
    """a, b, w = PPMI * n ** alpha."""
    return associated.select("a", "b", (F.col("ppmi") * F.pow(F.col("n").cast("double"), F.lit(alpha))).alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """a, b, w: the sum of the matrix and its transpose; a loop counts twice."""
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def laplacian(affinity: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """a, b, v: entries other than 0 of I - D^-1/2 W D^-1/2; a token without edges has 1 on the diagonal."""
    degree = affinity.groupBy("a").agg(F.greatest(F.sum("w"), F.lit(1e-9)).alias("d"))
    known = degree.select("a") if tokens is None else tokens.select(F.col("token").alias("a"))
    scaled = affinity.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    off = scaled.select("a", "b", (-F.col("w") / (F.sqrt("d") * F.sqrt("e"))).alias("v"))
    return off.unionByName(known.select("a", F.col("a").alias("b"), F.lit(1.0).alias("v"))).groupBy("a", "b").agg(F.sum("v").alias("v"))
