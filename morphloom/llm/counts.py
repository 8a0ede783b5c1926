"""The most frequent of counted things, without sending a head of every partition to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, by: str, k: int) -> list[Row]:
    """The k rows of counts (by, n, ...) with the largest n, ties by ``by``.

    Numbers of rows by size of n (in eighths of a power of two, so a few hundred) tell which sizes can hold the k-th;
    smaller ones are left out before the rows are ordered, so the driver sees little more than k. counts is read twice.
    """
    size = F.floor(F.log2("n") * 8).cast("int")
    by_size = sorted(((r["size"], r["rows"]) for r in counts.where("n > 0").groupBy(size.alias("size")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, above = 0, 0
    for least, rows in by_size:
        above += rows
        if above >= k:
            break
    return counts.where((F.col("n") > 0) & (size >= least)).orderBy(F.desc("n"), by).limit(k).collect()
