"""Where text comes from: tables, plain files, synthetic words; and the positional split into train and validation."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_FRACTION = 0.9


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of the documents table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def read_text_files(spark: SparkSession, path: str, max_chars: int = 0) -> DataFrame:
    """doc_id (a hash of the path), path and text of each file; bytes that aren't UTF-8 are left out, and texts are cut to
    max_chars code points if that is positive. A file is one row, so it must fit in a task."""

    def decoded(contents: pa.Array) -> pa.Array:
        return pa.array([x.decode("utf-8", errors="ignore") for x in contents.to_pylist()], pa.string())

    files = spark.read.format("binaryFile").load(path).select("path", F.arrow_udf(decoded, "string")("content").alias("text"))
    text = F.substring("text", 1, max_chars) if max_chars > 0 else F.col("text")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("text"))


#: Line ends as Python's str.splitlines has them.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def text_lines(docs: DataFrame, end: str = LINE_END) -> DataFrame:
    """doc_id, pos, line of all texts; null texts have none."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", end)).alias("pos", "line"))


def split_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, pos, line) with part: train for the first floor(0.9 n) by doc_id and pos, else val.

    Counts by document and one boundary document reach the driver: lines are counted where they lie, the document in
    which the split falls is found by halving, and only its own lines are counted anew.
    """
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    at = lines.count() * 9 // 10
    if not at:
        return lines.withColumn("part", F.lit("val"))
    doc = nth_smallest(sizes, "doc_id", at, "n")
    rest = at - (sizes.where(F.col("doc_id") < doc).agg(F.sum("n")).first()[0] or 0)
    inside = (F.col("doc_id") < doc) | ((F.col("doc_id") == doc) & (F.col("pos") < rest))
    return lines.withColumn("part", F.when(inside, "train").otherwise("val"))


def split_documents(docs: DataFrame) -> DataFrame:
    """docs with part: train for the first floor(0.9 n) by doc_id, else val. Positional, never random.

    Only counts by range of doc_id and one boundary id reach the driver; rows are not ordered globally.
    """
    at = docs.count() * 9 // 10
    first = nth_smallest(docs.select("doc_id"), "doc_id", at) if at else None
    is_train = F.lit(False) if first is None else F.col("doc_id") <= first
    return docs.withColumn("part", F.when(is_train, "train").otherwise("val"))


def nth_smallest(df: DataFrame, column: str, n: int, weight: str | None = None) -> int:
    """The n-th smallest (from 1) value of a long column, by cutting its range; each step is one aggregation.

    With weight, a column, a row stands for so many.
    """
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        points = sorted({lo + (hi - lo) * i // 64 for i in range(64)})
        times = F.lit(1) if weight is None else F.col(weight)
        row = df.agg(*(F.sum(F.when(F.col(column) <= p, times).otherwise(0)).alias(f"c{i}") for i, p in enumerate(points))).first()
        fine = [p for i, p in enumerate(points) if row[i] >= n]
        low = [p for i, p in enumerate(points) if row[i] < n]
        lo, hi = (low[-1] + 1 if low else lo), (fine[0] if fine else hi)
    return lo


@dataclass(frozen=True)
class SyntheticConfig:
    """Words of a stem and a suffix over disjoint alphabets; the stem's end decides the suffix's start."""

    word_types: int = 8000
    seed: int = 0
    stem_len: tuple[int, int] = (5, 9)
    suffix_len: tuple[int, int] = (3, 6)
    stem_chars: str = "abcdefghijklm"
    suffix_chars: str = "nopqrstuvwxyz"
    end_chars: str = "abcde"
    start_chars: str = "nopqr"
    zipf_a: float = 1.2
    max_count: int = 200
    val_frac: float = 0.1


def synthetic_words(spark: SparkSession, config: SyntheticConfig = SyntheticConfig()) -> tuple[DataFrame, DataFrame]:
    """Training counts (word, cnt, first_doc, first_pos) and validation samples (word, boundary, cnt).

    Drawn on the driver from seeded generators: the number of word types is the bound. The order of the draws is given,
    as equal seeds must give equal words.
    """
    c = config
    if len(c.end_chars) != len(c.start_chars):
        raise ValueError("end_chars and start_chars pair up by position")
    rng, counts = random.Random(c.seed), np.random.default_rng(c.seed)
    stem_body = [x for x in c.stem_chars if x not in c.end_chars] or list(c.stem_chars)
    suffix_body = [x for x in c.suffix_chars if x not in c.start_chars] or list(c.suffix_chars)
    rows = []
    for _ in range(c.word_types):
        n_stem, n_suffix = rng.randint(*c.stem_len), rng.randint(*c.suffix_len)
        pair = rng.randrange(len(c.end_chars))
        stem = "".join(rng.choice(stem_body) for _ in range(n_stem - 1)) + c.end_chars[pair]
        suffix = c.start_chars[pair] + "".join(rng.choice(suffix_body) for _ in range(n_suffix - 1))
        rows.append((stem + suffix, len(stem), min(c.max_count, max(1, int(counts.zipf(c.zipf_a))))))
    rng.shuffle(rows)
    at = int(c.word_types * (1.0 - c.val_frac))
    total: Counter[str] = Counter()
    for word, _, n in rows[:at]:
        total[word] += n
    train = spark.createDataFrame([(w, n, 0, i) for i, (w, n) in enumerate(total.items())], "word string, cnt long, first_doc long, first_pos int")
    return train, spark.createDataFrame(rows[at:], "word string, boundary int, cnt long")


def synthetic_words_distributed(spark: SparkSession, config: SyntheticConfig = SyntheticConfig()) -> DataFrame:
    """word, boundary, cnt of the same kind of words, drawn on the executors by hashing: other draws, any number of rows."""
    c = config

    def draw(salt: int, n: int, *more):
        return F.pmod(F.xxhash64(F.lit(c.seed), F.lit(salt), "id", *more), F.lit(n)).cast("int")

    def body(chars: str, length, salt: int):
        letters = F.lit(chars)
        return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(letters, F.pmod(F.xxhash64(F.lit(c.seed), F.lit(salt), F.col("id"), i), F.lit(len(chars))).cast("int") + 1, F.lit(1))), "")

    stem_body = "".join(x for x in c.stem_chars if x not in c.end_chars) or c.stem_chars
    suffix_body = "".join(x for x in c.suffix_chars if x not in c.start_chars) or c.suffix_chars
    n_stem = F.lit(c.stem_len[0]) + draw(1, c.stem_len[1] - c.stem_len[0] + 1)
    n_suffix = F.lit(c.suffix_len[0]) + draw(2, c.suffix_len[1] - c.suffix_len[0] + 1)
    pair = draw(3, len(c.end_chars)) + 1
    stem = F.concat(body(stem_body, n_stem - 1, 4), F.substring(F.lit(c.end_chars), pair, F.lit(1)))
    suffix = F.concat(F.substring(F.lit(c.start_chars), pair, F.lit(1)), body(suffix_body, n_suffix - 1, 5))
    # a discrete power law by inversion
    u = (draw(6, 1_000_000) + 1) / 1_000_000
    count = F.least(F.lit(c.max_count), F.greatest(F.lit(1), F.floor(F.pow(u, F.lit(-1.0 / (c.zipf_a - 1.0 + 1e-9)))))).cast("long")
    return spark.range(c.word_types).select(F.concat(stem, suffix).alias("word"), n_stem.alias("boundary"), count.alias("cnt"))
