"""Quality rules: counts of a text with fixed limits, and a calibrated n-gram logistic regression with a threshold.

The model is a hashed word and character n-gram logistic regression (see ``linear_text``), trained on labelled
quality rows of which a fifth only calibrates its probabilities (Platt). Counts and probability of a text come from
one Arrow pass over it. The counts are exact: hashes only find the texts in which some 3-word window may occur
twice; in these, windows are compared by their words.

Edge cases: null, empty and wordless texts count 0 everywhere and fail the base rule. Repeated rows are judged each.
Labels as in ``quality_model``; rows of the fold kept apart (crc32 of doc_id modulo 5 is 0) are never learned from.
Without labels every probability is 0.5, which is above the threshold. Columns of the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear_text import Features, Model, grams, word_hashes, word_spans
from .quality_model import fit, fold, labelled_sample
from .scratch import bounded_batches

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_AT = 0.3
FEATURES = Features(words=(1, 2), shapes=(1, 2), chars=(3,))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True
_STARTS_POINT = np.ones(256, bool)  # bytes that start a code point outside white space
_STARTS_POINT[0x80:0xC0] = False
_STARTS_POINT[[0x20, *range(0x09, 0x0E)]] = False


def repeated_words(text: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; exact.

    A window whose hash occurs once occurs once; only the words of the others are looked at, one at a time.
    """
    if len(hashes) < 4:
        return 0
    with np.errstate(over="ignore"):
        g = grams(hashes, 3)
    order = np.sort(g)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, g), len(twice) - 1)] == g)
    needed = np.zeros(len(hashes), bool)
    for i in range(3):
        needed[at + i] = True
    known: dict[bytes, int] = {}
    ids, which = np.zeros(len(hashes), np.int64), np.flatnonzero(needed)
    ids[which] = np.fromiter((known.setdefault(text[s:e], len(known)) for s, e in zip(map(int, starts[which]), map(int, ends[which]), strict=True)), np.int64, len(which))
    pairs = np.unique(ids[at] * len(known) + ids[at + 1], return_inverse=True)[1]
    _, same, n = np.unique(pairs * len(known) + ids[at + 2], return_inverse=True, return_counts=True)
    at = at[n[same] > 1]
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[at + i] = True
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """Lines other than blank ones, less the distinct ones among them; a line at a time."""
    n, known = 0, set()
    for line in BytesIO(data):
        if line.strip():
            n += 1
            known.add(line.removesuffix(b"\n"))
    return n - len(known)


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    s, e = word_spans(raw)
    with np.errstate(over="ignore"):
        hashes = word_hashes(raw, s, e)
    return len(s), int(_STARTS_POINT[raw].sum()), int(_SIGN[raw].sum()), repeated_lines(data), repeated_words(data, hashes, s, e)


def judge_texts(model: Model) -> Callable[[Column], Column]:
    kind = ", ".join(f"{c} long" for c in COUNTS) + ", probability double"

    def judge(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        p = pa.array([model.probability(model.margin(t)) for t in texts], pa.float64())
        return pa.StructArray.from_arrays([*(pa.array(counts[:, i]) for i in range(len(COUNTS))), p], [*COUNTS, "probability"])

    return F.arrow_udf(judge, f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")


def apply_rules(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """docs with the counts, probability, base_failed and kept."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumn("_judged", judge_texts(model)(F.col("text")))
    out = out.withColumns({c: F.col("_judged")[c] for c in (*COUNTS, "probability")}).drop("_judged")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_at))


def rules_model(docs: DataFrame, labels: DataFrame) -> Model:
    part = fold(F.col("doc_id"), 5)
    return fit(labelled_sample(docs, labels, part != 0), FEATURES, part == 1, epochs=3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return apply_rules(docs, rules_model(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "probability")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE_SQL: dict[str, str] = {}
