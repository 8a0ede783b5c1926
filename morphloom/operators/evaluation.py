"""How well encodings keep known boundaries, and what the logs of training tell."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import encode_word, encode_words, ranks_of


def cut_positions(toks: Column) -> Column:
    """Where a token ends, but for the last, counted in code points."""
    lengths = F.transform(toks, lambda t: F.length(t))
    return F.transform(F.sequence(F.lit(1), F.size(toks) - 1), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))


def _cuts(toks: Column) -> Column:
    return F.when(F.size(toks) > 1, cut_positions(toks)).otherwise(F.array().cast("array<int>"))


def boundary_metrics(encoded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, boundary_acc, avg_tokens_per_word, weighted by cnt; one gold cut a row; 0 where nothing is to be divided.

    encoded: word, boundary, cnt, toks and the columns in by.
    """
    cuts = _cuts(F.col("toks"))
    rows = encoded.select(*by, F.col("cnt").alias("gold"), (F.size(cuts) * F.col("cnt")).alias("pred"), F.when(F.array_contains(cuts, F.col("boundary").cast("int")), F.col("cnt")).otherwise(0).alias("tp"), (F.size("toks") * F.col("cnt")).alias("tokens"))
    total = rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("gold", "pred", "tp", "tokens")))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = ratio(F.col("tp"), F.col("pred")), ratio(F.col("tp"), F.col("gold"))
    return total.select(*by, p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), r.alias("boundary_acc"), ratio(F.col("tokens"), F.col("gold")).alias("avg_tokens_per_word"))


def evaluate_boundaries(samples: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """samples (word, boundary, cnt) encoded with merges, and measured. Duplicate rows count each."""
    coded = encode_words(samples.select("word").distinct(), merges)
    return boundary_metrics(samples.join(coded, "word"))


def retention_curve(samples: DataFrame, merges: Sequence[tuple[str, str]], max_merges: int, step: int) -> DataFrame:
    """merges, boundary_acc, boundary_f1, avg_tokens_per_word after the first 0, step, 2 step, ... merges.

    Each distinct word is encoded for all points in one Arrow call; rows of words meet the points as an array.
    """
    points = list(range(0, min(max_merges, len(merges)) + 1, step))
    sent = samples.sparkSession.sparkContext.broadcast([ranks_of(merges[:m]) for m in points])

    def run(column: pa.Array) -> pa.Array:
        return pa.array([[encode_word(w, r) for r in sent.value] for w in column.to_pylist()], pa.list_(pa.list_(pa.string())))

    words = samples.select("word").distinct()
    coded = words.select("word", F.posexplode(F.arrow_udf(run, "array<array<string>>")("word")).alias("i", "toks")).withColumn("merges", F.get(F.array(*map(F.lit, points)), F.col("i")))
    found = boundary_metrics(samples.join(coded, "word"), ["merges"])
    return found.select("merges", "boundary_acc", F.col("f1").alias("boundary_f1"), "avg_tokens_per_word")


def accuracy_curve(curve: DataFrame) -> DataFrame:
    return curve.select("merges", "boundary_acc")


def curve_by_tokens(curve: DataFrame) -> DataFrame:
    """The points in ascending order of tokens a word, with their place."""
    return curve.select("avg_tokens_per_word", "boundary_acc", F.row_number().over(W.orderBy("avg_tokens_per_word", "merges")).alias("place"))


def auc_over_tokens(curve: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """auc: the area under accuracy over tokens a word, from the most tokens down to threshold, over that span.

    Null for fewer than two points, and for a threshold that isn't positive or not below the start. The segment in
    which the threshold lies counts in part; beyond the last point nothing is added.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    order = W.partitionBy(*by).orderBy(F.desc("avg_tokens_per_word"), "merges")
    x, y = F.col("avg_tokens_per_word"), F.col("boundary_acc")
    rows = curve.select(*by, x.alias("x"), y.alias("y"), F.lag(x).over(order).alias("px"), F.lag(y).over(order).alias("py"), t.alias("t"))
    x, y, px, py, t = (F.col(c) for c in ("x", "y", "px", "py", "t"))
    y_t = py + (y - py) * (px - t) / F.greatest(F.lit(1e-9), px - x)
    part = F.when(px.isNull(), 0.0).when(x >= t, 0.5 * (py + y) * (px - x)).when((px > t) & (x < t), 0.5 * (py + y_t) * (px - t)).otherwise(0.0)
    total = rows.groupBy(*by).agg(F.sum(part).alias("area"), F.max("x").alias("start"), F.count("*").alias("points"), F.first("t").alias("t"))
    return total.select(*by, F.when((F.col("t") > 0) & (F.col("points") >= 2) & (F.col("t") < F.col("start")), F.col("area") / (F.col("start") - F.col("t"))).alias("auc"))


def matched_threshold(curves: DataFrame, wanted: float = 0.0) -> DataFrame:
    """common_min, common_max, threshold over curves (method, ...): tokens a word that all methods reach; a wanted value is clamped."""
    spans = curves.groupBy("method").agg(F.min("avg_tokens_per_word").alias("lo"), F.max("avg_tokens_per_word").alias("hi"))
    both = spans.agg(F.max("lo").alias("common_min"), F.min("hi").alias("common_max"))
    chosen = F.least(F.greatest(F.lit(float(wanted)), F.col("common_min")), F.col("common_max")) if wanted > 0 else F.col("common_min")
    return both.select("common_min", "common_max", chosen.alias("threshold"))


def pair_ranks(merges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, rank: the last rank, from 1, at which each of pairs (a, b) was merged; null if never."""
    last = merges.groupBy("a", "b").agg((F.max("rank") + 1).alias("rank"))
    return pairs.join(last, ["a", "b"], "left").select("a", "b", "rank")


def rank_summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.min("rank").cast("double").alias("min_rank"), F.avg("rank").alias("mean_rank"), F.max("rank").cast("double").alias("max_rank"), F.count_if(F.col("rank").isNull()).alias("missing"))


def first_cross(log: DataFrame) -> DataFrame:
    """The first step whose token crosses the boundary; null if none does."""
    return log.agg(F.min(F.when(F.col("is_cross_boundary"), F.col("step"))).alias("first_cross_step"))


def log_summary(log: DataFrame, first: int = 50) -> DataFrame:
    """cross_frac over all steps, mean_zdist over the first ones that have a distance (NaN if none)."""
    cross = F.count_if(F.coalesce(F.col("is_cross_boundary"), F.lit(False))) / F.greatest(F.lit(1), F.count("*"))
    return log.agg(cross.alias("cross_frac"), F.coalesce(F.avg(F.when(F.col("step") <= first, F.col("z_dist"))), F.lit(float("nan"))).alias("mean_zdist"))


def cumulative_cross(log: DataFrame, max_merges: int) -> DataFrame:
    """step, cross_frac up to it; a null counts as no crossing. A log has as many rows as merges."""
    upto = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return log.where(F.col("step") <= max_merges).select("step", F.avg(F.when(F.col("is_cross_boundary"), 1.0).otherwise(0.0)).over(upto).alias("cross_frac"))


def moving_distance(log: DataFrame, max_merges: int, smooth: int = 7) -> DataFrame:
    """step, z_dist as the mean of smooth distances up to it (nulls removed before); as they are if there are fewer."""
    rows = log.where((F.col("step") <= max_merges) & F.col("z_dist").isNotNull()).select("step", F.col("z_dist").cast("float").alias("z"))
    if smooth <= 1:
        return rows.select("step", F.col("z").cast("double").alias("z_dist"))
    frame = W.orderBy("step").rowsBetween(1 - smooth, 0)
    out = rows.select("step", "z", F.avg("z").over(frame).alias("mean"), F.count("z").over(frame).alias("k"), F.count("z").over(W.partitionBy()).alias("all"))
    few = F.col("all") < smooth
    return out.where(few | (F.col("k") == smooth)).select("step", F.when(few, F.col("z").cast("double")).otherwise(F.col("mean")).alias("z_dist"))


def histogram(values: DataFrame, by: str, column: str, bins: int = 30) -> DataFrame:
    """by, bin (from 1), n and density over bins of equal width from each group's least to its greatest value."""
    span = values.groupBy(by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("total"))
    # a group of one value gets a span of one around it
    flat = F.col("hi") == F.col("lo")
    span = span.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    width = (F.col("hi") - F.col("lo")) / bins
    placed = values.join(F.broadcast(span), by).select(by, F.least(F.lit(bins), F.floor((F.col(column) - F.col("lo")) / width).cast("int") + 1).alias("bin"), "total", width.alias("width"))
    return placed.groupBy(by, "bin", "total", "width").agg(F.count("*").alias("n")).select(by, "bin", "n", (F.col("n") / F.col("total") / F.col("width")).alias("density"))


def stem_suffix_values(z: DataFrame, stem_chars: str, suffix_chars: str) -> DataFrame:
    """kind (stem or suffix), z of the single-character tokens of either alphabet."""
    kind = F.when(F.col("token").isin(*stem_chars), "stem").when(F.col("token").isin(*suffix_chars), "suffix")
    return z.select(kind.alias("kind"), F.col("z").cast("double").alias("z")).where("kind is not null")


def first_merges(log: DataFrame, n: int = 20) -> DataFrame:
    return log.where(F.col("step") <= n).select("step", "a", "b", "new_token", "score")
