"""URL verdicts: longest host/path rule first, else a Bloom filter cascade over the corpus's own keys.

Everything on the main path is a DataFrame expression. The cascade is built from the complete key universe
(all host suffixes that occur and are no longer than the list's keys), so that membership is exact for every key of the corpus although only hashed
bits are kept. The filters travel as constants inside the plan while they stay under ``MAX_LITERAL_BITS``;
beyond that they stay a table of shards that is looked up by an equi-join on the shard number.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and no listed key, and so
is allowed. Repeated urls are judged row by row. Of a very long host only as much is cut up as the longest key takes.
Other columns are kept, but for host, path, rule and verdict, which are replaced; _judged_host and _judged_bad are taken. An empty table gives an empty result; an empty list, null and empty keys list nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LITERAL_BITS = 1 << 22  # 512 KB in all levels together; larger cascades are sharded and joined
SHARD_KEYS = 50_000  # keys of the universe in one shard of a large cascade


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_suffixes(host: Column, labels: int, length: int) -> Column:
    """The host and its parent domains that have at most so many labels and characters, as an array; empty for an empty host.

    No key of a list with these bounds is missed, and only the end of a very long host is looked at.
    """
    end = F.substring(host, -(length + 1), length + 1)
    parts = F.split(end, r"\.")
    whole = F.size(parts) - F.when(F.length(host) > length, 1).otherwise(0)  # the first part of a cut end isn't a whole label
    n = F.least(F.lit(labels), whole)
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    return F.when((host == "") | (n < 1), F.array().cast("array<string>")).otherwise(every)


def key_bounds(listed: DataFrame) -> tuple[int, int]:
    """The most labels and characters that a listed key has."""
    r = listed.agg(F.max(F.size(F.split("key", r"\."))).alias("labels"), F.max(F.length("key")).alias("length")).first()
    return r["labels"] or 0, r["length"] or 0


@dataclass(frozen=True)
class Rule:
    """action is allow or block; the rule fits host and its subdomains for paths that start with path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule_columns(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and action of the longest fitting rule (ties: longer host, then block); null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.action != "block", r.name))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ranked):
        fits = r.fits(host, path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


@dataclass(frozen=True)
class Level:
    """One Bloom filter: bits in 64-bit words, its number of hash functions and its seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)


def _positions(key: Column, bits: Column | int, hashes: int, seed: int) -> list[Column]:
    m = bits if isinstance(bits, Column) else F.lit(bits).cast("long")
    return [F.pmod(F.xxhash64(F.lit(1000 * seed + i), key), m) for i in range(hashes)]


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Words and hash functions for n keys at a false-positive rate."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64), max(1, round(-math.log2(rate)))


def _fold(keys: DataFrame, words: int, hashes: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., word, bits) of the filter that holds keys.key: set bits are merged before and after the shuffle."""
    at = F.explode(F.array(*_positions(F.col("key"), 64 * words, hashes, seed))).alias("at")
    return (
        keys.select(*by, at)
        .groupBy(*by, F.expr("at div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    )


def _literal(words: Sequence[int]) -> Column:
    """A constant array<bigint>; the optimizer folds it once."""
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _hit(level: Level, key: Column) -> Column:
    words = _literal(level.words)
    tests = [F.call_function("getbit", F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(key, level.bits, level.hashes, level.seed)]
    return reduce(lambda a, b: a & b, tests)


def _alternate(hits: Sequence[Column]) -> Column:
    """Listed, if the first level that the key misses is an odd one, or if it passes all of an odd number."""
    out = F.lit(len(hits) % 2 == 1)
    for i in reversed(range(len(hits))):
        out = F.when(hits[i], out).otherwise(F.lit(i % 2 == 1))
    return out


def build_cascade(universe: DataFrame) -> list[Level]:
    """universe: (key, listed), each key once. Levels until no key is judged wrongly.

    Only filter words reach the driver: about 1.5 bits a listed key times log2 of the ratio of both sizes.
    """
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    yes, no = universe.where("listed").select("key"), universe.where("not listed").select("key")
    n = inside
    while n:
        rate = min(0.5, max(1e-9, inside * math.sqrt(0.5) / outside)) if not levels and outside else 0.5
        words, hashes = _shape(n, rate)
        seed = len(levels) + 1
        bits = {r["word"]: r["bits"] for r in _fold(yes, words, hashes, seed).collect()}
        level = Level(tuple(bits.get(i, 0) for i in range(words)), hashes, seed)
        levels.append(level)
        yes, no = no.where(_hit(level, F.col("key"))), yes
        n = yes.count()
    return levels


def in_cascade(levels: Sequence[Level], key: Column) -> Column:
    """Exact for keys of the universe that the cascade was built from."""
    return _alternate([_hit(x, key) for x in levels]) if levels else F.lit(False)


def expected_bits(universe: DataFrame) -> int:
    r = universe.agg(F.count_if("listed").alias("r"), F.count("*").alias("u")).first()
    if not r["r"]:
        return 0
    ratio = max(2.0, (r["u"] - r["r"]) / (r["r"] * math.sqrt(0.5)))
    return int(r["r"] * (1.5 * math.log2(ratio) + 5))


def key_universe(urls: DataFrame, listed: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """All host suffixes of ``urls.host`` within bounds, with ``listed`` true where ``listed.key`` holds them; no join.

    Hosts are made distinct before their suffixes, so that a hot host is one row for each task.
    """
    keys = urls.select("host").distinct().select(F.explode(host_suffixes(F.col("host"), *bounds)).alias("key"), F.lit(True).alias("seen"), F.lit(False).alias("is"))
    named = listed.where("key != ''").select("key", F.lit(False).alias("seen"), F.lit(True).alias("is"))
    return keys.unionByName(named).groupBy("key").agg(F.max("seen").alias("seen"), F.max("is").alias("listed")).where("seen").select("key", "listed")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict; columns of those names are replaced.

    A page that no rule fits is blocked if its host or a parent domain is listed, else allowed.
    """
    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    told = pages.withColumns({"host": host, "path": path})
    bounds = key_bounds(listed)
    universe = stored(key_universe(told, listed, bounds), "url-keys")
    name, action = rule_columns(rules, F.col("host"), F.col("path"))
    out = told.withColumns({"rule": name, "verdict": action})
    if expected_bits(universe) <= MAX_LITERAL_BITS:
        levels = build_cascade(universe)
        bad = F.exists(host_suffixes(F.col("host"), *bounds), lambda k: in_cascade(levels, k))
        return out.withColumn("verdict", F.coalesce("verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))))
    return _judge_sharded(out, universe, bounds)


def _judge_sharded(out: DataFrame, universe: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """The same verdicts with a cascade for each shard of the keys, kept as a table.

    Hosts are looked up once each: distinct hosts meet the shards in a hash join, and verdicts come back by host.
    """
    shards = max(1, universe.count() // SHARD_KEYS)
    shard = F.pmod(F.xxhash64(F.lit(-7), F.col("key")), F.lit(shards)).cast("int")
    rest = universe.select("key", "listed", shard.alias("shard"))
    yes, no, levels = rest.where("listed").drop("listed"), rest.where("not listed").drop("listed"), []
    size = max(1, -(-yes.count() // shards))
    while True:
        rate = 0.5 if levels else 1 / 64
        words, hashes = _shape(size, rate)
        seed = 100 + len(levels)
        bits = _fold(yes, words, hashes, seed, ("shard",))
        level = stored(bits.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")), "url-level")
        levels.append((level, words, hashes, seed))
        hit = _shard_hit(no, level, words, hashes, seed)
        yes, no = stored(hit.where("hit").drop("hit"), "url-false"), yes
        n = yes.count()
        if not n:
            break
        size = max(1, -(-n // shards))
    hosts = out.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"), *bounds)).alias("key")).withColumn("shard", shard)
    hosts = hosts.withColumns({"miss": F.lit(-1)})
    for i, (level, words, hashes, seed) in enumerate(levels):
        hosts = _shard_hit(hosts, level, words, hashes, seed).withColumn("miss", F.when((F.col("miss") < 0) & ~F.col("hit"), i).otherwise(F.col("miss"))).drop("hit")
    listed = F.when(F.col("miss") < 0, len(levels) % 2 == 1).otherwise(F.col("miss") % 2 == 1)
    bad = hosts.groupBy(F.col("host").alias("_judged_host")).agg(F.max(listed).alias("_judged_bad"))
    return (
        out.join(bad, F.col("host") == F.col("_judged_host"), "left")
        .withColumn("verdict", F.coalesce("verdict", F.when(F.col("_judged_bad"), F.lit("block")).otherwise(F.lit("allow"))))
        .select(*out.columns)
    )


def _shard_hit(keys: DataFrame, level: DataFrame, words: int, hashes: int, seed: int) -> DataFrame:
    tests = [F.coalesce(F.call_function("getbit", F.try_element_at("words", (p / 64).cast("int")), (p % 64).cast("int")) == 1, F.lit(False)) for p in _positions(F.col("key"), 64 * words, hashes, seed)]
    return keys.join(level, "shard", "left").withColumn("hit", reduce(lambda a, b: a & b, tests)).drop("words")


#: The rules of the query (fixed values).
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: Names of registered domains that the query's list blocks, under each of the zones.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ZONES = ("example.com", "example.net", "example.org")


def listed_domains(spark: SparkSession) -> DataFrame:
    names = spark.range(1).select(F.explode(F.split(F.lit(",".join(LISTED_NAMES)), ",")).alias("name"))
    return names.select(F.explode(F.transform(F.split(F.lit(",".join(LISTED_ZONES)), ","), lambda z: F.concat_ws(".", "name", z))).alias("key"))


def op8_url_filters(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """listed: a table of blocked domains (key); the default is an example."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, listed_domains(spark) if listed is None else listed).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = [(r, f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')") for r in sorted(RULES, key=lambda r: -len(r.name))]
    rule = "case " + " ".join(f"when {x} then '{r.name}'" for r, x in fits) + " end"
    action = "case " + " ".join(f"when {x} then '{r.action}'" for r, x in fits)
    listed = " or ".join(f"host = '{n}.{z}' or ends_with(host, '.{n}.{z}')" for n in LISTED_NAMES for z in LISTED_ZONES)
    return f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut)
select page_id, host, path, {rule} as rule, {action} when {listed} then 'block' else 'allow' end as verdict from parts"""


QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL = {"op8_url_filters": _sql()}
