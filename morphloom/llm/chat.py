"""Chat formatting after cumulative-snapshot collapse.

Systems that log a conversation after every turn leave its prefixes behind as conversations of their own. Each
turn gets a rolling hash of all turns up to it; a conversation whose last hash is an inner hash of another one is a
prefix of it and goes (an anti-join), of equal ones the smallest conv_id stays. Only then are texts rendered.

The rolling hash is the XOR over the prefix of hash(position, role, text), twice with 64 bits. XOR is associative,
so it is summed in blocks of turns and then over blocks: no task needs a whole conversation. Texts do not take part
in these shuffles, only their hashes.

Edge cases: turns are ordered by turn (null first), ties by content hash; a repeated row is a repeated turn. Turn
numbers may have gaps or start anywhere: the position counts. Null role is rendered as ``unknown``, null text as
empty, yet null and empty differ in the comparison. Rows without conv_id belong to no conversation and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored

BLOCK = 256  # turn numbers in one block of the running hash
PART = 1024  # turn numbers in one rendered row


def _content(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).where("conv_id is not null")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, n (turns of the conversation), pos (1 to n) and p1, p2: the hash of its first pos turns."""
    rows = _turns(conversations).select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 50))).alias("block"), "turn", _content(1).alias("c1"), _content(2).alias("c2")
    )
    key = ["conv_id", "block"]
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("turn", "c1", "c2")))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("size"))
    sizes = sizes.select(*key, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"), F.sum("size").over(W.partitionBy("conv_id")).alias("n"))
    rows = rows.join(sizes, key).withColumn("pos", F.col("skip") + F.col("rn"))
    rows = rows.withColumns({f"e{i}": F.xxhash64(F.lit(i), "pos", f"c{i}") for i in (1, 2)})
    upto = W.partitionBy(*key).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    rows = stored(rows.select(*key, "n", "pos", *(F.bit_xor(f"e{i}").over(upto.orderBy("rn")).alias(f"x{i}") for i in (1, 2)), *(F.bit_xor(f"e{i}").over(W.partitionBy(*key)).alias(f"b{i}") for i in (1, 2))), "chat-turns")
    blocks = rows.groupBy(*key).agg(F.first("b1").alias("b1"), F.first("b2").alias("b2"))
    blocks = blocks.select(*key, *(F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)))
    return rows.drop("b1", "b2").join(blocks, key).select("conv_id", "n", "pos", *(F.col(f"x{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"p{i}") for i in (1, 2)))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and n of the conversations that are no prefix of another one and no later copy."""
    hashes = stored(prefix_hashes(conversations), "chat-hashes")
    whole = hashes.where("pos = n").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("pos < n").select("pos", "p1", "p2").distinct()
    return whole.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n"))


def render_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text: the maximal conversations in chat markup, PART turn numbers a row."""
    kept = maximal_conversations(conversations)
    shown = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "c1", "c2", "role", "text"))),
        lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n")),
    )
    turns = _turns(conversations).withColumns({"part": F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1)).cast("long"), "c1": _content(1), "c2": _content(2)})
    return turns.join(kept, "conv_id").groupBy("conv_id", "part").agg(F.first("n").alias("n_turns"), F.array_join(shown, "").alias("text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SQL = f"""
with t as (select conv_id, turn, coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3) said,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) shown from conversations where conv_id is not null),
p as (select conv_id, row_number() over w pos, count(*) over (partition by conv_id) n,
    md5(string_agg(md5(said), '') over (w rows between unbounded preceding and current row)) h from t window w as (partition by conv_id order by turn)),
kept as (select min(conv_id) conv_id, pos n from p where pos = n and (pos, h) not in (select pos, h from p where pos < n) group by pos, h)
select conv_id, cast(floor(turn / {PART}) as bigint) part, any_value(n) n_turns, string_agg(shown, '' order by turn) as text
from t join kept using (conv_id) group by 1, 2"""

QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLE_SQL = {"op10_chat_formatting": _SQL}
