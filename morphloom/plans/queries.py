"""One query for each operator over the whole documents table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import bigrams as B
from ..operators import encoding as E
from ..operators import evaluation as V
from ..operators import merging as T
from ..operators import probe as P
from ..operators import scoring as S
from ..operators import spectral as Z
from ..operators import words as Wd
from ..sources import corpus as C
from ..sources.sinks import to_sorted_json
from .lineage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BATCH = 50
STEM, SUFFIX = "abcdefghijklm", "nopqrstuvwxyz"
SIGMA = 0.2
#: A merge table whose parts come before what is made of them.
MERGES = [("▁", "d"), ("e", "n"), ("e", "r"), ("o", "n"), ("▁", "t"), ("i", "n"), ("▁d", "e"), ("▁t", "h"), ("▁th", "e"), ("a", "n"), ("c", "h"), ("r", "e")]
CURVE_STEP = 3
#: White space as ``functions.measures.SPACE`` has it.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _words(spark: SparkSession, d: str) -> DataFrame:
    return Wd.word_counts(C.read_documents(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.bigram_counts(Wd.segment(_words(spark, d)))


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


W_SQL = f"""occ as (select doc_id, unnest(l) w, unnest(range(len(l))) pos from (select doc_id, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') l from documents)),
words as materialized (select '▁' || w word, count(*) cnt, min({{d: doc_id, p: pos}}) f from occ group by w)"""
P_SQL = W_SQL + """,
seg as (select word, cnt, f, string_split(word, '') t from words),
pairs as materialized (select t[i] a, t[i + 1] b, sum(cnt)::bigint n, min({d: f.d, p: f.p, i: i - 1}) fs from (select *, unnest(range(1, len(t))) i from seg where cnt > 0 and len(t) >= 2) group by 1, 2)"""
A_SQL = P_SQL + """,
z as (select sum(n)::double z from pairs), na as (select a, sum(n)::double x from pairs group by a), nb as (select b, sum(n)::double y from pairs group by b),
assoc as (select * from (select a, b, n, fs, ln((n * (1 / z) + 1e-12) / (x * (1 / z) * (y * (1 / z)) + 1e-12)) pp from pairs join na using (a) join nb using (b), z where n >= 2) where pp > 0)"""
E_SQL = A_SQL + """,
edges as (select a, b, pp w from assoc), aff as (select a, b, sum(w) w from (select a, b, w from edges union all select b, a, w from edges) group by 1, 2)"""
#: A made-up coordinate for each symbol, so that what uses coordinates can be compared.
FZ_SQL = "((unicode({0}) * 7919) % 1000 / 1000.0)::float"


def _made_z(tokens: DataFrame) -> DataFrame:
    return tokens.select("token", ((F.ascii("token") * 7919) % 1000 / 1000.0).cast("float").alias("z"))


@query("word_counts", f"with {W_SQL} select word, cnt, f.d first_doc, f.p::bigint first_pos from words")
def word_counts(spark, d):
    return _words(spark, d).withColumn("first_pos", F.col("first_pos").cast("long"))


@query("word_counts_lower", f"with {W_SQL.replace('(text,', '(lower(text),')} select word, cnt, f.d first_doc, f.p::bigint first_pos from words")
def word_counts_lower(spark, d):
    return Wd.word_counts(C.read_documents(spark, d), lower=True).withColumn("first_pos", F.col("first_pos").cast("long"))


@query("corpus_split", "select doc_id, case when row_number() over (order by doc_id) <= (select count(*) * 9 // 10 from documents) then 'train' else 'val' end as part from documents")
def corpus_split(spark, d):
    return C.split_documents(C.read_documents(spark, d)).select("doc_id", "part")


@query("line_split", "with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents), n as (select doc_id, line, pos, row_number() over (order by doc_id, pos) r, count(*) over () k from l) select doc_id, pos, line, case when r <= floor(k * 0.9) then 'train' else 'val' end as part from n")
def line_split(spark, d):
    """The documents as one text, cut into 90 % of its lines and the rest."""
    return C.split_lines(C.text_lines(C.read_documents(spark, d), "\n")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line", "part")


@query("word_symbols", f"with {P_SQL} select word, array_to_string(t, ' ') symbols, len(t) n_symbols from seg")
def word_symbols(spark, d):
    return Wd.segment(_words(spark, d)).select("word", F.array_join("toks", " ").alias("symbols"), F.size("toks").cast("long").alias("n_symbols"))


@query("char_vocab", f"with {P_SQL}, v as (select distinct unnest(t) token from seg) select token, row_number() over (order by token) - 1 id from v")
def char_vocab(spark, d):
    return Wd.with_ids(Wd.vocabulary(Wd.segment(_words(spark, d)))).withColumn("id", F.col("id").cast("long"))


@query("mergeable_words", f"with {P_SQL} select word, cnt from seg where cnt > 0 and len(t) >= 2")
def mergeable_words(spark, d):
    return Wd.mergeable(Wd.segment(_words(spark, d))).select("word", "cnt")


@query("bigram_counts", f"with {P_SQL} select a, b, n, fs.d first_doc, fs.p::bigint first_pos, fs.i::bigint first_at from pairs")
def bigram_counts(spark, d):
    fs = F.col("first_seen")
    return _pairs(spark, d).select("a", "b", "n", fs["first_doc"].alias("first_doc"), fs["first_pos"].cast("long").alias("first_pos"), fs["at"].cast("long").alias("first_at"))


@query("top_bigrams", f"with {P_SQL} select a, b, n from pairs order by n desc, fs limit 100")
def top_bigrams(spark, d):
    return _pairs(spark, d).orderBy(F.desc("n"), "first_seen").limit(100).select("a", "b", "n")


@query("bigram_marginals", f"with {A_SQL} select a, b, n, x::bigint n_first, y::bigint n_second, z::bigint z from pairs join na using (a) join nb using (b), z")
def bigram_marginals(spark, d):
    return B.marginals(_pairs(spark, d)).select("a", "b", "n", "n_first", "n_second", "z")


@query("ppmi_tau2", f"with {A_SQL} select a, b, n, round(pp, 6) ppmi from assoc")
def ppmi_tau2(spark, d):
    return B.ppmi(_pairs(spark, d), 2).select("a", "b", "n", *_r("ppmi"))


for _alpha, _name in ((0.0, "a0"), (0.5, "a05")):

    @query(f"spectral_weights_{_name}", f"with {A_SQL} select a, b, round(pp * pow(n, {_alpha}), 6) w from assoc")
    def spectral_weights(spark, d, alpha=_alpha):
        return B.edge_weights(B.ppmi(_pairs(spark, d)), alpha).select("a", "b", *_r("w"))

    @query(f"score_ppmi_discounted_{_name}", f"with {A_SQL} select a, b, round(pp * n * pow(n, {_alpha}), 6) score from assoc")
    def score_ppmi_discounted(spark, d, alpha=_alpha):
        return S.score(_pairs(spark, d), "ppmi_discounted", alpha=alpha).select("a", "b", *_r("score"))


@query("sym_affinity", f"with {E_SQL} select a, b, round(w, 6) w from aff")
def sym_affinity(spark, d):
    return B.symmetric(B.edge_weights(B.ppmi(_pairs(spark, d)))).select("a", "b", *_r("w"))


@query(
    "laplacian_entries",
    f"with {E_SQL}, deg as (select a, greatest(sum(w), 1e-9) d from aff group by a), v as (select distinct unnest(t) a from seg), e as (select x.a, x.b, -w / (sqrt(p.d) * sqrt(q.d)) v from aff x join deg p on x.a = p.a join deg q on x.b = q.a union all select a, a, 1.0 from v) select a, b, round(sum(v), 6) v from e group by 1, 2",
)
def laplacian_entries(spark, d):
    words = Wd.segment(_words(spark, d))
    affinity = B.symmetric(B.edge_weights(B.ppmi(B.bigram_counts(words))))
    return B.laplacian(affinity, Wd.vocabulary(words)).select("a", "b", *_r("v"))


def _embedding(spark: SparkSession, d: str) -> DataFrame:
    words = Wd.segment(_words(spark, d))
    affinity = B.symmetric(B.edge_weights(B.ppmi(B.bigram_counts(words))))
    return Z.embedding(affinity, Wd.with_ids(Wd.vocabulary(words)))


@query("spectral_embedding")
def spectral_embedding(spark, d):
    """The sign of an eigenvector is free: absolute values."""
    return _embedding(spark, d).select("token", "id", F.round(F.abs("z").cast("double"), 4).alias("abs_z"))


@query("spectral_embedding_permuted")
def spectral_embedding_permuted(spark, d):
    return Z.permuted(_embedding(spark, d), 0).select("token", "id", F.round(F.abs("z").cast("double"), 4).alias("abs_z"))


_GAP = f"({FZ_SQL.format('a')} - {FZ_SQL.format('b')})::double"


@query("sigma_auto", f"with {A_SQL} select round(quantile_cont(abs({_GAP}), 0.5) + 1e-6, 6) sigma from assoc")
def sigma_auto(spark, d):
    words = Wd.segment(_words(spark, d))
    edges = B.edge_weights(B.ppmi(B.bigram_counts(words)))
    return Z.auto_sigma(edges, _made_z(Wd.vocabulary(words))).select(*_r("sigma"))


@query("score_freq", f"with {P_SQL} select a, b, n::double score from pairs")
def score_freq(spark, d):
    return S.score(_pairs(spark, d), "freq").select("a", "b", "score")


@query("score_pmi_only", f"with {A_SQL} select a, b, round(pp, 6) score from assoc")
def score_pmi_only(spark, d):
    return S.score(_pairs(spark, d), "pmi_only").select("a", "b", *_r("score"))


@query("score_spectral", f"with {A_SQL} select * from (select a, b, round(pp * n * exp(-1.0 * {_GAP} * {_GAP} / (2.0 * {SIGMA} * {SIGMA})), 6) score from assoc) where score > 0")
def score_spectral(spark, d):
    words = Wd.segment(_words(spark, d))
    sigma = spark.range(1).select(F.lit(SIGMA).alias("sigma"))
    out = S.score(B.bigram_counts(words), "spectral", z=_made_z(Wd.vocabulary(words)), sigma=sigma)
    return out.select("a", "b", *_r("score")).where("score > 0")


def _greedy(name: str, pairs: str) -> str:
    """Recursive CTEs that walk the pairs in order and take those without a used symbol."""
    return f"""
{name}_o as materialized (select a, b, n::double score, row_number() over (order by n desc, fs) r from {pairs}),
{name}_g(r, used, k, a, b, score, taken) as (select 0::bigint, []::varchar[], 0, null::varchar, null::varchar, null::double, false
  union all select o.r, case when not list_contains(g.used, o.a) and not list_contains(g.used, o.b) then g.used || [o.a, o.b] else g.used end,
    g.k + case when not list_contains(g.used, o.a) and not list_contains(g.used, o.b) then 1 else 0 end, o.a, o.b, o.score, not list_contains(g.used, o.a) and not list_contains(g.used, o.b)
  from {name}_g g join {name}_o o on o.r = g.r + 1 where g.k < {BATCH}),
{name} as materialized (select row_number() over (order by r) step, a, b, a || b new_token, score from {name}_g where taken)"""


def _apply(name: str, source: str, picks: str) -> str:
    """Recursive CTE over the picks: tokens stand in chr(1) and chr(2), those just made in chr(3) and chr(4)."""
    return f"""
{name}_r(word, s, k) as (select word, s, 0::bigint from {source} union all select word, replace(s, chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(3) || a || b || chr(4)), k + 1 from {name}_r join {picks} on step = k + 1),
{name} as materialized (select word, replace(replace(s, chr(3), chr(1)), chr(4), chr(2)) s from {name}_r where k = (select count(*) from {picks}))"""


G0_SQL = P_SQL + "," + _greedy("p0", "pairs")
G1_SQL = G0_SQL + ",\ns0 as materialized (select word, chr(1) || array_to_string(t, chr(2) || chr(1)) || chr(2) s from seg)," + _apply("s1", "s0", "p0")
_TOKS = "string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1))"
_SECOND_SQL = f"""
seg1 as (select word, cnt, f, {_TOKS} t from s1 join words using (word)),
pairs1 as materialized (select t[i] a, t[i + 1] b, sum(cnt)::bigint n, min({{d: f.d, p: f.p, i: i - 1}}) fs from (select *, unnest(range(1, len(t))) i from seg1 where cnt > 0 and len(t) >= 2) group by 1, 2),"""
G2_SQL = (
    G1_SQL
    + ","
    + _SECOND_SQL
    + _greedy("p1", "pairs1")
    + f""",
log as (select step, a, b, new_token, score, 0::bigint batch_id from p0 union all select step + (select count(*) from p0), a, b, new_token, score, 1 from p1)"""
)


def _batch0(spark: SparkSession, d: str) -> list[S.Pick]:
    return S.conflict_free(stored(S.score(_pairs(spark, d), "freq"), "scored"), BATCH)


def _pick_table(spark: SparkSession, picks: list[S.Pick]) -> DataFrame:
    return spark.createDataFrame([(i + 1, p.a, p.b, p.token, p.score) for i, p in enumerate(picks)], "step long, a string, b string, new_token string, score double")


@query("select_batch0_freq", f"with recursive {G0_SQL} select step, a, b, new_token, score from p0")
def select_batch0_freq(spark, d):
    return _pick_table(spark, _batch0(spark, d))


@query("apply_batch0", f"with recursive {G1_SQL} select word, array_to_string({_TOKS}, ' ') tokens, len({_TOKS}) n_tokens from s1")
def apply_batch0(spark, d):
    words = Wd.segment(_words(spark, d))
    out = T.apply_batch(words, S.conflict_free(stored(S.score(B.bigram_counts(words), "freq"), "scored"), BATCH))
    return out.select("word", F.array_join("toks", " ").alias("tokens"), F.size("toks").cast("long").alias("n_tokens"))


def _train(spark: SparkSession, d: str, method: str = "freq", **more) -> T.Trained:
    """Trained up to the default size of a vocabulary, unless max_batches is given."""
    return T.train(_words(spark, d), T.TrainConfig(method=method, batch_size=BATCH, **more))


@query("train_freq_2batches", f"with recursive {G2_SQL} select step, a, b, new_token, score, batch_id from log")
def train_freq_2batches(spark, d):
    """The first two batches of train_freq, as far as SQL follows."""
    log = _train(spark, d, max_batches=2).log
    return log.select(F.col("step").cast("long").alias("step"), "a", "b", "new_token", "score", F.col("batch_id").cast("long").alias("batch_id"))


@query("train_freq")
def train_freq(spark, d):
    log = _train(spark, d).log
    return log.select(F.col("step").cast("long").alias("step"), "a", "b", "new_token", "score", F.col("batch_id").cast("long").alias("batch_id"))


@query("vocab_after_2batches", f"with recursive {G2_SQL}, v as (select unnest(t) token from seg union select new_token from log) select token, row_number() over (order by token) - 1 id from v")
def vocab_after_2batches(spark, d):
    return _train(spark, d, max_batches=2).vocab_table().withColumn("id", F.col("id").cast("long"))


for _method in S.METHODS[1:]:

    @query(f"train_{_method}")
    def train_method(spark, d, method=_method):
        """Up to the default vocabulary; coordinates only where the method needs them."""
        log = _train(spark, d, method, log_z=method.startswith("spectral"), stem_chars=STEM, suffix_chars=SUFFIX).log
        return log.withColumns({"score": F.round("score", 3), "z_dist": F.round("z_dist", 3)})


def _associated_sql(name: str, pairs: str, score: str) -> str:
    """Pairs with a score of their association in place of n, as _greedy orders them."""
    return f"""
{name} as materialized (select a, b, {score} n, fs from (select a, b, n::double n, fs, ln((n * (1 / z) + 1e-12) / (x * (1 / z) * (y * (1 / z)) + 1e-12)) pp
  from {pairs} join (select a, sum(n)::double x from {pairs} group by a) using (a) join (select b, sum(n)::double y from {pairs} group by b) using (b), (select sum(n)::double z from {pairs}) where n >= 2) where pp > 0)"""


def _two_batches_sql(score: str) -> str:
    first, second = (_associated_sql(f"scored{i}", p, score) + "," + _greedy(f"p{i}", f"scored{i}") for i, p in enumerate(("pairs", "pairs1")))
    return (
        P_SQL + "," + first + ",\ns0 as materialized (select word, chr(1) || array_to_string(t, chr(2) || chr(1)) || chr(2) s from seg)," + _apply("s1", "s0", "p0") + "," + _SECOND_SQL + second
        + """,
log as (select step, a, b, new_token, score, 0::bigint batch_id from p0 union all select step + (select count(*) from p0), a, b, new_token, score, 1 from p1)"""
    )


for _method, _score in (("pmi_only", "pp"), ("ppmi_discounted", "pp * n * pow(n, 0.0)")):

    @query(f"train_{_method}_2batches", f"with recursive {_two_batches_sql(_score)} select step, a, b, new_token, round(score, 6) score, batch_id from log")
    def train_method_2batches(spark, d, method=_method):
        """The first two batches of train_*, as far as SQL follows."""
        log = _train(spark, d, method, max_batches=2).log
        return log.select(F.col("step").cast("long").alias("step"), "a", "b", "new_token", *_r("score"), F.col("batch_id").cast("long").alias("batch_id"))


@query("first_snapshot")
def first_snapshot(spark, d):
    return _train(spark, d, "spectral", max_batches=1).z_snapshot.select("token", "id", F.round(F.abs("z").cast("double"), 4).alias("abs_z"))


_DOMAIN = f"case when regexp_matches(new_token, '[{STEM}]') and regexp_matches(new_token, '[{SUFFIX}]') then 3 when regexp_matches(new_token, '[{STEM}]') then 1 when regexp_matches(new_token, '[{SUFFIX}]') then 2 else 0 end"


@query("token_domain", f"with recursive {G0_SQL} select new_token, ({_DOMAIN})::bigint as domain from p0")
def token_domain(spark, d):
    return select_batch0_freq(spark, d).select("new_token", M.token_domain(F.col("new_token"), STEM, SUFFIX).cast("long").alias("domain"))


#: The log of the first batch with made-up distances, some of them missing.
L_SQL = G0_SQL + f", log as (select step, a, b, new_token, score, ({_DOMAIN}) = 3 is_cross, case when step % 9 = 0 then null else (step * 37) % 101 / 100.0 end z_dist from p0)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    rows = select_batch0_freq(spark, d)
    z = F.when(F.col("step") % 9 == 0, None).otherwise((F.col("step") * 37) % 101 / 100.0)
    return rows.withColumns({"is_cross_boundary": M.token_domain(F.col("new_token"), STEM, SUFFIX) == 3, "z_dist": z})


@query("first_cross", f"with recursive {L_SQL} select min(step) filter (is_cross) first_cross_step from log")
def first_cross(spark, d):
    return V.first_cross(_log(spark, d))


@query("log_summary", f"with recursive {L_SQL} select round(count(*) filter (is_cross) / greatest(1, count(*)), 6) cross_frac, round(avg(z_dist) filter (step <= 50), 6) mean_zdist from log")
def log_summary(spark, d):
    return V.log_summary(_log(spark, d)).select(*_r("cross_frac", "mean_zdist"))


@query("cumulative_cross", f"with recursive {L_SQL} select step, round(avg(case when is_cross then 1.0 else 0.0 end) over (order by step), 6) cross_frac from log where step <= 40")
def cumulative_cross(spark, d):
    return V.cumulative_cross(_log(spark, d), 40).select("step", *_r("cross_frac"))


@query("moving_zdist", f"with recursive {L_SQL} select step, round(m, 6) z_dist from (select step, avg(z_dist::float) over w m, count(*) over w k from log where step <= 40 and z_dist is not null window w as (order by step rows between 6 preceding and current row)) where k = 7")
def moving_zdist(spark, d):
    return V.moving_distance(_log(spark, d), 40, 7).select("step", *_r("z_dist"))


@query("first20_merges", f"with recursive {L_SQL} select step, a, b, new_token, score from log where step <= 20")
def first20_merges(spark, d):
    return V.first_merges(_log(spark, d), 20)


@query(
    "z_histogram",
    f"with {P_SQL}, v as (select distinct unnest(t) token from seg), k as (select case when token between 'a' and 'm' then 'stem' else 'suffix' end kind, {FZ_SQL.format('token')}::double z from v where length(token) = 1 and token between 'a' and 'z'), s as (select kind, min(z) lo, max(z) hi, count(*) total from k group by 1) select kind, least(30, floor((z - lo) / ((hi - lo) / 30))::int + 1)::bigint as bin, count(*) n, round(count(*) / any_value(total) / any_value((hi - lo) / 30), 6) density from k join s using (kind) group by 1, 2",
)
def z_histogram(spark, d):
    z = _made_z(Wd.vocabulary(Wd.segment(_words(spark, d))))
    return V.histogram(V.stem_suffix_values(z, STEM, SUFFIX), "kind", "z").select("kind", F.col("bin").cast("long").alias("bin"), "n", *_r("density"))


def _encoded_sql(m: int = len(MERGES)) -> str:
    s = "chr(1) || array_to_string(string_split(word, ''), chr(2) || chr(1)) || chr(2)"
    for a, b in MERGES[:m]:
        s = f"replace({s}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a}{b}' || chr(2))"
    return s


ENC_SQL = W_SQL + f", enc as (select word, cnt, {_TOKS} t from (select word, cnt, {_encoded_sql()} s from words))"


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return E.encode_words(_words(spark, d).select("word", "cnt"), MERGES)


@query("encode_words", f"with {ENC_SQL} select word, array_to_string(t, ' ') tokens, len(t) n_tokens from enc")
def encode_words(spark, d):
    return _encoded(spark, d).select("word", F.array_join("toks", " ").alias("tokens"), F.size("toks").cast("long").alias("n_tokens"))


#: Vocabulary of the ids: all symbols but x and ä, and the merged tokens but "re"; no unknown token.
_V_SQL = ENC_SQL + ", v0 as (select distinct unnest(string_split(word, '')) token from words union select unnest([" + ", ".join(f"'{a}{b}'" for a, b in MERGES) + "])), v as (select token, row_number() over (order by token) - 1 id from v0 where token not in ('x', 'ä', 're'))"


def _ids_vocab(spark: SparkSession, d: str) -> DataFrame:
    tokens = Wd.text_symbols(C.read_documents(spark, d)).unionByName(spark.createDataFrame([(a + b,) for a, b in MERGES], "token string")).distinct()
    return Wd.with_ids(tokens.where(~F.col("token").isin("x", "ä", "re")))


@query(
    "token_ids",
    f"with {_V_SQL}, x as (select word, unnest(t) token, unnest(range(len(t))) pl from enc), y as (select word, pl, 0 sub, token from x where token in (select token from v) union all select word, pl, unnest(range(len(c))), unnest(c) from (select word, pl, string_split(token, '') c from x where token not in (select token from v))) select word, row_number() over (partition by word order by pl, sub) - 1 as pos, id from y join v using (token)",
)
def token_ids(spark, d):
    return E.token_ids(_encoded(spark, d), _ids_vocab(spark, d)).withColumn("id", F.col("id").cast("long"))


@query("document_token_counts", f"with {ENC_SQL} select doc_id, coalesce(sum(len(t)), 0)::bigint n_tokens from documents left join (select doc_id, '▁' || w word from occ) using (doc_id) left join enc using (word) group by doc_id")
def document_token_counts(spark, d):
    docs = C.read_documents(spark, d)
    vocab = Wd.with_ids(Wd.text_symbols(docs).unionByName(spark.createDataFrame([(a + b,) for a, b in MERGES], "token string")).distinct())
    return E.encode_documents(docs, MERGES, vocab).select("doc_id", "n_tokens")


@query("encode_words_trained")
def encode_words_trained(spark, d):
    """encode_words with the merges that train_freq learns."""
    words = stored(_words(spark, d), "word-counts")
    out = E.encode_words(words.select("word", "cnt"), T.train(words, T.TrainConfig(batch_size=BATCH)).merges)
    return out.select("word", F.array_join("toks", " ").alias("tokens"), F.size("toks").cast("long").alias("n_tokens"))


@query("document_token_counts_trained")
def document_token_counts_trained(spark, d):
    """document_token_counts with the merges and the vocabulary that train_freq learns."""
    model = _train(spark, d)
    return E.encode_documents(C.read_documents(spark, d), model.merges, model.vocab_table()).select("doc_id", "n_tokens")


@query("corpus_bytes", "select count(*) n_docs, (sum(strlen(text)) + count(*) - 1)::bigint n_bytes from documents")
def corpus_bytes(spark, d):
    return Wd.corpus_bytes(C.read_documents(spark, d))


@query("tokens_per_byte", f"with {ENC_SQL}, t as (select sum(cnt * len(t)) k from enc), b as (select sum(strlen(text)) + count(*) - 1 n from documents) select k::bigint n_tokens, n::bigint n_bytes, round(k / n, 6) tokens_per_byte from t, b")
def tokens_per_byte(spark, d):
    k = _encoded(spark, d).agg(F.sum(F.size("toks") * F.col("cnt")).alias("n_tokens"))
    rows = k.join(Wd.corpus_bytes(C.read_documents(spark, d)))  # one row each
    return rows.select("n_tokens", "n_bytes", F.round(F.col("n_tokens") / F.col("n_bytes"), 6).alias("tokens_per_byte"))


@query("bits_per_byte", f"with {ENC_SQL}, t as (select sum(cnt * len(t)) k from enc), b as (select sum(strlen(text)) + count(*) - 1 n from documents) select round(3.5 / ln(2) * k / n, 6) bits_per_byte, round(3.5 / ln(2), 6) bits_per_token, greatest(64, least(256, round_even(512 * k / n, 0)))::bigint seq_len from t, b")
def bits_per_byte(spark, d):
    rows = tokens_per_byte(spark, d)
    nats = F.lit(3.5)
    per_byte = F.col("n_tokens") / F.col("n_bytes")
    return rows.select(F.round(M.bits_per_byte(nats, F.col("n_tokens"), F.col("n_bytes")), 6).alias("bits_per_byte"), F.round(M.bits_per_token(nats), 6).alias("bits_per_token"), M.sequence_length(per_byte, "byte_span").cast("long").alias("seq_len"))


#: Samples: longer words, cut in the middle.
_S_SQL = "s as (select word, length(word) // 2 boundary, cnt from words where length(word) >= 7 and cnt >= 2)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("word")
    return _words(spark, d).where((n >= 7) & (F.col("cnt") >= 2)).select("word", F.floor(n / 2).cast("int").alias("boundary"), "cnt")


def _curve_sql(points: list[int]) -> str:
    parts = " union all ".join(f"select {m}::bigint merges, word, boundary, cnt, {_TOKS} t from (select word, boundary, cnt, {_encoded_sql(m)} s from s)" for m in points)
    return f"""{W_SQL}, {_S_SQL}, c as ({parts}),
cuts as (select merges, cnt, boundary, len(t) k, list_transform(range(1, len(t)), lambda i: list_sum(list_transform(t[1:i], lambda x: length(x)))) p from c),
tot as (select merges, sum(cnt)::double gold, sum(len(p) * cnt)::double pred, sum(case when list_contains(p, boundary) then cnt else 0 end)::double tp, sum(k * cnt)::double tokens from cuts group by merges),
met as (select merges, case when pred > 0 then tp / pred else 0 end prec, case when gold > 0 then tp / gold else 0 end rec, case when gold > 0 then tokens / gold else 0 end tpw from tot),
curve as (select merges, prec, rec, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end f1, tpw from met)"""


_POINTS = list(range(0, len(MERGES) + 1, CURVE_STEP))
CURVE_SQL = _curve_sql(_POINTS)


@query("boundary_eval", f"with {_curve_sql([len(MERGES)])} select round(prec, 6) as precision, round(rec, 6) recall, round(f1, 6) f1, round(rec, 6) boundary_acc, round(tpw, 6) avg_tokens_per_word from curve")
def boundary_eval(spark, d):
    return V.evaluate_boundaries(_samples(spark, d), MERGES).select(*_r("precision", "recall", "f1", "boundary_acc", "avg_tokens_per_word"))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return V.retention_curve(_samples(spark, d), MERGES, len(MERGES), CURVE_STEP).withColumn("merges", F.col("merges").cast("long"))


@query("retention_curve", f"with {CURVE_SQL} select merges, round(rec, 6) boundary_acc, round(f1, 6) boundary_f1, round(tpw, 6) avg_tokens_per_word from curve")
def retention_curve(spark, d):
    return _curve(spark, d).select("merges", *_r("boundary_acc", "boundary_f1", "avg_tokens_per_word"))


@query("accuracy_curve", f"with {CURVE_SQL} select merges, round(rec, 6) boundary_acc from curve")
def accuracy_curve(spark, d):
    return V.accuracy_curve(_curve(spark, d)).select("merges", *_r("boundary_acc"))


@query("curve_by_tokens", f"with {CURVE_SQL} select round(tpw, 6) avg_tokens_per_word, round(rec, 6) boundary_acc, row_number() over (order by tpw, merges) place from curve")
def curve_by_tokens(spark, d):
    return V.curve_by_tokens(_curve(spark, d)).select(*_r("avg_tokens_per_word", "boundary_acc"), F.col("place").cast("long").alias("place"))


@query(
    "auc_over_tokens",
    f"with {CURVE_SQL}, th as (select (min(tpw) + max(tpw)) / 2 t, max(tpw) x0, count(*) k from curve), l as (select tpw x, rec y, lag(tpw) over w px, lag(rec) over w py from curve window w as (order by tpw desc, merges)), seg as (select case when px is null then 0 when x >= t then 0.5 * (py + y) * (px - x) when px > t then 0.5 * (py + py + (y - py) * (px - t) / greatest(1e-9, px - x)) * (px - t) else 0 end area from l, th) select round(case when any_value(k) >= 2 and any_value(t) > 0 and any_value(t) < any_value(x0) then sum(area) / any_value(x0 - t) end, 6) auc from seg, th",
)
def auc_over_tokens(spark, d):
    curve = _curve(spark, d)
    middle = curve.agg(((F.min("avg_tokens_per_word") + F.max("avg_tokens_per_word")) / 2).alias("middle"))  # one row
    return V.auc_over_tokens(curve.join(middle), F.col("middle")).select(*_r("auc"))


@query(
    "matched_threshold",
    f"with {CURVE_SQL}, m as (select 'all' as method, tpw from curve union all select 'half', tpw from curve where merges <= 6), spans as (select method, min(tpw) lo, max(tpw) hi from m group by 1) select round(max(lo), 6) common_min, round(min(hi), 6) common_max, round(max(lo), 6) threshold from spans",
)
def matched_threshold(spark, d):
    curve = _curve(spark, d)
    both = curve.withColumn("method", F.lit("all")).unionByName(curve.where("merges <= 6").withColumn("method", F.lit("half")))
    return V.matched_threshold(both).select(*_r("common_min", "common_max", "threshold"))


#: Pairs that are looked up in the merge table of the first batch.
_LOOKED = [("e", "n"), ("o", "n"), ("a", "n"), ("q", "u"), ("x", "q")]
R_SQL = G0_SQL + ", q as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in _LOOKED) + ") t(a, b)), rk as (select q.a, q.b, max(step) as rank from q left join p0 on p0.a = q.a and p0.b = q.b group by 1, 2)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    merges = select_batch0_freq(spark, d).select((F.col("step") - 1).alias("rank"), "a", "b")
    return V.pair_ranks(merges, spark.createDataFrame(_LOOKED, "a string, b string"))


@query("boundary_ranks", f"with recursive {R_SQL} select a, b, rank::double as rank from rk")
def boundary_ranks(spark, d):
    return _ranks(spark, d).withColumn("rank", F.col("rank").cast("double"))


@query("rank_summary", f"with recursive {R_SQL} select min(rank)::double min_rank, round(avg(rank), 6) mean_rank, max(rank)::double max_rank, count(*) filter (rank is null) missing from rk")
def rank_summary(spark, d):
    return V.rank_summary(_ranks(spark, d)).withColumn("mean_rank", F.round("mean_rank", 6))


def _probe_sql(exclude: bool) -> str:
    def arm(affixes: tuple[str, ...], prefix: bool) -> str:
        table = ", ".join(f"({i}, '{x}')" for i, x in enumerate(affixes))
        base = "substr(w, len(x) + 1)" if prefix else "left(w, len(w) - len(x))"
        fits = "starts_with(w, x)" if prefix else "ends_with(w, x)"
        return f"select w, cnt, o, len(x) n, {base} base from lw, (values {table}) t(o, x) where cnt >= 2 and {fits} and len(w) > len(x) and len(x) >= 2"

    drop = " or ".join([f"(starts_with(base, '{x}') and len(base) > {len(x) + 2})" for x in P.PREFIXES] + [f"(ends_with(base, '{x}') and len(base) > {len(x) + 2})" for x in P.SUFFIXES]) if exclude else "false"
    return f"""with lw as (select w, count(*) cnt from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) w from documents) group by w),
p as (select c.*, coalesce(b.cnt, 0) bc, ({drop}) dr from ({arm(P.PREFIXES, True)}) c left join (select w base, cnt from lw) b using (base)),
s as (select c.*, coalesce(b.cnt, 0) bc, ({drop}) dr from ({arm(P.SUFFIXES, False)}) c left join (select w base, cnt from lw) b using (base)),
p1 as (select w, cnt, arg_min({{dr: dr, n: n}}, o) f from p where dr or bc >= 5 group by 1, 2),
s1 as (select w, cnt, arg_min({{dr: dr, n: len(base)}}, o) f from s where dr or bc >= 5 group by 1, 2)
select '▁' || w word, (1 + f.n)::bigint boundary, cnt, 'prefix' arm from p1 where not f.dr
union all select '▁' || w, (1 + f.n)::bigint, cnt, 'suffix' from s1 where not f.dr and w not in (select w from p1 where f.dr)"""


for _exclude, _name in ((False, "affix_probe"), (True, "affix_probe_excl")):

    @query(_name, _probe_sql(_exclude))
    def affix_probe(spark, d, exclude=_exclude):
        return P.affix_probe(C.read_documents(spark, d), exclude_affixed=exclude).withColumn("boundary", F.col("boundary").cast("long"))


@query("synthetic_words")
def synthetic_words(spark, d):
    train, samples = C.synthetic_words(spark)
    return train.select("word", F.lit(None).cast("int").alias("boundary"), "cnt", F.lit("train").alias("part")).unionByName(samples.withColumn("part", F.lit("val")))


@query("synthetic_words_distributed")
def synthetic_words_distributed(spark, d):
    return C.synthetic_words_distributed(spark)


@query("synthetic_eval")
def synthetic_eval(spark, d):
    """The synthetic stage: boundary metrics for each method."""
    from .stages import synthetic_stage

    return synthetic_stage(spark).summary


@query("text_eval")
def text_eval(spark, d):
    """The study of real text: compression of held-out documents and the affix probe for each method."""
    from .stages import text_stage

    return text_stage(C.read_documents(spark, d)).summary


_JSON = "'{\"avg_tokens_per_word\":' || round(tpw, 6) || ',\"boundary_acc\":' || round(rec, 6) || ',\"f1\":' || round(f1, 6) || ',\"precision\":' || round(prec, 6) || ',\"recall\":' || round(rec, 6) || '}'"


@query("json_report", f"with {_curve_sql([len(MERGES)])} select {_JSON} as json from curve")
def json_report(spark, d):
    return to_sorted_json(boundary_eval(spark, d))
