"""The queries of the training-data operators: thin digests over each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, byte_bpe, exact_topk, lm_scoring, quality, secret_scan, simhash, suffix_dedup, token_output, toxicity
from .common import documents


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), passage=suffix_dedup.PASSAGE)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_sequences(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_secret_scan": op2_secret_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_output": op4_token_output,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_lm_scoring": op10_lm_scoring,
}

_TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""

_LM_SQL = r"""
with d as (
  select row_number() over () r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') ws from documents
), w as (select r, unnest(ws) x, generate_subscripts(ws, 1) p from d),
g as (select r, p, x, lag(x) over (partition by r order by p) v, lag(x, 2) over (partition by r order by p) u from w),
c1 as (select *, sum(own) over (partition by x) - own c from (select r, x, count(*) own from g group by all)),
c2 as (select *, sum(own) over (partition by v, x) - own c from (select r, v, x, count(*) own from g where v is not null group by all)),
c3 as (select *, sum(own) over (partition by u, v, x) - own c from (select r, u, v, x, count(*) own from g where u is not null group by all)),
s1 as (select g.*, ln(greatest(c1.c, 0.5) / greatest((select count(*) from w) - len(d.ws), 1)) l from g join d using (r) join c1 using (r, x)),
s2 as (
  select s1.* exclude (l), c2.c pair, case when s1.v is null then l when c2.c > 0 then ln(c2.c) - ln(h.c) else ln(0.4) + l end l
  from s1 left join c2 on c2.r = s1.r and c2.v = s1.v and c2.x = s1.x left join c1 h on h.r = s1.r and h.x = s1.v
), s3 as (
  select s2.r, case when s2.u is null then l when c3.c > 0 then ln(c3.c) - ln(h.c) else ln(0.4) + l end l
  from s2 left join c3 on c3.r = s2.r and c3.u = s2.u and c3.v = s2.v and c3.x = s2.x left join c2 h on h.r = s2.r and h.v = s2.u and h.x = s2.v
), t as (select r, sum(l) l from s3 group by 1)
select doc_id, cast(len(ws) as bigint) n_words, round(coalesce(l, 0.0), 6) log_score, case when len(ws) > 0 then round(l / len(ws), 6) end mean_log from d left join t using (r)
"""



def _covered(name: str, n: int) -> str:
    """Maximal runs of bytes that repeated strings of n bytes cover; h: the text's bytes in hexadecimal."""
    return f"""
{name}_parts as (select r, p, substr(h, 1024 * p + 1, {1024 + 2 * (n - 1)}) w from (select r, h, unnest(range(0, greatest(len(h) // 2 - {n - 1} + 511, 0) // 512)) p from d)),
{name}_at as (select r, p, w, unnest(range(0, greatest(len(w) // 2 - {n - 1}, 0))) k from {name}_parts),
{name}_rep as (select r, k from (select r, 512 * p + k k, count(*) over (partition by md5(substr(w, 2 * k + 1, {2 * n}))) c from {name}_at) where c > 1),
{name}_new as (select r, k, case when k > lag(k) over (partition by r order by k) + {n} then 1 else 0 end b from {name}_rep),
{name} as (select r, min(k) lo, max(k) + {n} hi from (select r, k, sum(b) over (partition by r order by k) island from {name}_new) group by r, island)"""


_SUFFIX_SQL = f"""
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),{_covered('long_', 400)},{_covered('short_', 240)},
gaps as (select r, lo, hi, coalesce(lag(hi) over (partition by r order by lo), 0) before from long_),
cut as (select r, sum(hi - lo) gone, count(*) spans, max(hi) last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' order by lo) kept from gaps join d using (r) group by r),
passages as (select r, sum(hi - lo) gone from short_ group by r)
select doc_id, cast(len(h) // 2 as bigint) n_bytes, cast(coalesce(cut.gone, 0) as bigint) n_removed, coalesce(spans, 0) n_spans,
  sha256(unhex(case when cut.r is null then h else kept || substr(h, 2 * last + 1) end)) kept_sha256, cast(coalesce(passages.gone, 0) as bigint) n_passage
from d left join cut using (r) left join passages on passages.r = d.r
"""

#: The others have no equal in SQL over whole tables; tests/llm holds their brute-force versions.
ORACLE: dict[str, str] = {"op1_exact_topk": _TOPK_SQL, "op3_suffix_dedup": _SUFFIX_SQL, "op10_lm_scoring": _LM_SQL}
