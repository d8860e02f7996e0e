"""The queries of the ten operators, by their names in queries(), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafstack.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    import public_tokenizers

    from leafstack.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    from leafstack.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


OP7_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from p)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 20
"""


@query("op7_topk", OP7_SQL)
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of each vector whose vec_id is divisible by 20."""
    from pyspark.sql import functions as F

    from leafstack.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op6_media")
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive JPEG and read back, as digests and features."""
    from leafstack.llm.media import media_column

    return media_column(table(spark, sf_dir, "documents"), outputs=("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rgb_sha256"))


@query("op10_html")
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of every page."""
    from leafstack.llm.html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdicts on every document."""
    from leafstack.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=("doc_id",))
    return judged.select("doc_id", "p_text", "p_toxic", "host_posterior", "path_posterior", "score", judged.accepted.alias("keep"))


#: The mixture of op5: domains are four groups of sources; other names have the weight 1.
MIX_WEIGHTS = [{"0": 4, "1": 3, "2": 2, "3": 1}, {"en": 12, "fr": 4, "de": 3, "es": 1}, {"src0": 2}]
MIX_PART, MIX_EPOCHS, MIX_SEED = (3, 4), 3, "mix-1"
_LEVEL = """
{n}n as (select {keys}, cast(sum(capacity) as bigint) capacity, cast({weight} as bigint) weight from leaves group by {keys}),
{n}b as (select n.*, {budget} budget from {n}n n {join}),
{n}f as (select *, capacity * sum(weight) over ({part} order by capacity / weight, {name} nulls first rows between current row and unbounded following)
  <= weight * (budget - coalesce(sum(capacity) over ({part} order by capacity / weight, {name} nulls first rows between unbounded preceding and 1 preceding), 0)) fill from {n}b),
{n}g as (select *, coalesce(sum(case when fill then capacity end) over ({part0}), 0) given, sum(case when not fill then weight end) over ({part0}) others from {n}f),
{n} as (select {keys}, capacity, cast(case when fill then capacity else least(capacity, (weight * (budget - given)) // others) end as bigint) alloc from {n}g),
"""


def _case(column: str, given: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in given.items()) + " else 1 end"


def _op5_sql() -> str:
    parts = [
        dict(n="a", keys="domain", weight=_case("domain", MIX_WEIGHTS[0]), budget="(select least((sum(tokens) * %d) // %d, sum(capacity)) from leaves)" % MIX_PART, join="", part="", part0="", name="domain"),
        dict(n="b", keys="domain, lang", weight=_case("lang", MIX_WEIGHTS[1]), budget="a.alloc", join="join a on n.domain is not distinct from a.domain", part="partition by domain", part0="partition by domain", name="lang"),
        dict(n="c", keys="domain, lang, source", weight=_case("source", MIX_WEIGHTS[2]), budget="b.alloc", join="join b on n.domain is not distinct from b.domain and n.lang is not distinct from b.lang", part="partition by domain, lang", part0="partition by domain, lang", name="source"),
    ]
    return rf"""
with d as (select doc_id, lang, source, cast(cast(regexp_extract(source, '(\d+)$', 1) as bigint) % 4 as varchar) domain, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) n_tokens from documents),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) tokens, cast(sum(n_tokens) * {MIX_EPOCHS} as bigint) capacity from d group by all),
{"".join(_LEVEL.format(**p) for p in parts)}
p as (select domain, lang, source, case when capacity > 0 then alloc // (capacity // {MIX_EPOCHS}) else 0 end whole, case when capacity > 0 then alloc % (capacity // {MIX_EPOCHS}) else 0 end rest from c),
o as (select d.*, p.whole, p.rest, md5(concat('{MIX_SEED}:', p.whole, ':', d.doc_id)) place from d join p on d.domain is not distinct from p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
u as (select *, sum(n_tokens) over (partition by domain, lang, source order by place) upto from o)
select doc_id, domain, lang, source, n_tokens, cast(whole + case when upto <= rest then 1 else 0 end as bigint) n_copies from u where whole + case when upto <= rest then 1 else 0 end > 0
"""


@query("op5_mixing", _op5_sql())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture of three quarters of all tokens, and how often it holds each."""
    from pyspark.sql import functions as F

    from leafstack.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    domain = (F.regexp_extract("source", r"(\d+)$", 1).try_cast("long") % 4).cast("string")
    return mix(docs, domain, MIX_WEIGHTS, MIX_PART, MIX_EPOCHS, MIX_SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "n_copies")


@query("op4_substring")
def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when passages of 13 words that an earlier one has are gone."""
    from leafstack.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 13, outputs=("n_words", "n_removed", "kept_sha256"))


@query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    from leafstack.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_lm")
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention scores of every document."""
    import public_tokenizers

    from leafstack.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
