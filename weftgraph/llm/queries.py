"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licenses, mixing, neardup, pii, toolcalls, topk, toxicity, url_filter
from .common import table

BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
#: Hosts whose pages are blocked, with their subdomains, where no rule fits.
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
#: Shares of domains among all tokens, and of languages within them; sources of a language share alike.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4"], "books": ["src5", "src6", "src7", "src8", "src9"], "code": ["src10", "src11", "src12", "src13", "src14"]}
WEIGHTS = {("web",): 0.5, ("books",): 0.2, ("code",): 0.2, ("other",): 0.1} | {
    (d, lang): w for d in [*DOMAINS, "other"] for lang, w in (("en", 0.6), ("de", 0.15), ("fr", 0.15), ("es", 0.1))
}


def tokenizer() -> str:
    """Of WEFT_TOKENIZER, else the byte-level BPE of the public tokenizers' package."""
    if path := os.environ.get("WEFT_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pii_key(spark: SparkSession) -> str:
    """Of the session's setting weftgraph.pii.key; a public one else, which is for tests."""
    return spark.conf.get("weftgraph.pii.key", None) or pii.KEY


def domain() -> F.Column:
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(*sources), name).otherwise(out)
    return out


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), BLOCK, ALLOW, LISTED_HOSTS)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates, checked for collisions over the corpus; entities by their places, types and surrogates."""
    out = pii.checked(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return out.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), F.to_json("entities").alias("entities"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, domain(), WEIGHTS)
    return mixed.select("doc_id", "lang", "source", "mix_epoch", mixing.n_tokens(F.col("text")).alias("n_tokens"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of every user's turn; an assistant's turn without a user's turn before it gives none (``toolcalls.orphans``)."""
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    linked = toolcalls.link(calls, results, toolcalls.TURN_SCHEMA, ["conv_id", "turn"])
    return linked.withColumn("errors", F.to_json("errors"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), 2, 80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_pii, op4_mixing, op5_topk, op6_ann, op7_licenses, op8_tool_calls, op9_bpe, op10_minhash)
}

_LISTED = " or ".join(f"host = '{h}' or host like '%.{h}'" for h in LISTED_HOSTS)
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": f"""
        with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) as path from u),
        r as (select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                             when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                             when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                             when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from p)
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when {_LISTED} then 'block' else 'allow' end as verdict
        from r""",
    "op5_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(r as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) where r <= 5""",
}
