"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import encode_documents
from tessella.llm.fingerprints import neighbour_fingerprints
from tessella.llm.kdtree import integer_vectors, top_k
from tessella.llm.mixing import mix_sources
from tessella.llm.neardup import near_duplicates
from tessella.llm.paragraphs import dedup_passages
from tessella.llm.quotes import link_quotes
from tessella.llm.quotes_sql import QUOTES_SQL
from tessella.llm.sharding import shard
from tessella.llm.toxicity import toxicity
from tessella.llm.warc import warc_round_trip

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_read(spark, sf_dir, "conversations"))


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=3, threshold=(85, 100))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "rejected")


def op4_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x.words)
    return cut.select("doc_id", F.size("removed").cast("long").alias("removed_passages"), words.alias("removed_words"), "removed", "text")


def op5_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(_read(spark, sf_dir, "embeddings"), 64)
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def encoded(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"), 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(_read(spark, sf_dir, "documents"))


#: Target weights by level; sources of a language weigh alike.
DOMAIN_WEIGHTS = {"web": 40, "books": 25, "news": 20, "forum": 15}
LANGUAGE_WEIGHTS = {"en": 55, "de": 15, "fr": 15, "es": 15}


def domain_of(source):
    """The domain of a source, by the number in its name: five sources each."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "news").otherwise("forum")


def mixed(docs: DataFrame, max_epochs: int = 4) -> DataFrame:
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix_sources(docs, levels, [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}], max_epochs=max_epochs, seed="mix-1")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_read(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", F.col("epoch").cast("long").alias("epoch"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_linking,
        op2_minhash_near_duplicates,
        op3_toxicity_chain,
        op4_paragraph_banding,
        op5_kdtree_top_k,
        op6_byte_bpe,
        op7_histogram_sharding,
        op8_warc_chunks,
        op9_document_fingerprints,
        op10_source_mix,
    )
}


def _deal_sql(out: str, source: str, parent: str, name: str) -> str:
    """One level of the tree: ``given`` dealt by ``w`` within ``cap``."""
    return f"""
{out}_1 AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
         sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM {source}),
{out}_2 AS (SELECT *, (given - bef) * w >= cap * onward AS is_full FROM {out}_1),
{out}_3 AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS taken, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS open_w FROM {out}_2),
{out} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (w * (given - taken)) // open_w END AS budget FROM {out}_3)"""


SQL = {
    "op1_quotation_linking": QUOTES_SQL,
    "op5_kdtree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
""",
    "op8_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS holder FROM p),
d AS (
  SELECT *, octet_length(encode(body))::BIGINT AS payload_bytes,
         list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || substr(sha1(body), i + 1, 1))::INT), 4, '0')), 'string_agg', '') AS bits
  FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM d
""",
    "op10_source_mix": f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens,
         TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n
  FROM documents),
rows_ AS (SELECT *, CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'books' WHEN n < 15 THEN 'news' ELSE 'forum' END AS domain FROM d),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * 4 AS cap FROM rows_ GROUP BY ALL),
dom0 AS (SELECT 0 AS root, domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'web' THEN 40 WHEN 'books' THEN 25 WHEN 'news' THEN 20 ELSE 15 END::BIGINT AS w, (SELECT sum(tokens)::BIGINT FROM leaf) AS given FROM leaf GROUP BY domain),
{_deal_sql("dom", "dom0", "root", "domain")},
lan0 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, CASE l.lang WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 1 END::BIGINT AS w, any_value(dom.budget) AS given FROM leaf l JOIN dom USING (domain) GROUP BY l.domain, l.lang),
{_deal_sql("lan", "lan0", "domain", "lang")},
src0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, 1::BIGINT AS w, lan.budget AS given FROM leaf l JOIN lan USING (domain, lang)),
{_deal_sql("src", "src0", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END::BIGINT AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM src),
keyed AS (
  SELECT r.doc_id, domain, lang, source, r.tokens, whole, rest,
         ('0x' || substr(md5('mix-1|' || whole || '|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u
  FROM rows_ r JOIN plan USING (domain, lang, source)),
reached AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY u, doc_id) AS reach FROM keyed),
times AS (SELECT *, whole + CASE WHEN rest > 0 AND reach <= rest THEN 1 ELSE 0 END AS epochs FROM reached)
SELECT doc_id, domain, lang, source, tokens, unnest(range(epochs)) AS epoch FROM times WHERE epochs > 0
"""
}
