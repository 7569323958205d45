"""The registered queries of the operators: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (bestfit_packing, bpe_lexicon, hard_negatives, language_id, phrase_mining, quality_fm, robust_rules, secret_scan,
                         simhash_pivot, substring_cover, url_templates, vector_sharding, vector_topk)
from lectern.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def bucket(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_fm.FactorisationMachine:
    """Labels only of rows whose crc32(doc_id as text) modulo 5 is not 0."""
    return quality_fm.train(docs, read_table(spark, sf_dir, "labels"), bucket(5) != 0)


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    """Texts and languages only of rows whose crc32(doc_id as text) modulo 3 is not 1."""
    return language_id.train(docs, bucket(3) != 1)


@query
def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the factorisation machine."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality_fm.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document: family, then pairwise linear SVMs."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language_id.predict(docs.select("doc_id", "text"), language_model(docs))
    return named.select("doc_id", F.coalesce(bucket(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op3_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes."""
    placed = vector_sharding.assign(read_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest rule, else its host's path template."""
    return url_templates.judge(read_table(spark, sf_dir, "pages"))


ORACLE["op4_url_templates"] = url_templates.oracle_sql()


@query
def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    named = simhash_pivot.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, k=3)
    return named.select("doc_id", simhash_pivot.hex_of("fp").alias("fingerprint"), "component_id")


@query
def op6_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the robust outlier test for every document."""
    return robust_rules.judge(read_table(spark, sf_dir, "documents"))


@query
def op7_substring_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in no repeated 50-word window of a smaller id."""
    return substring_cover.digest_report(read_table(spark, sf_dir, "documents"), window=50)


@query
def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 4096 tokens."""
    return bestfit_packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector, against all vectors."""
    return vector_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op9_vector_topk"] = """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op10_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoding of every document, with the lexicon of its corpus."""
    return bpe_lexicon.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    return phrase_mining.collocations(phrase_mining.frequent_phrases(read_table(spark, sf_dir, "documents")))


ORACLE["op11_toivonen_phrases"] = phrase_mining.oracle_sql()


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: keyword prefilter, anchored patterns, checksums."""
    return secret_scan.digest_report(read_table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five best positives of every fiftieth vector."""
    label = F.col("label").cast("long")
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE["op13_hard_negatives"] = """WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER () AS id FROM v),
s AS (SELECT a.id, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT id, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.id, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.id = p.id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n"""
