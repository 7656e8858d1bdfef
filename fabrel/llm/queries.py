"""The registered query of each training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokens
from .common import table
from .decontaminate import contaminations
from .jaccard import near_duplicates
from .license_scan import scan_licenses
from .line_dedup import MIN_LINE, MIN_RUN, deduplicate_units
from .mixing import MIX_SQL, mix_sources
from .prefix_trie import TRIE_SQL, shared_prefixes
from .quality import score_documents, train
from .shard import shard_documents
from .simhash import simhash_groups
from .suffix_dedup import deduplicate_strings
from .topk import top_k
from .url_filter import filter_urls


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their sentences, each with a digest: a line of `MIN_LINE` words that repeats goes, and so do repeated sentences in
    stretches of `MIN_RUN` words or more."""
    return deduplicate_units(table(spark, sf_dir, "documents"), min_words=1, min_run=MIN_RUN, min_line=MIN_LINE)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_strings(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shard_documents(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_prefixes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_topk_search, op4_suffix_array_dedup, op5_quality, op6_sharding, op7_jaccard_join, op8_mixing, op9_license_scan, op10_url_filter, op11_simhash, op12_token_alignment, op13_prefix_trie)}

ORACLE_SQL = {
    "op3_topk_search": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::INTEGER as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
""",
    "op8_mixing": MIX_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
