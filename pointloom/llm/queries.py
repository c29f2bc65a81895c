"""The queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.simhash import deduplicate_documents

    return deduplicate_documents(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.quality_rules import judge_documents

    return judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.topk import search_embeddings

    return search_embeddings(read(spark, sf_dir, "embeddings"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.token_shards import materialise_documents

    return materialise_documents(read(spark, sf_dir, "documents"))


def op5_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.pii import pseudonymise_documents, session_key

    return pseudonymise_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.mixing import mix_documents

    return mix_documents(read(spark, sf_dir, "documents"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.bpe import encode_digests

    return encode_digests(read(spark, sf_dir, "documents"))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.quality_model import classify

    return classify(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_quality_rules, op3_ball_tree_top_k, op4_token_shards, op5_pseudonymise, op6_mix_sources, op7_feistel_shards, op8_byte_bpe, op9_suffix_repeats, op10_weak_label_quality)}
ORACLE_SQL: dict[str, str] = {
    "op3_ball_tree_top_k": """
        with v as (select row_number() over () n, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) e from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.n, q.vec_id query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) score from v q join v c on q.n <> c.n and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
        r as (select *, row_number() over (partition by n order by score desc, vec_id) "rank" from s)
        select query_id, cast("rank" as int) "rank", vec_id, score from r where "rank" <= 10""",
}
