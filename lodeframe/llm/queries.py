"""The queries op1_ to op10_ over the synthetic tables, each through its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import crosspolytope, decontaminate, jaccard, licenses, packing, quality, secrets, sharding, token_counts, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccard": op2_jaccard,
    "op3_licenses": op3_licenses,
    "op4_embeddings": op4_embeddings,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_token_files": op10_token_files,
}

# Equivalents by comparing all pairs, where the method leaves no freedom in its result.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard": r"""
with recursive split as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingled as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' ')))) when len(w) > 0 then [hash(array_to_string(w, ' '))] else [] end) as s from split),
sizes as (select doc_id, count(s) as n from (select split.doc_id, s from split left join shingled using (doc_id)) group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingled a join shingled b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reached as (select doc_id, doc_id as other from documents union select doc_id, b from reached join links on other = a)
select doc_id, n as n_shingles, min(other) as component_id from reached join sizes using (doc_id) group by doc_id, n""",
    "op4_embeddings": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9),
reached as (select vec_id, vec_id as other from embeddings union select vec_id, b from reached join links on other = a),
counted as (select a, count(*) as n from links group by a)
select vec_id, coalesce(max(n), 0) as n_links, min(other) as component_id, vec_id = min(other) as kept from reached left join counted on a = vec_id group by vec_id""",
}
